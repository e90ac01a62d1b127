"""Profiles, replies, items, quality and files on small fixtures."""

import json
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from parlance.operators import items as it
from parlance.operators import people as pp
from parlance.operators import quality as ql
from parlance.operators.ordered import dense_index, by_position
from parlance.sources import readers as rd
from parlance.sources import writers as wr


def test_best_profile_over_several_blocks_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(pp, "CENTROIDS_PER_BLOCK", 7)
    monkeypatch.setattr(pp, "QUERIES_PER_TASK", 11)
    rng = np.random.default_rng(3)
    c, q = rng.normal(size=(40, 8)), rng.normal(size=(60, 8))
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "profile_id int, centroid array<double>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id int, embedding array<double>")
    got = {r.query_id: r.profile_id for r in pp.best_profile(qdf, cdf, threshold=-99).collect()}
    assert got == dict(enumerate((q @ c.T).argmax(axis=1).tolist()))


def test_centroid_of_opposite_samples_is_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [3.0, 4.0])], "profile_id int, embedding array<double>")
    got = {r.profile_id: r.centroid for r in pp.centroids(df).collect()}
    assert got == {1: [0.0, 0.0], 2: [0.6, 0.8]}


def test_rename_inside_protocols(spark):
    schema = "meeting_id int, participants array<string>, turns array<struct<speaker:string,text:string>>, tasks array<struct<text:string,owner:string>>"
    df = spark.createDataFrame([(1, ["Ann", "Bob"], [("Ann", "hi")], [("do", "Ann")]), (2, ["Ann"], [], [])], schema)
    ren = spark.createDataFrame([(1, "Ann", "Anna")], "meeting_id int, old_name string, new_name string")
    got = {r.meeting_id: r for r in pp.rename_in_protocols(df, ren).collect()}
    assert got[1].participants == ["Anna", "Bob"] and got[1].turns[0].speaker == "Anna" and got[1].tasks[0].owner == "Anna"
    assert got[2].participants == ["Ann"]


def test_labels_resolve_in_nested_fields(spark):
    df = spark.createDataFrame([(1, ["SPEAKER_6", "Ann"], [("speaker 02 agrees", "t")])], "meeting_id int, participants array<string>, turns array<struct<speaker:string,text:string>>")
    maps = spark.createDataFrame([(1, {"SPEAKER_06": "Bob"})], "meeting_id int, mapping map<string,string>")
    got = pp.resolve_in_protocols(df, maps).first()
    assert got.participants == ["Bob", "Ann"] and got.turns[0].speaker == "Спикер #2 agrees"


def same_item(c, o):
    """The rule for two items, later one first."""
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    near = c["s"] is not None and o["s"] is not None and abs(c["s"] - o["s"]) <= 180
    return bool(
        o["t"]
        and (c["t"] == o["t"] or ratio(c["t"], o["t"]) >= (0.72 if near else 0.86) or (c["e"] and c["e"] == o["e"]) or (near and c["e"] and o["e"] and ratio(c["e"], o["e"]) >= 0.78))
    )


def one_by_one(existing, candidates):
    kept = list(existing)
    for c in candidates:
        if c["t"] and not any(same_item(c, o) for o in kept):
            kept.append(c)
    return kept


ITEMS = "meeting_id int, ord bigint, kind string, text string, evidence string, timestamp string"


def test_fuzzy_union_equals_the_sequential_rule(spark):
    texts = ["prepare the budget report", "prepare the budget reports", "call the client on monday", "call client on monday", "hire two engineers", "hire three engineers", "prepare a budget report now", "", "order new chairs", "order new chair"]
    r = random.Random(4)
    rows = {0: [], 1: []}
    for meeting in range(6):
        for side in (0, 1):
            for i in range(25):
                t = list(r.choice(texts))
                for _ in range(r.randrange(0, 5)):
                    if t:
                        t[r.randrange(len(t))] = r.choice("abcdefgh ")
                e = r.choice(["", "", "we said so at length", "we said so at full length", "nobody said that", "".join(t)[:9]])
                rows[side].append((meeting, i, r.choice(["task", "decision", "risk", "open_question", "other", None]), "".join(t), e, r.choice([f"0{r.randrange(10)}:{r.randrange(10, 60)}", "", None, "later"])))
    got = it.fuzzy_union(spark.createDataFrame(rows[0], ITEMS), spark.createDataFrame(rows[1], ITEMS))
    norm = lambda x: " ".join(re.sub("[^0-9a-z]+", " ", (x or "").lower()).split())
    secs = lambda x: int(x[:2]) * 60 + int(x[3:]) if x and ":" in x else None
    item = lambda x: {"m": x[0], "ord": x[1], "t": norm(x[3]), "e": norm(x[4]), "s": secs(x[5])}
    want = set()
    for meeting in range(6):
        old, new = ([item(x) for x in rows[s] if x[0] == meeting] for s in (0, 1))
        kept = one_by_one(old, new)
        want |= {(meeting, x["ord"], False) for x in old} | {(meeting, x["ord"], True) for x in kept[len(old) :]}
    assert {(x.meeting_id, x.ord, x.candidate) for x in got.collect()} == want and got.count() == len(want)
    places = it.bucketed(got).collect()
    assert {(x.kind, x.bucket) for x in places} == {("task", "tasks"), ("decision", "decisions"), ("risk", "risks"), ("open_question", "open_questions")}
    for key in {(x.meeting_id, x.bucket) for x in places}:
        own = sorted((x.place, x.candidate, x.ord) for x in places if (x.meeting_id, x.bucket) == key)
        assert [p for p, _, _ in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert it.fuzzy_union(spark.createDataFrame([], ITEMS), spark.createDataFrame([], ITEMS)).count() == 0


def test_similar_pairs_miss_none(spark):
    r = random.Random(1)
    texts = sorted({"".join(r.choice("ab cd") for _ in range(r.randrange(1, 22))) for _ in range(150)})
    df = spark.createDataFrame([(1, 0, t, True) for t in texts], "meeting_id int, zone long, v string, asks boolean")
    for floor in (0.72, 0.86):
        got = {(x.a, x.b) for x in it.similar_pairs(df, floor).collect()}
        assert got == {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= floor}


def test_similar_pairs_of_a_long_meeting_do_not_travel(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("etaoin shrdlu") for _ in range(r.randrange(250, 350))) for _ in range(700)]
    texts += [t[:100] + "xyz" + t[100:] for t in texts[:40]]
    df = spark.createDataFrame([(1, 0, t, True) for t in texts], "meeting_id int, zone long, v string, asks boolean")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    got = {(x.a, x.b) for x in it.similar_pairs(df, 0.72).collect()}
    # Popular characters of texts from 200 on count as junk, so what is similar is settled by the standard library.
    want = {tuple(sorted((a, b))) for a, b in zip(texts[:40], texts[700:]) if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.72}
    assert got >= want
    assert written() - before < 40 * sum(map(len, texts))


def test_repeats_match_the_plain_search(spark):
    texts = ["xy " * 60, "a" * 150, "no repeats here at all, just a sentence that is long enough to be looked at by the detector, ok?", ("lorem ipsum dolor sit amet " * 3) + "end of it all now and some more"]
    df = spark.createDataFrame([(1, i, 0, 1000, t) for i, t in enumerate(texts)], "meeting_id int, ord int, start_ms int, end_ms int, text string")
    got = sorted((r.ord, r.size, r["at"]) for r in ql.repeated_text(df).collect())
    want = []
    for o, t in enumerate(texts):
        t = t.lower()
        if len(t) < 100:
            continue
        for n in range(20, 101):
            hit = next((i for i in range(len(t) - 2 * n) if t[i : i + n] == t[i + n : i + 2 * n]), None)
            if hit is not None:
                want.append((o, n, hit))
    assert got == want


def test_artifacts_of_both_shapes(spark, tmp_path):
    for name, body in {"m1": [{"start": 0, "end": 1.5, "text": "hi", "speaker": "A"}], "m2": {"segments": [{"start": 2, "end": 3, "words": [{"start": 2, "end": 2.5, "text": "yo"}]}]}}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "aligned.json").write_text(json.dumps(body, indent=1))
    got = {r.meeting_id: r for r in rd.tolerant_segments(rd.artifact_rows(rd.whole_files(spark, f"{tmp_path}/*/aligned.json"))).collect()}
    assert (got["m1"].end_ms, got["m1"].speaker_id, got["m1"].confidence) == (1500, "A", 1.0)
    assert (got["m2"].speaker_id, got["m2"].words[0].word, got["m2"].words[0].end_ms) == ("SPEAKER_?", "yo", 2500)


def test_audit_write_and_scan(spark, tmp_path):
    rows = [("2026-04-06T10:00:00+00:00", "auth.login.success", "admin", None, None, None, {"k": "v"}, True, None), ("2026-04-07T10:00:00+00:00", "meeting.upload", None, "10.0.0.1", "meeting", "7", None, False, "disk")]
    df = spark.createDataFrame(rows, rd.AUDIT_SCHEMA)
    wr.write_audit(df, str(tmp_path / "a"))
    wr.write_audit(df.limit(1), str(tmp_path / "a"))
    back = rd.audit_events(rd.lines(spark, str(tmp_path / "a/*")))
    assert back.count() == 3 and back.where("username is null").count() == 1
    raw = [r.value for r in rd.lines(spark, str(tmp_path / "a/*")).collect()]
    assert all("null" not in v for v in raw)
    assert sorted(p.name for p in (tmp_path / "a").glob("log_date=*")) == ["log_date=2026-04-06", "log_date=2026-04-07"]


def test_csv_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t", "a", 'say "x", ok', None, None, "1", {"n": "1\n2"}, False, None)], rd.AUDIT_SCHEMA)
    wr.write_csv(df, str(tmp_path / "c"))
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert got.username == 'say "x", ok' and got.outcome == "failure" and json.loads(got.details) == {"n": "1\n2"}


def test_job_catalogue(spark, tmp_path):
    for j in ("j1", "j2"):
        (tmp_path / j).mkdir()
        (tmp_path / j / "job.json").write_text(json.dumps({"id": j, "state": "completed", "progress": 100.0}, indent=2))
    got = sorted((r.job_id, r.state) for r in rd.job_catalogue(spark, str(tmp_path)).collect())
    assert got == [("j1", "completed"), ("j2", "completed")]


def test_rttm_folder_and_rules(spark, tmp_path):
    df = spark.createDataFrame([("r1", 0, 5500, "Д. Голубев"), ("r1", 6000, 6010, "B")], "recording_id string, start_ms int, end_ms int, speaker string")
    wr.write_rttm(df, str(tmp_path / "r"))
    back = sorted(tuple(r) for r in rd.rttm_turns(spark.read.text(str(tmp_path / "r/*"))).collect())
    assert back == [("r1", 0, 5500, "Д._Голубев"), ("r1", 6000, 6050, "B")]
    rules = rd.compiled_rules({"a": {"ул": "улица", r"(\d+) коп": r"\1 копеек", "bad(": "x", "n": 5}, "note": "text"})
    assert [r["ord"] for r in rules] == [0, 1]
    from parlance.functions import text as tx

    got = spark.createDataFrame([("ул Мира, улов, 5 коп",)], "t string").select(tx.apply_rules("t", [(r["pattern"], r["replacement"]) for r in rules])).first()[0]
    assert got == "улица Мира, улов, 5 копеек"


def test_profile_tables_get_defaults(spark, tmp_path):
    spark.createDataFrame([(1, "Ann")], "profile_id int, name string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1, 0, [1.0])], "profile_id int, sample_idx int, embedding array<float>").write.parquet(str(tmp_path / "e"))
    p, e = rd.voice_profiles(spark, str(tmp_path / "p"), str(tmp_path / "e"))
    assert p.first().match_count == 0 and p.first().department == "" and e.count() == 1


def test_batches_with_wrong_ids_are_rejected(spark):
    turns = spark.createDataFrame([(1, 0, 0, 1, 0, "A", "hello big world"), (1, 0, 1, 2, 1, "B", "fine thanks")], "meeting_id int, batch bigint, pos int, ord bigint, turn_id bigint, speaker string, text string")
    ok = [{"turn_id": 0, "speaker": "A", "text": "hello big worlds"}, {"turn_id": 1, "speaker": "B", "text": "fine thanks!"}]
    cases = {
        "good": (json.dumps(ok), {"reverted", "corrected"}),
        "short": (json.dumps(ok[:1]), {"rejected"}),
        "extra": (json.dumps(ok + ok[:1]), {"rejected"}),
        "speaker": (json.dumps([{**ok[0], "speaker": "B"}, ok[1]]), {"rejected"}),
        "empty": (json.dumps([{**ok[0], "text": " "}, ok[1]]), {"rejected"}),
        "object": (json.dumps({"a": 1}), {"rejected"}),
        "prose": ("Here you go: " + json.dumps(ok) + " bye", {"reverted", "corrected"}),
        "broken": ("sorry", {"failed"}),
        "none": (None, {"failed"}),
    }
    for name, (raw, want) in cases.items():
        rep = spark.createDataFrame([(1, 0, raw)], "meeting_id int, batch bigint, raw string")
        got = it.validated_corrections(turns, rep).collect()
        assert {r.status for r in got} == want and len(got) == 2, name


def test_quality_of_missing_meetings(spark):
    ids = spark.createDataFrame([(1,), (2,)], "meeting_id int")
    seg = spark.createDataFrame([(1, 1, 0, 1000, "fine text", 0.9)], "meeting_id int, ord bigint, start_ms bigint, end_ms bigint, text string, confidence double")
    got = {r.meeting_id: (r.score, r.passed) for r in ql.transcript_quality(ids, seg).collect()}
    assert got == {1: (100.0, True), 2: (0.0, False)}


def test_dense_index_with_gaps(spark):
    df = spark.createDataFrame([(1, 10), (1, 50_000), (1, 7)], "meeting_id int, ord bigint")
    assert [r.idx for r in dense_index(df, by_position()).orderBy(F.col("ord")).collect()] == [0, 1, 2]


def test_mean_confidence_is_added_up_in_order(spark):
    rows = [(1, o, 0, 1000, "fine text", c) for o, c in ((3, 0.3), (2, 0.2), (1, 0.1))] + [(2, 1, 0, 1000, "fine text", 0.575), (3, 1, 0, 1000, "fine text", None)]
    seg = spark.createDataFrame(rows, "meeting_id int, ord bigint, start_ms bigint, end_ms bigint, text string, confidence double").coalesce(1)
    got = {r.meeting_id: r for r in ql.transcript_quality(spark.createDataFrame([(1,), (2,), (3,)], "meeting_id int"), seg).collect()}
    assert got[1].avg_confidence == (0.1 + 0.2 + 0.3) / 3 != (0.3 + 0.2 + 0.1) / 3
    # Rounded as SQL does: half to even of the hundredfold, which is 57.49999999999999 here.
    assert [f.value for f in got[2].findings if f.message == "low average confidence"] == [0.57]
    assert got[3].avg_confidence is None and got[3].score == 0.0
