"""Sequence comparison and error rates against the standard library and brute force."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import alignment
from parlance.operators import evaluation as ev


def pairs_of(blocks):
    return [(i + k, j + k) for i, j, n in blocks for k in range(n)]


def test_blocks_equal_difflib():
    r = random.Random(5)
    for _ in range(400):
        words = "a b c d e f".split()[: r.randrange(1, 7)]
        a = [r.choice(words) for _ in range(r.randrange(0, 25))]
        b = [r.choice(words) for _ in range(r.randrange(0, 25))]
        want = pairs_of(SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert pairs_of(ev.matching_blocks(a, b)) == want


def changed(r, a, kinds):
    b = list(a)
    for _ in range(r.randrange(0, 12)):
        k = r.randrange(len(b) + 1)
        b[k : k + r.randrange(0, 9)] = r.choice([[], [r.randrange(kinds)], [r.randrange(kinds) for _ in range(r.randrange(1, 9))], b[: r.randrange(1, 40)]])
    return b


def test_blocks_of_longer_sequences_equal_difflib(monkeypatch):
    monkeypatch.setattr(alignment, "SMALL", 0)
    r = random.Random(8)
    for trial in range(500):
        monkeypatch.setattr(alignment, "MANY", 30 if trial % 5 == 0 else 1 << 25)
        kinds = r.choice([2, 3, 5, 20, 200])
        a = [r.randrange(kinds) for _ in range(r.randrange(0, 120))]
        b = changed(r, a, kinds) if r.random() < 0.6 else [r.randrange(kinds) for _ in range(r.randrange(0, 120))]
        assert pairs_of(alignment.matching_blocks(a, b)) == pairs_of(SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_recordings_in_ranges_equal_whole_ones(spark, monkeypatch):
    """Recordings cut at runs of many tokens, one that repeats itself, unlike and one-sided ones, over several blocks of rows."""
    monkeypatch.setattr(alignment, "WHOLE", 500)
    monkeypatch.setattr(alignment, "BLOCK", 64)
    r = random.Random(9)
    base = [f"w{int(r.paretovariate(0.8))}" for _ in range(3000)]
    heard = [w for w in (r.choice(["x", "y"]) if r.random() < 0.02 else w for w in base) if r.random() > 0.01]
    twice = [f"t{i % 70}" for i in range(3000)]
    sides = {1: (base, heard), 2: (twice, twice[9:] + ["z"] * 40), 3: (base[:900], base[1500:2400]), 4: (base[:20], heard[:25]), 5: (base[:5], []), 6: (["a"] * 700, ["a"] * 300)}
    rows = lambda s: spark.createDataFrame([(k, i, t) for k, v in sides.items() for i, t in enumerate(v[s])], "recording_id long, pos long, tok string")
    got = {}
    for x in alignment.aligned_positions(rows(0), rows(1)).collect():
        got.setdefault(x.recording_id, []).append((x.gold_pos, x.hyp_pos))
    for k, (a, b) in sides.items():
        assert sorted(got.get(k, [])) == pairs_of(alignment.matching_blocks(a, b)), k
    assert alignment.aligned_positions(rows(0).limit(0), rows(1)).count() == 0


def slow_edits(a, b):
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i and not j:
                best[i, j] = (0, 0)
                continue
            opts = []
            if i:
                opts.append((best[i - 1, j][0] + 1, best[i - 1, j][1]))
            if j:
                opts.append((best[i, j - 1][0] + 1, best[i, j - 1][1]))
            if i and j:
                same = a[i - 1] == b[j - 1]
                opts.append((best[i - 1, j - 1][0] + (not same), best[i - 1, j - 1][1] - same))
            best[i, j] = min(opts)
    return best[len(a), len(b)]


def test_edit_counts_are_minimal_with_most_hits():
    r = random.Random(6)
    for _ in range(400):
        a = [r.choice("abc") for _ in range(r.randrange(0, 12))]
        b = [r.choice("abc") for _ in range(r.randrange(0, 12))]
        got = ev.edit_counts(a, b)
        cost, hits = slow_edits(a, b)
        assert got["substitutions"] + got["deletions"] + got["insertions"] == cost
        assert got["hits"] == -hits
        assert got["hits"] + got["substitutions"] + got["deletions"] == len(a)
        assert min(got.values()) >= 0


def test_assignment_is_optimal():
    r = np.random.default_rng(7)
    for n, m in [(1, 1), (2, 3), (4, 2), (5, 5), (3, 6)]:
        for _ in range(20):
            g = r.integers(0, 20, (n, m))
            got = sum(g[i, j] for i, j in ev.best_assignment(g))
            small, big, t = (n, m, g) if n <= m else (m, n, g.T)
            want = max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
            assert got == want


def test_word_errors(spark):
    df = spark.createDataFrame([(1, "Один, два три четыре!", "один две три"), (2, "", "лишнее"), (3, "ёж", "еж")], "id int, ref string, hyp string")
    got = {r.id: r for r in ev.word_errors(df).collect()}
    assert (got[1].hits, got[1].substitutions, got[1].deletions, got[1].insertions, got[1].wer) == (2, 1, 1, 0, 0.5)
    assert got[2].wer is None and got[2].insertions == 1
    assert got[3].wer == 0.0
    assert spark.createDataFrame([("дом", "дым")], "r string, h string").select(ev.char_error_rate("r", "h")).first()[0] == 0.3333


def der_by_ms(ref, hyp, collar, skip):
    """Millisecond by millisecond, the best mapping by trying all."""
    end = max(e for _, e, _ in ref + hyp) + 500
    marks = [t for s, e, _ in ref for t in (s, e)]
    cells = []
    for t in range(-300, end):
        if collar and any(m - collar // 2 <= t < m + collar // 2 for m in marks):
            continue
        r = {k for s, e, k in ref if s <= t < e}
        h = {k for s, e, k in hyp if s <= t < e}
        if skip and len(r) > 1:
            continue
        cells.append((r, h))
    refs, hyps = sorted({k for *_, k in ref}), sorted({k for *_, k in hyp})
    best = 0
    for p in itertools.permutations(hyps + [None] * len(refs), len(refs)):
        m = dict(zip(refs, p))
        best = max(best, sum(len({m[x] for x in r} & h) for r, h in cells))
    total = sum(len(r) for r, _ in cells)
    miss = sum(max(0, len(r) - len(h)) for r, h in cells)
    fa = sum(max(0, len(h) - len(r)) for r, h in cells)
    conf = sum(min(len(r), len(h)) for r, h in cells) - best
    return total, miss, fa, conf


def test_diarization_error(spark):
    rng = random.Random(8)
    for trial in range(3):
        make = lambda names, n: [(s := rng.randrange(0, 3000), s + rng.randrange(200, 1200), rng.choice(names)) for _ in range(n)]
        # A speaker's own rows are kept apart so that "active" is the same on both counts.
        ref, hyp = make("AB", 5), make("xyz", 5)
        for collar, skip in ((0, False), (250, False), (250, True)):
            mk = lambda rows: spark.createDataFrame([("rec", *r) for r in rows], "recording_id string, start_ms int, end_ms int, speaker string")
            got = ev.diarization_error(mk(ref), mk(hyp), collar, skip).first()
            want = der_by_ms(ref, hyp, collar, skip)
            assert (got.total_ms, got.miss_ms, got.false_alarm_ms, got.confusion_ms) == want, (trial, collar, skip)


def test_coverage_finds_times(spark):
    turns = spark.createDataFrame([("r", 1, "Добрый день, коллеги"), ("r", 2, "Иное"), ("r", 3, "начнём работу")], "recording_id string, turn int, text string")
    words = spark.createDataFrame(
        [("r", i, w, i * 1000, i * 1000 + 800) for i, w in enumerate(["добрый", "день", "коллеги", "начнем", "работу"])], "recording_id string, pos int, word string, start_ms int, end_ms int"
    )
    got = {r.turn: (r.n_tokens, r.n_matched, r.start_ms, r.end_ms, r.status) for r in ev.turn_coverage(turns, words).collect()}
    assert got == {1: (3, 3, 0, 2800, "aligned"), 2: (1, 0, None, None, "unaligned"), 3: (2, 2, 3000, 4800, "aligned")}


def test_matched_pairs_on_edited_text(spark):
    df = spark.createDataFrame([(1, "A b, c. D e", "a b c? x e")], "id int, ref string, hyp string")
    got = sorted((r.gold_pos, r.hyp_pos, r.gold.punct, r.hyp.punct) for r in ev.matched_pairs(df).collect())
    assert got == [(0, 0, "", ""), (1, 1, ",", ""), (2, 2, ".", "?"), (4, 4, "", "")]
    assert df.select(ev.similarity_ratio(F.split("ref", " "), F.split("hyp", " "))).first()[0] == 0.2


def test_similarity_query_keeps_short_lines(spark):
    from checks import load
    from checks.adapters import Tables

    folder = "/root/testdata/sf0.001"
    got = {(r.meeting_id, r.ord): r.ratio for r in load()[0]["f2_similarity_ratio"](spark, folder).collect()}
    lines = Tables(spark, folder).segments.select("meeting_id", "ord", "text").collect()
    assert len(got) == len(lines) and any(len(r.text.split()) < 4 for r in lines)
    for r in lines:
        w = [x for x in r.text.split(" ") if x]
        hyp = " ".join("zzzz" if i == 2 else x for i, x in enumerate(w[:-1]))
        want = SequenceMatcher(None, r.text.split(" "), hyp.split(" "), autojunk=False).ratio()
        assert abs(got[r.meeting_id, r.ord] - want) <= 1e-4


def test_meeting_edits_where_words_repeat(spark, tmp_path):
    from checks import load

    rows = [(1, 0, "user", " ".join(["go"] * 42)), (2, 0, "user", "one two " * 20), (2, 1, "assistant", "zz12 zz " * 9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.meeting_id: (r.n_ref, r.n_hyp, r.hits, r.substitutions, r.deletions, r.insertions) for r in load()[0]["a25_meeting_edits"](spark, str(tmp_path)).collect()}
    want = {m: (n, n - (n + 6) // 14 + (n + 1) // 14, n - (n + 11) // 14 - (n + 6) // 14, (n + 11) // 14, (n + 6) // 14, (n + 1) // 14) for m, n in ((1, 42), (2, 58))}
    assert got == want


def test_coverage_where_an_unheard_turn_shares_words(spark, tmp_path):
    from checks import load

    lines = ["good morning", "the agenda", "so the plan, the whole plan", "the", "plan", "the the", "the plan the", "", "plan", "the plan"]
    rows = [(1, i, "user", x) for i, x in enumerate(lines)] + [(2, i, "user", "yes yes") for i in range(9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.recording_id, r.turn): (r.n_tokens, r.n_matched, r.status) for r in load()[0]["a33_turn_coverage"](spark, str(tmp_path)).collect()}
    said = {(1, k): len(x.split()) for k, x in enumerate((x for x in lines if x), 1)} | {(2, k): 2 for k in range(1, 10)}
    assert got == {(m, k): (n, 0, "unaligned") if k % 4 == 3 else (n, n, "aligned") for (m, k), n in said.items()}
