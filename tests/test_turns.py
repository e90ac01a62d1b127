"""Ordered operators on small hand-made meetings."""

from pyspark.sql import functions as F

from parlance.operators import intervals as iv
from parlance.operators import turns as tn

AL = "meeting_id int, ord bigint, start_ms bigint, end_ms bigint, text string, speaker_id string, speaker_name string, confidence double, attribution_confidence double"


def aligned(spark, rows):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], AL)


def test_align_two_speakers_swapped_bounds_and_ties(spark):
    seg = spark.createDataFrame([(1, 1, 0, 5000, "a", 0.9), (1, 2, 10000, 6000, "b", 0.8), (1, 3, 20000, 20000, "zero", 0.7), (2, 1, 0, 1000, "none", 0.6)], "meeting_id int, ord bigint, start_ms bigint, end_ms bigint, text string, confidence double")
    dia = spark.createDataFrame(
        [(1, 1, "s0", None, 0, 5500, False), (1, 2, "s1", "Ann", 5500, 8000, True), (1, 3, "s2", "Bob", 8000, 10500, False)],
        "meeting_id int, d_ord bigint, speaker_id string, speaker_name string, start_ms bigint, end_ms bigint, is_overlap boolean",
    )
    got = {(r.meeting_id, r.ord): r for r in iv.align(seg, dia).collect()}
    assert (got[1, 1].speaker_id, got[1, 1].attribution_confidence) == ("s0", 1.0)
    tie = got[1, 2]
    assert (tie.start_ms, tie.end_ms, tie.speaker_id, tie.speaker_name, tie.attribution_confidence) == (6000, 10000, "s1", "Ann", 0.5)
    assert (got[1, 3].speaker_id, got[1, 3].attribution_confidence) == ("s2", None)
    assert (got[2, 1].speaker_id, got[2, 1].attribution_confidence) == ("speaker_0", None)


def test_interval_join_finds_each_pair_once_for_any_bucket(spark):
    a = spark.createDataFrame([(1, i, i * 700, i * 700 + 2500) for i in range(40)], "meeting_id int, ord int, s int, e int")
    b = spark.createDataFrame([(1, i, i * 900 + 50, i * 900 + 50 + (i % 5) * 1000) for i in range(40)], "meeting_id int, o int, bs int, be int")
    want = sorted((x.ord, y.o) for x in a.collect() for y in b.collect() if min(x.e, y.be) > max(x.s, y.bs))
    for width in (300, 1000, 10**9):
        got = iv.interval_join(a, b, ["meeting_id"], ("s", "e"), ("bs", "be"), width)
        assert sorted((r.ord, r.o) for r in got.collect()) == want


def test_turns_break_on_speaker_and_pause(spark):
    df = aligned(
        spark,
        [
            (0, 1000, "Первая часть", "A", "Ann", 0.9, 0.95),
            (1100, 2000, "Вторая часть", "A", "Ann", 0.5, 0.55),
            (4000, 5000, "— да, конечно", "A", "Ann", 0.7, None),
            (5100, 6000, "Ок.", "B", None, 0.8, 0.8),
            (6000, 6100, "—", "A", "Ann", 0.8, 0.8),
        ],
    )
    got = [tuple(r) for r in tn.build_turns(df).orderBy("ord").select("ord", "text", F.round("confidence", 6), "attribution_confidence", "end_ms").collect()]
    conf = round((0.9 * 1000 + 0.5 * 900) / 1900, 6)
    assert got == [(1, "Первая часть вторая часть", conf, 0.55, 2000), (3, "Да, конечно", 0.7, None, 5000), (4, "Ок.", 0.8, 0.8, 6000)]


def test_span_weighting_counts_pauses(spark):
    df = aligned(spark, [(0, 1000, "aaa", "A", None, 0.2, None), (2000, 3000, "bbb", "A", None, 0.8, None), (3500, 4000, "ccc", "A", None, 0.4, None)])
    c = (0.2 * 1000 + 0.8 * 1000) / 2000
    c = (c * 3000 + 0.4 * 500) / 3500
    got = tn.build_turns(df).first()
    assert abs(got.confidence - c) < 1e-12 and got.text == "Aaa. Bbb ccc"


def test_smoothing_drops_micro_rows_and_keeps_flags(spark):
    df = spark.createDataFrame(
        [(1, 1, "A", None, 0, 1000, False), (1, 2, "B", None, 1000, 1100, False), (1, 3, "A", "Ann", 1300, 900 + 1000, True), (1, 4, "B", None, 3000, 4000, False)],
        "meeting_id int, d_ord bigint, speaker_id string, speaker_name string, start_ms bigint, end_ms bigint, is_overlap boolean",
    )
    got = [(r.start_ms, r.end_ms, r.speaker_id, r.is_overlap, r.speaker_name) for r in tn.smooth(df).orderBy("start_ms").collect()]
    assert got == [(0, 1900, "A", True, "Ann"), (3000, 4000, "B", False, None)]
    plain = [(r.is_overlap, r.speaker_name) for r in tn.smooth(df, keep_flags=False).orderBy("start_ms").collect()]
    assert plain == [(False, None), (False, None)]


SEG = "meeting_id int, ord bigint, start_ms bigint, end_ms bigint, text string, confidence double"


def test_sentence_split_by_characters_and_words(spark):
    text = "Alpha beta gamma. Delta? Ok. Epsilon zeta eta theta"
    df = spark.createDataFrame([(1, 1, 0, 10000, text, 0.5), (1, 2, 0, 5000, text, 0.5)], SEG)
    got = tn.split_by_sentences(df).where("ord = 1").orderBy("piece").collect()
    assert [r.text for r in got] == ["Alpha beta gamma.", "Delta?", "Ok.", "Epsilon zeta eta theta"]
    assert got[0].start_ms == 0 and got[-1].end_ms == 10000
    assert [round(r.end_ms, 3) for r in got[:2]] == [round(10000 * 18 / 51, 3), round(10000 * 25 / 51, 3)]
    assert tn.split_by_sentences(df).where("ord = 2").count() == 1
    words = [(i * 1000, i * 1000 + 900, w) for i, w in enumerate(["Alpha", "beta", "gamma.", "Delta?", "Epsilon", "zeta", "eta", "theta"])]
    wdf = df.where("ord = 1").withColumn("words", F.lit(None))
    wdf = spark.createDataFrame([(1, 1, 0, 10000, text, 0.5, words)], SEG + ", words array<struct<start_ms:bigint,end_ms:bigint,word:string>>")
    got = tn.split_by_sentences(wdf, "words").orderBy("piece").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got][:2] == [("Alpha beta gamma.", 0.0, 2900.0), ("Delta?", 3000.0, 3900.0)]


def test_short_pieces_are_glued_back(spark):
    text = "This is a rather long first sentence. No. And then the rest of it"
    df = spark.createDataFrame([(1, 1, 0, 6000, text, 0.5)], SEG)
    assert [r.text for r in tn.split_by_sentences(df).orderBy("piece").collect()] == ["This is a rather long first sentence. No.", "And then the rest of it"]


def test_diarization_split_by_text_and_words(spark):
    seg = spark.createDataFrame([(1, 1, 0, 4000, "yes of course I do", 0.9), (1, 2, 5000, 5500, "short", 0.9)], SEG)
    dia = spark.createDataFrame([(1, 1, "A", 0, 2000), (1, 2, "B", 2000, 4000), (1, 3, "A", 5000, 5500)], "meeting_id int, d_ord bigint, speaker_id string, start_ms bigint, end_ms bigint")
    got = [(r.ord, r.start_ms, r.end_ms, r.text) for r in tn.split_by_diarization(seg, dia).orderBy("ord", "piece").collect()]
    assert got == [(1, 0, 2000, "yes of"), (1, 2000, 4000, "course I do"), (2, 5000, 5500, "short")]
    words = spark.createDataFrame([(1, 1, i, w, i * 800, i * 800 + 700) for i, w in enumerate("yes of course I do".split())], "meeting_id int, seg_ord bigint, w_pos bigint, word string, start_ms bigint, end_ms bigint")
    got = [(r.ord, r.text) for r in tn.split_words_by_diarization(seg, words, dia).orderBy("ord", "piece").collect()]
    assert got == [(1, "yes of course"), (1, "I do"), (2, "short")]


def test_chunk_overlap_uses_the_trimmed_row(spark):
    rows = [(1, 1, "one two three"), (1, 2, "Two, three four"), (1, 3, "three four five"), (1, 4, "six")]
    df = spark.createDataFrame([(m, o, t, t.split()) for m, o, t in rows], "meeting_id int, ord bigint, text string, words array<string>")
    got = {r.ord: (r.text, r.cut) for r in tn.dedupe_chunk_overlap(df).collect()}
    # Row 2 is left with "four" only, so row 3 cannot match two words of it.
    assert got == {1: ("one two three", 0), 2: ("four", 2), 3: ("three four five", 0), 4: ("six", 0)}


def test_short_merge_uses_the_running_length(spark):
    df = spark.createDataFrame([(1, 1, 0, 200, "a", 0.1), (1, 2, 250, 400, "b", 0.9), (1, 3, 450, 600, "c", 0.2), (1, 4, 650, 800, "d", 0.3)], SEG)
    got = [(r.ord, r.text, r.confidence) for r in tn.merge_short(df).orderBy("ord").collect()]
    assert got == [(1, "a b c", 0.9), (4, "d", 0.3)]


def test_speech_packing_splits_and_drops_the_tail(spark):
    df = spark.createDataFrame([(1, 1, 0, 70_000, 100_000), (1, 2, 71_000, 80_000, 100_000), (1, 3, 81_000, 90_000, 100_000), (1, 4, 99_900, 100_000, 100_000)], "meeting_id int, ord bigint, start_ms bigint, end_ms bigint, audio_ms bigint")
    got = [(r.ord, r.part, round(r.start_ms), round(r.end_ms), round(r.read_end_ms)) for r in tn.pack_speech(df).orderBy("ord", "part").collect()]
    assert got == [(1, 0, 0, 23333, 24833), (1, 1, 23333, 46667, 48167), (1, 2, 46667, 70000, 71500), (2, 0, 71000, 90000, 91500)]


def test_editor_split_and_merge(spark):
    df = aligned(spark, [(0, 2000, "First half. Second half", "A", None, 0.9, 0.9), (2000, 3000, "tail", "A", None, 0.5, None)])
    got = tn.editor_split(df, df.where("ord = 1")).orderBy("ord", "piece").collect()
    assert [r.text for r in got] == ["First half.", "Second half", "tail"]
    assert got[0].end_ms == got[1].start_ms == 1000.0
    merged = tn.editor_merge(df, df.where("ord = 2")).first()
    assert (merged.text, merged.end_ms, merged.confidence, merged.attribution_confidence) == ("First half. Second half tail", 3000, 0.5, None)


def test_result_does_not_depend_on_partitioning(spark):
    rows = [(i * 900, i * 900 + 700, f"piece {i}", "AB"[(i // 3) % 2], None, 0.5, 0.5) for i in range(200)]
    df = aligned(spark, rows)
    one = sorted(tn.build_turns(df.coalesce(1)).collect())
    many = sorted(tn.build_turns(df.repartition(8)).collect())
    assert one == many
