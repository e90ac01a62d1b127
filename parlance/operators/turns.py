"""Ordered operators over segments and words: smoothing, merging, turn building, splitting, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators.greedy import greedy_groups, surveyed
from parlance.operators.intervals import interval_join, speaker_runs, window_members
from parlance.operators.ordered import (
    BLOCK_MS,
    Timeline,
    affine_in_blocks,
    by_position,
    by_time,
    dense_index,
    fill,
    islands,
    joined_text,
    neighbours,
    running_totals,
)

# Fixed values of the merging and splitting rules (milliseconds, characters, words).
MICRO_MS, SMOOTH_GAP_MS = 150, 300
TURN_GAP_MS = 2000
SHORT_MS, SHORT_GAP_MS = 500, 300
ADJACENT_PAUSE_MS = 500
WORD_GAP_MS, SEGMENT_SPAN_MS = 800, 15_000
CHUNK_MAX_MS, CHUNK_MIN_MS, CHUNK_LIMIT_MS, CHUNK_TAIL_MS, READ_TAIL_MS = 22_000, 15_000, 30_000, 200, 1_500
OVERLAP_WORDS, MATCH_WORDS = 8, 2
BATCH_CHARS, PROMPT_CHARS = 4000, 800
SENTENCE_SPLIT_MS, MIN_PIECE_MS = 6000, 400
SPLIT_MIN_MS = 1200
SAMPLE_MIN_MS = 8000

CHAIN_BLOCK = 256


def drop_micro(df: DataFrame, min_ms: Column | int) -> DataFrame:
    """Rows at least ``min_ms`` long."""
    return df.where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def min_turn_ms(meeting_type: str = "meeting_type") -> Column:
    """Court hearings keep turns from 200 ms, other meetings from 500 ms."""
    return F.when(F.col(meeting_type) == "court_hearing", 200).otherwise(500)


def smooth(diarization: DataFrame, min_ms: int = MICRO_MS, gap_ms: int = SMOOTH_GAP_MS, keep_flags: bool = True) -> DataFrame:
    """Drop micro rows, merge neighbours of one speaker over short gaps; the end is the last row's end."""
    rows = drop_micro(diarization, min_ms)
    tl = by_time(order=("start_ms", "d_ord"))
    isl = islands(
        rows, tl, ["speaker_id", "start_ms", "end_ms"], lambda p, c: (p("speaker_id") != c("speaker_id")) | (c("start_ms") - p("end_ms") > gap_ms)
    )
    pos = F.struct("start_ms", "d_ord")
    flag = F.max(F.coalesce("is_overlap", F.lit(False))) if keep_flags and "is_overlap" in diarization.columns else F.lit(False)
    name = F.min_by("speaker_name", F.when(F.col("speaker_name").isNotNull(), pos)) if keep_flags and "speaker_name" in diarization.columns else F.lit(None).cast("string")
    return isl.groupBy("meeting_id", "island").agg(
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", pos).alias("end_ms"),
        F.first("speaker_id").alias("speaker_id"),
        flag.alias("is_overlap"),
        name.alias("speaker_name"),
        F.min("d_ord").alias("d_ord"),
        F.count("*").alias("merged_rows"),
    ).drop("island")


def merge_consecutive(aligned: DataFrame) -> DataFrame:
    """Join neighbours with the same speaker id and name; confidence is the running half-and-half mean."""
    same = lambda p, c: p("speaker_id").eqNullSafe(c("speaker_id")) & p("speaker_name").eqNullSafe(c("speaker_name"))
    isl = islands(aligned, by_position(), ["speaker_id", "speaker_name"], lambda p, c: ~same(p, c))
    first = F.col("island") == F.col("ord")
    conf = F.col("confidence")
    return affine_in_blocks(
        isl,
        ["meeting_id", "island"],
        "ord",
        keep=F.when(first, 0.0).otherwise(0.5),
        add=F.when(first, conf).otherwise(conf * 0.5),
        parts=_block_parts(F.col("text")),
        whole=_whole_parts(),
    ).withColumnsRenamed({"island": "ord", "folded": "confidence", "joined": "text"}).drop("raw")


def _block_parts(piece: Column) -> dict[str, Column]:
    return {
        "part": joined_text(piece, "ord"),
        "raw": F.min_by("text", "ord"),
        "start_ms": F.min_by("start_ms", "ord"),
        "end_ms": F.max_by("end_ms", "ord"),
        "speaker_id": F.first("speaker_id"),
        "speaker_name": F.min_by("speaker_name", "ord"),
        "attribution_confidence": F.min("attribution_confidence"),
        "rows": F.count("*"),
    }


def _whole_parts() -> dict[str, Column]:
    return {
        "joined": joined_text(F.col("part"), "_block"),
        "raw": F.min_by("raw", "_block"),
        "start_ms": F.min_by("start_ms", "_block"),
        "end_ms": F.max_by("end_ms", "_block"),
        "speaker_id": F.first("speaker_id"),
        "speaker_name": F.min_by("speaker_name", "_block"),
        "attribution_confidence": F.min("attribution_confidence"),
        "rows": F.sum("rows"),
    }


def _breaks_turn(gap_ms: int):
    return lambda p, c: ~p("speaker_id").eqNullSafe(c("speaker_id")) | (c("start_ms") - p("end_ms") >= gap_ms)


def turn_islands(aligned: DataFrame, gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """W3 grouping: a new turn at a speaker change or a gap of ``gap_ms``; keeps the rows around and the turn's first row."""
    cols = ["speaker_id", "start_ms", "end_ms", "text"]
    return islands(aligned, by_position(), cols, _breaks_turn(gap_ms), name="turn", prev="prev", opening="opened", following="nxt")


def build_turns(aligned: DataFrame, gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """Speaker turns with polished seams, least attribution confidence and span-weighted confidence.

    Rows need non-blank text.  A seam depends on its two rows only.  The confidence recurrence
    ``c <- (c * span + conf * dur) / (span + dur)`` is affine in ``c`` once the turn's start is known.
    """
    rows = aligned.withColumn("text", F.coalesce("text", F.lit("")))
    isl = turn_islands(rows, gap_ms)
    here = tx.strip("text")
    inside = F.col("turn") < F.col("ord")
    goes_on = F.col("nxt").isNotNull() & ~_breaks_turn(gap_ms)(F.col, lambda c: F.col(f"nxt.{c}"))
    left = F.when(inside, tx.seam_case(tx.strip("prev.text"), here, F.col("start_ms") - F.col("prev.end_ms"))).otherwise(here)
    right = F.when(goes_on, tx.seam_suffix(here, F.col("nxt.start_ms") - F.col("end_ms"))).otherwise(F.lit(""))
    span = F.greatest(F.lit(1), F.col("prev.end_ms") - F.col("opened.start_ms"))
    dur = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    keep = F.when(inside, span / (span + dur)).otherwise(F.lit(0.0))
    merged = affine_in_blocks(
        isl,
        ["meeting_id", "turn"],
        "ord",
        keep=keep,
        add=(1 - keep) * F.coalesce("confidence", F.lit(1.0)),
        parts=_block_parts(F.concat(left, right)),
        whole=_whole_parts(),
    )
    text = tx.normalize_turn(F.when(F.col("rows") == 1, F.col("raw")).otherwise(tx.cleanup_joined("joined")))
    return (
        merged.withColumn("text", text)
        .where(tx.is_meaningful("text"))
        .drop("joined", "raw")
        .withColumnsRenamed({"turn": "ord", "folded": "confidence"})
    )


def clean_segments(aligned: DataFrame, language: str = "ru", fillers: bool = True, repeats: bool = True, capitals: bool = True) -> DataFrame:
    """Artefact drop, filler and repeat removal, capitals; rows left with under three characters go."""
    text = tx.drop_artifacts(F.coalesce("text", F.lit("")))
    out = aligned.withColumn("text", text).where("text <> ''")
    if fillers:
        out = out.withColumn("text", tx.clean_fillers("text", language))
    if repeats:
        out = out.withColumn("text", tx.remove_repeats("text"))
    if capitals:
        out = out.withColumn("text", tx.capitalize_sentences("text"))
    return out.where(tx.is_meaningful("text"))


def merge_short(segments: DataFrame, short_ms: int = SHORT_MS, gap_ms: int = SHORT_GAP_MS) -> DataFrame:
    """A running segment shorter than ``short_ms`` absorbs the next one over a gap below ``gap_ms``."""
    grouped = greedy_groups(
        segments, surveyed(), ["start_ms", "end_ms"], lambda o, l, r: l[1] - o[0] < short_ms and r[0] - l[1] < gap_ms
    )
    return _fold_group(grouped)


def merge_adjacent(segments: DataFrame, pause_ms: int = ADJACENT_PAUSE_MS) -> DataFrame:
    """Merge while the pause is below ``pause_ms``."""
    isl = islands(segments, by_position(), ["start_ms", "end_ms"], lambda p, c: c("start_ms") - p("end_ms") >= pause_ms, name="group")
    return _fold_group(isl)


def _fold_group(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("meeting_id", "group").agg(
        F.min_by("start_ms", "ord").alias("start_ms"),
        F.max_by("end_ms", "ord").alias("end_ms"),
        joined_text(F.col("text"), "ord").alias("text"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("rows"),
    ).withColumnRenamed("group", "ord")


def words_to_segments(words: DataFrame, gap_ms: int = WORD_GAP_MS, span_ms: int = SEGMENT_SPAN_MS, order: str = "w_ord", ties: tuple[str, ...] = ()) -> DataFrame:
    """Break after sentence punctuation, after a long pause, or when the span would exceed ``span_ms``.

    ``order`` must tell words of a meeting apart; where it is a time that several share, ``ties`` names the columns that order those.
    """
    if ties:
        dense = dense_index(words, Timeline(("meeting_id",), (order, *ties), BLOCK_MS), "_at")
        return words_to_segments(dense, gap_ms, span_ms, "_at").drop("ord").withColumn("ord", F.col("start_ms"))
    flagged = words.withColumn("ends", F.col("word").rlike("[.!?…]$").cast("int"))
    grouped = greedy_groups(
        flagged,
        surveyed(order=order),
        ["start_ms", "end_ms", "ends"],
        lambda o, l, r: not l[2] and r[0] - l[1] <= gap_ms and r[1] - o[0] <= span_ms,
    )
    return grouped.groupBy("meeting_id", "group").agg(
        F.min_by("start_ms", order).alias("start_ms"),
        F.max_by("end_ms", order).alias("end_ms"),
        joined_text(F.col("word"), order).alias("text"),
        F.bround(F.avg("confidence"), 4).alias("confidence"),
        F.count("*").alias("n_words"),
    ).withColumnRenamed("group", "ord")


def pack_speech(regions: DataFrame, audio_ms: str = "audio_ms") -> DataFrame:
    """Speech regions to 15-22 s chunks; chunks over 30 s split equally, reading 1.5 s past the end."""

    def absorb(o, l, r):
        dur = l[1] - o[0]
        if dur == 0:
            return False
        return not (dur > CHUNK_TAIL_MS and (r[1] - o[0] > CHUNK_MAX_MS or dur > CHUNK_MIN_MS))

    grouped = greedy_groups(regions, surveyed(), ["start_ms", "end_ms"], absorb, empty=lambda r: r[0] == r[1])
    chunks = grouped.groupBy("meeting_id", "group").agg(
        F.min_by("start_ms", "ord").alias("s"), F.max_by("end_ms", "ord").alias("e"), F.max(audio_ms).alias("audio_ms")
    )
    dur = F.col("e") - F.col("s")
    # Only a zero-length or trailing group can be this short: both are discarded.
    kept = chunks.where(dur > CHUNK_TAIL_MS)
    parts = F.when(dur > CHUNK_LIMIT_MS, F.floor(dur / CHUNK_LIMIT_MS) + 1).otherwise(F.lit(1))
    cut = kept.select("meeting_id", "group", "s", "e", "audio_ms", parts.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"))
    start = F.col("s") + (F.col("e") - F.col("s")) * F.col("part") / F.col("n")
    end = F.col("s") + (F.col("e") - F.col("s")) * (F.col("part") + 1) / F.col("n")
    return cut.select(
        "meeting_id",
        F.col("group").alias("ord"),
        "part",
        start.alias("start_ms"),
        end.alias("end_ms"),
        F.least(end + READ_TAIL_MS, F.col("audio_ms").cast("double")).alias("read_end_ms"),
    )


def dedupe_chunk_overlap(chunks: DataFrame, max_words: int = OVERLAP_WORDS, min_words: int = MATCH_WORDS) -> DataFrame:
    """Strip words at a chunk's start that repeat the (already stripped) previous chunk's end.

    Input has ``words ARRAY<STRING>`` and ``text``.  How much is stripped from a row depends on how much was
    stripped from the row before, a number in 0..8.  Each row therefore is a small table "stripped before ->
    stripped here"; a row after a chunk of 16 or more words, or at a meeting's start, has a constant table and
    begins a new chain.  Tables compose along each chain.
    """
    edge = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~—–«»… "
    norm = F.transform("words", lambda w: F.trim(F.btrim(F.lower(w), F.lit(edge))))
    # All a row can show to its neighbours: 2*max_words words at each end.
    df = chunks.withColumns(
        {
            "n": F.size("words"),
            "head": F.slice(norm, 1, max_words),
            "tail": F.when(F.size("words") <= 2 * max_words, norm).otherwise(F.slice(norm, -2 * max_words, 2 * max_words)),
        }
    )
    chains = islands(df, by_position(), ["n", "tail"], lambda p, c: p("n") >= 2 * max_words, name="chain", prev="prev")

    def stripped(before: int) -> Column:
        left = F.greatest(F.lit(0), F.col("prev.n") - before)
        k = F.least(F.lit(max_words), left, F.col("n"))
        tail = F.col("prev.tail")
        options = F.filter(
            F.when(k >= min_words, F.sequence(k, F.lit(min_words), F.lit(-1))).otherwise(F.array().cast("array<int>")),
            lambda m: F.slice(tail, -m, m) == F.slice(F.col("head"), 1, m),
        )
        best = F.coalesce(F.get(options, F.lit(0)), F.lit(0))
        # The words must be found in the text in order, otherwise the chunk is left alone.
        pos = _end_of_words(F.col("text"), F.slice("words", 1, best))
        return F.when(F.col("prev").isNull() | (best == 0) | (pos < 0), F.lit(0)).otherwise(best)

    table = F.array(*[stripped(b) for b in range(max_words + 1)])
    chains = chains.withColumn("table", table).drop("prev")
    # Long chains (many short chunks in a row) are composed per block first.
    chains = chains.withColumn("_block", F.floor(F.col("ord") / CHAIN_BLOCK))
    ident = F.array(*[F.lit(i) for i in range(max_words + 1)])
    then = lambda first, second: F.transform(first, lambda i: F.element_at(second, i + 1))
    rows = F.array_sort(F.collect_list(F.struct("ord", "table")))
    per_block = chains.groupBy("meeting_id", "chain", "_block").agg(F.aggregate(rows, ident, lambda acc, x: then(acc, x["table"])).alias("block_table"))
    upto = Window.partitionBy("meeting_id", "chain").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    entry = per_block.withColumn(
        "enter",
        F.coalesce(F.element_at(F.aggregate(F.collect_list("block_table").over(upto), ident, then), 1), F.lit(0)),
    ).drop("block_table")
    inside = Window.partitionBy("meeting_id", "chain", "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    applied = chains.join(entry, ["meeting_id", "chain", "_block"]).withColumn(
        "cut", F.aggregate(F.collect_list("table").over(inside), F.col("enter"), lambda acc, tb: F.element_at(tb, acc + 1))
    )
    end = _end_of_words(F.col("text"), F.slice("words", 1, F.col("cut")))
    text = F.when(F.col("cut") > 0, F.ltrim(F.substr("text", end + 1), F.lit(" \t,.;:!?-—–"))).otherwise(F.col("text"))
    return applied.withColumns({"text": text, "words": F.slice("words", F.col("cut") + 1, F.greatest(F.lit(0), F.col("n") - F.col("cut")))}).drop(
        "n", "head", "tail", "table", "chain", "_block", "enter"
    )


def _end_of_words(text: Column, words: Column) -> Column:
    """Characters consumed when the words are found one after another, -1 when one is missing."""
    step = lambda pos, w: F.when((pos < 0) | (w == ""), pos).otherwise(
        F.when(_find(text, w, pos) > 0, _find(text, w, pos) - 1 + F.length(w)).otherwise(F.lit(-1))
    )
    return F.aggregate(words, F.lit(0), step)


def batch_by_chars(aligned: DataFrame, limit: int = BATCH_CHARS) -> DataFrame:
    """Batches of at most ``limit`` characters; a batch's first row is always accepted."""
    sized = running_totals(aligned.withColumn("n_chars", F.length(tx.strip("text")).cast("long")), by_position(), {"chars_upto": F.col("n_chars")})
    sized = sized.withColumn("chars_before", F.col("chars_upto") - F.col("n_chars"))
    return greedy_groups(sized, surveyed(), ["chars_before", "chars_upto"], lambda o, l, r: r[1] - o[0] <= limit, name="batch").drop("chars_upto", "chars_before")


def word_chunks(text: Column, size: int = 200) -> Column:
    """Fixed-size word chunks of one text."""
    ws = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ws) - 1), F.lit(size)), lambda i: i < F.size(ws))
    return F.transform(starts, lambda i: F.array_join(F.slice(ws, i + 1, F.lit(size)), " "))


def longest_turn(aligned: DataFrame, min_ms: int = SAMPLE_MIN_MS) -> DataFrame:
    """Each speaker's longest segment of at least ``min_ms``, the first on ties."""
    dur = F.col("end_ms") - F.col("start_ms")
    best = F.max_by(F.struct("ord", "start_ms", "end_ms"), F.struct(dur, -F.col("ord")))
    return aligned.where((dur >= min_ms) & (F.col("speaker_id") != "")).groupBy("meeting_id", "speaker_id").agg(best.alias("b")).select("meeting_id", "speaker_id", "b.*")


def first_samples(aligned: DataFrame, n: int = 3, min_chars: int = 1, cut: Column | None = None) -> DataFrame:
    """The first ``n`` texts per speaker.  The rank filter is applied map-side before the shuffle."""
    t = aligned.withColumn("sample", tx.strip(F.coalesce("text", F.lit("")))).where(F.length("sample") >= min_chars)
    w = Window.partitionBy("meeting_id", "speaker_id").orderBy("ord")
    ranked = t.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return ranked.select("meeting_id", "speaker_id", "rn", (F.col("sample") if cut is None else cut).alias("sample"))


def shortened(max_chars: int, keep: int, tail: str) -> Column:
    return F.when(F.length("sample") > max_chars, F.concat(F.substring("sample", 1, keep), F.lit(tail))).otherwise(F.col("sample"))


def display_label() -> Column:
    return tx.strip(F.when(F.coalesce("speaker_name", F.lit("")) != "", F.col("speaker_name")).otherwise(F.coalesce("speaker_id", F.lit(""))))


def labels_first_seen(aligned: DataFrame) -> DataFrame:
    """Distinct labels with the position of their first appearance."""
    return aligned.withColumn("label", display_label()).where("label <> ''").groupBy("meeting_id", "label").agg(F.min("ord").alias("first_ord"))


def carry_speakers(rows: DataFrame) -> DataFrame:
    """Blank speaker cells repeat the last one; leading blanks are UNKNOWN; rows without text go."""
    named = fill(rows, by_position(keys=("recording_id",)), forward={"carried": F.when(tx.strip("speaker") != "", tx.strip("speaker"))})
    return named.where(tx.strip("text") != "").withColumn("speaker", F.coalesce("carried", F.lit("UNKNOWN"))).drop("carried")


def interpolate_times(turns: DataFrame, total_ms: Column) -> DataFrame:
    """Times of unmatched turns between their nearest matched neighbours."""
    tl = by_position(keys=("recording_id",), order="turn")
    f = fill(turns, tl, forward={"prev_end": F.col("end_ms")}, backward={"next_start": F.col("start_ms")})
    p, n = F.col("prev_end"), F.col("next_start")
    mid = (p + n) / 2
    missing = F.col("start_ms").isNull()
    start = F.when(p.isNull() & n.isNull(), F.lit(0.0)).when(p.isNull(), F.greatest(F.lit(0), n - 500)).when(n.isNull(), p).otherwise(F.greatest(p, mid - 250))
    end = F.when(p.isNull() & n.isNull(), total_ms).when(p.isNull(), n).when(n.isNull(), F.least(total_ms, p + 500)).otherwise(F.least(n, mid + 250))
    return f.select(
        *[c for c in turns.columns if c not in ("start_ms", "end_ms")],
        F.when(missing, start).otherwise(F.col("start_ms")).cast("double").alias("start_ms"),
        F.when(missing, end).otherwise(F.col("end_ms")).cast("double").alias("end_ms"),
        F.when(missing, "interpolated").otherwise("aligned").alias("status"),
    )


def clip_turns(turns: DataFrame, total_ms: Column) -> DataFrame:
    """End at the next start, at least 50 ms long, inside the recording."""
    tl = Timeline(("recording_id",), ("start_ms", "turn"), BLOCK_MS)
    nxt = neighbours(turns, tl, ["start_ms"], prev=None, following="nxt")
    end = F.least("end_ms", F.coalesce("nxt.start_ms", "end_ms"))
    end = F.greatest(end, F.col("start_ms") + 50)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(total_ms, c))
    return nxt.withColumns({"end_ms": clamp(end), "start_ms": clamp(F.col("start_ms"))}).drop("nxt")


def indexed_lines(aligned: DataFrame, fallback: str = "Говорящий") -> DataFrame:
    """Dense index over non-empty turns and the line ``[i] speaker: text``."""
    kept = aligned.withColumn("text", tx.strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    idx = dense_index(kept, by_position())
    who = F.when(F.coalesce("speaker_name", F.lit("")) != "", F.col("speaker_name")).when(F.coalesce("speaker_id", F.lit("")) != "", F.col("speaker_id")).otherwise(fallback)
    return idx.withColumn("line", F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), who, F.lit(": "), F.col("text")))


def recall_windows(aligned: DataFrame, window_minutes: int = 12, max_windows: int = 12) -> DataFrame:
    """At most ``max_windows`` windows over a meeting, overlapping by up to a minute; windows that no segment touches are left out."""
    span = aligned.groupBy("meeting_id").agg(F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))
    dur = F.greatest(F.lit(0), F.col("last_ms") - F.col("first_ms"))
    width = F.greatest(F.lit(max(300, max(1, window_minutes) * 60) * 1000), F.ceil(dur / (1000 * max(1, max_windows))) * 1000).cast("long")
    wins = (
        span.where(dur > 0)
        .withColumn("width_ms", width)
        .withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(max_windows - 1), F.ceil(dur / width) - 1).cast("long"))))
    )
    cursor = F.col("first_ms") + F.col("win") * F.col("width_ms")
    overlap = F.least(F.lit(60_000.0), F.col("width_ms") * 0.1)
    laid = wins.select(
        "meeting_id",
        "win",
        F.greatest(F.col("first_ms"), cursor - F.when(F.col("win") > 0, overlap).otherwise(0)).cast("long").alias("start_ms"),
        F.least(F.col("last_ms"), cursor + F.col("width_ms")).alias("end_ms"),
    )
    touched = window_members(laid, aligned).select("meeting_id", "win").distinct()
    return laid.join(touched, ["meeting_id", "win"], "left_semi")


def header_flags(aligned: DataFrame) -> DataFrame:
    """True where the speaker differs from the row before."""
    out = neighbours(aligned, by_position(), ["speaker_id"], prev="prev")
    return out.withColumn("new_speaker", ~F.col("prev.speaker_id").eqNullSafe(F.col("speaker_id")) | F.col("prev").isNull()).drop("prev")


def order_flags(aligned: DataFrame) -> DataFrame:
    """Starts before the previous end; ends before its own start."""
    out = neighbours(aligned, by_position(), ["end_ms"], prev="prev")
    return out.withColumns(
        {"out_of_order": F.coalesce(F.col("start_ms") < F.col("prev.end_ms"), F.lit(False)), "inverted": F.col("end_ms") < F.col("start_ms")}
    ).drop("prev")


def phrase_context(aligned: DataFrame, phrases: list[str], before: int = 2, after: int = 3) -> DataFrame:
    """Rows holding any phrase plus their neighbours; positions are dense, so context is arithmetic."""
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains("text", F.lit(p))
    idx = dense_index(aligned, by_position())
    near = idx.where(hit).select("meeting_id", F.explode(F.sequence(F.col("idx") - before, F.col("idx") + after)).alias("idx"))
    return idx.join(near.distinct(), ["meeting_id", "idx"], "left_semi")


def _sentence_slices(text: Column) -> Column:
    """Character ranges between sentence ends with their stripped text; blank ranges are left out."""
    ends = F.split(F.regexp_replace(text, "(?U)([.!?]+[\"')\\]»]?\\s+)", "$1\ue000"), "\ue000")
    bounds = F.aggregate(
        ends,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,t:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x)).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), (acc["at"] + F.length(x)).alias("b"), tx.strip(x).alias("t")))).alias("out"),
        ),
    )["out"]
    return F.filter(bounds, lambda s: s["t"] != "")


def _located_words(text: Column, words: Column) -> Column:
    """Words with the character range at which each is found, searching left to right; missing ones are left out."""
    kind = "array<struct<a:int,b:int,s:double,e:double>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, w: Column) -> Column:
        tok = tx.strip(w["word"])
        hit = F.when(tok != "", _find(text, tok, acc["at"])).otherwise(F.lit(0))
        found = F.struct((hit - 1).alias("a"), (hit - 1 + F.length(tok)).alias("b"), w["start_ms"].cast("double").alias("s"), w["end_ms"].cast("double").alias("e"))
        return F.when(hit > 0, F.struct((hit - 1 + F.length(tok)).alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))).otherwise(acc)

    return F.aggregate(words, start, step)["out"]


def split_by_sentences(segments: DataFrame, words: str | None = None) -> DataFrame:
    """Segments of 6 s or more cut after sentence ends.

    A piece's times come from the words found in it (``words`` names an array of word structs), otherwise from its
    share of the characters.  Pieces under 0.4 s are glued to the piece before, which only looks back: a fold over
    one row's pieces.
    """
    text, dur = F.col("text"), F.col("end_ms") - F.col("start_ms")
    n = F.greatest(F.lit(1), F.length(text))
    at = lambda c: F.col("start_ms") + dur * c / n
    piece = "array<struct<s:double,e:double,t:string>>"
    df = segments.withColumn("_slices", _sentence_slices(text))
    df = df.withColumn("_found", _located_words(text, F.col(words)) if words else F.array().cast("array<struct<a:int,b:int,s:double,e:double>>"))

    def times(x: Column) -> tuple[Column, Column]:
        mine = F.filter("_found", lambda w: (w["a"] < x["b"]) & (w["b"] > x["a"]))
        s, e = F.array_min(F.transform(mine, lambda w: w["s"])), F.array_max(F.transform(mine, lambda w: w["e"]))
        # Words without a usable span fall back to the whole segment's bounds.
        usable = F.coalesce(e > s, F.lit(False))
        if not words:
            return at(x["a"]), at(x["b"])
        whole = (F.size(F.col(words)) > 0) & (dur > 0)
        return (
            F.when(usable, s).when(whole, F.col("start_ms").cast("double")).otherwise(at(x["a"])),
            F.when(usable, e).when(whole, F.col("end_ms").cast("double")).otherwise(at(x["b"])),
        )

    def glue(acc: Column, x: Column) -> Column:
        s, e = times(x)
        last = F.element_at(acc, -1)
        merged = F.struct(last["s"].alias("s"), F.greatest(last["e"], e, last["s"]).alias("e"), F.concat_ws(" ", last["t"], x["t"]).alias("t"))
        short = ((e - s) < MIN_PIECE_MS) & (F.size(acc) > 0)
        return F.when(short, F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(merged))).otherwise(
            F.concat(acc, F.array(F.struct(s.cast("double").alias("s"), e.cast("double").alias("e"), x["t"].alias("t"))))
        )

    pieces = F.aggregate("_slices", F.array().cast(piece), glue)
    whole = F.array(F.struct(F.col("start_ms").cast("double").alias("s"), F.col("end_ms").cast("double").alias("e"), text.alias("t")))
    chosen = F.when((dur < SENTENCE_SPLIT_MS) | (F.size("_slices") <= 1), whole).otherwise(pieces)
    out = df.withColumn("_p", chosen).select(*segments.columns, F.size("_p").alias("_n"), F.posexplode("_p").alias("piece", "_x"))
    first, last = F.col("piece") == 0, F.col("piece") == F.col("_n") - 1
    s = F.when(first, F.col("start_ms").cast("double")).otherwise(F.greatest(F.col("start_ms").cast("double"), F.col("_x.s")))
    e = F.when(last, F.col("end_ms").cast("double")).otherwise(F.least(F.col("end_ms").cast("double"), F.col("_x.e")))
    return out.withColumns({"_s": s, "_e": e}).select(
        *[c for c in segments.columns if c not in ("start_ms", "end_ms", "text")],
        "piece",
        F.col("_s").alias("start_ms"),
        F.greatest("_s", "_e").alias("end_ms"),
        F.col("_x.t").alias("text"),
    )


def split_by_diarization(segments: DataFrame, diarization: DataFrame) -> DataFrame:
    """Segments of 1.2 s or more cut at speaker runs, text cut near the proportional character.

    Runs of one segment are a short array in its row; the cut positions are computed from it in order.
    """
    long_enough = segments.where(F.col("end_ms") - F.col("start_ms") >= SPLIT_MIN_MS)
    runs = speaker_runs(long_enough.select("meeting_id", "ord", "start_ms", "end_ms"), diarization)
    arr = runs.groupBy("meeting_id", F.col("seg_ord").alias("ord")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("speaker_id").alias("sp")))).alias("runs")
    )
    df = segments.join(arr, ["meeting_id", "ord"], "left")
    changes = F.size(F.array_distinct(F.transform("runs", lambda r: r["sp"]))) > 1
    cuts = F.transform("runs", lambda r, i: F.when(i == F.size("runs") - 1, F.length("text")).otherwise(tx.cut_near(F.col("text"), F.col("start_ms"), F.col("end_ms"), r["e"])))
    df = df.withColumn("cuts", F.when(changes, cuts))
    from_ = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1))
    pieces = F.filter(
        F.transform(
            "runs",
            lambda r, i: F.struct(
                F.greatest(F.col("start_ms"), r["s"]).alias("s"),
                F.least(F.col("end_ms"), r["e"]).alias("e"),
                tx.strip(F.substr("text", from_(i) + 1, F.greatest(F.lit(0), F.get("cuts", i) - from_(i)))).alias("t"),
            ),
        ),
        lambda p: p["t"] != "",
    )
    whole = F.array(F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("text").alias("t")))
    df = df.withColumn("_p", F.when(F.col("cuts").isNotNull(), pieces)).withColumn("_p", F.when(F.coalesce(F.size("_p"), F.lit(0)) <= 1, whole).otherwise(F.col("_p")))
    out = df.select(*segments.columns, F.size("_p").alias("_n"), F.posexplode("_p").alias("piece", "_x"))
    return out.select(
        *[c for c in segments.columns if c not in ("start_ms", "end_ms", "text")],
        "piece",
        F.when(F.col("piece") == 0, F.col("start_ms")).otherwise(F.col("_x.s")).alias("start_ms"),
        F.when(F.col("piece") == F.col("_n") - 1, F.col("end_ms")).otherwise(F.col("_x.e")).alias("end_ms"),
        F.col("_x.t").alias("text"),
    )


def split_words_by_diarization(segments: DataFrame, words: DataFrame, diarization: DataFrame) -> DataFrame:
    """W12 with word times: a run's text is the words whose midpoint it holds."""
    from parlance.operators.intervals import words_into_runs

    long_enough = segments.where(F.col("end_ms") - F.col("start_ms") >= SPLIT_MIN_MS)
    runs = speaker_runs(long_enough.select("meeting_id", "ord", "start_ms", "end_ms"), diarization)
    key = ["meeting_id", "ord"]
    spoken = (
        words_into_runs(words.where(tx.strip("word") != ""), runs)
        .groupBy("meeting_id", F.col("seg_ord").alias("ord"), "run_start", "run_end", "run_speaker")
        .agg(joined_text(tx.strip("word"), "w_pos").alias("t"))
    )
    arr = spoken.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("run_start").alias("s"), F.col("run_end").alias("e"), "t"))).alias("_p"))
    changed = runs.groupBy("meeting_id", F.col("seg_ord").alias("ord")).agg(F.count_distinct("speaker_id").alias("n_sp"))
    whole = F.array(F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("text").alias("t")))
    df = segments.join(arr, key, "left").join(changed, key, "left")
    df = df.withColumn("_p", F.when((F.col("n_sp") > 1) & (F.size("_p") > 1), F.col("_p")).otherwise(whole))
    out = df.select(*segments.columns, F.size("_p").alias("_n"), F.posexplode("_p").alias("piece", "_x"))
    s, e = F.greatest("start_ms", "_x.s"), F.least("end_ms", "_x.e")
    return out.select(
        *[c for c in segments.columns if c not in ("start_ms", "end_ms", "text")],
        "piece",
        F.when(F.col("piece") == 0, F.col("start_ms")).otherwise(s).alias("start_ms"),
        F.when(F.col("piece") == F.col("_n") - 1, F.col("end_ms")).otherwise(e).alias("end_ms"),
        F.col("_x.t").alias("text"),
    )


def editor_split(aligned: DataFrame, commands: DataFrame) -> DataFrame:
    """Split commanded rows near the middle at the best marker; time by character ratio."""
    t = tx.strip("text")
    n = F.length(t)
    mid = F.floor(n / 2).cast("int")
    win = F.greatest(F.lit(12), F.floor(n * 0.25).cast("int"))
    lo, hi = F.greatest(F.lit(1), mid - win), F.least(n - 1, mid + win)

    def best(marker: str) -> Column:
        k = len(marker)
        at = F.filter(F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(t, i + 1, F.lit(k)) == marker)
        # A later hit replaces the cut only when it is nearer the middle than the cut itself.
        return F.aggregate(at, F.lit(-1), lambda b, i: F.when((b < 0) | (F.abs(i - mid) < F.abs(b - mid)), i + k).otherwise(b))

    cut = mid
    for m in reversed([". ", "? ", "! ", "; ", ", ", " "]):
        cut = F.when(best(m) > 0, best(m)).otherwise(cut)
    df = aligned.join(commands.select("meeting_id", "ord", F.lit(True).alias("_cmd")), ["meeting_id", "ord"], "left").withColumn("_cut", F.when(F.col("_cmd") & (n >= 8), cut))
    left, right = tx.strip(F.substr(t, F.lit(1), F.col("_cut"))), tx.strip(F.substr(t, F.col("_cut") + 1))
    df = df.withColumns({"_l": left, "_r": right})
    ok = F.col("_cut").isNotNull() & (F.col("_l") != "") & (F.col("_r") != "")
    ratio = F.length("_l") / (F.length("_l") + F.length("_r"))
    at = F.col("start_ms") + F.greatest(F.lit(20), F.col("end_ms") - F.col("start_ms")) * ratio
    row = lambda s, e, x: F.struct(s.cast("double").alias("s"), e.cast("double").alias("e"), x.alias("t"))
    parts = F.when(ok, F.array(row(F.col("start_ms"), at, F.col("_l")), row(at, F.col("end_ms"), F.col("_r")))).otherwise(
        F.array(row(F.col("start_ms"), F.col("end_ms"), F.col("text")))
    )
    keep = [c for c in aligned.columns if c not in ("start_ms", "end_ms", "text")]
    return df.select(*keep, F.posexplode(parts).alias("piece", "_x")).select(*keep, "piece", F.col("_x.s").alias("start_ms"), F.col("_x.e").alias("end_ms"), F.col("_x.t").alias("text"))


def editor_merge(aligned: DataFrame, commands: DataFrame) -> DataFrame:
    """Merge each commanded row into the row before it."""
    cmd = aligned.join(commands.select("meeting_id", "ord", F.lit(True).alias("_cmd")), ["meeting_id", "ord"], "left")
    isl = islands(cmd, by_position(), ["_cmd"], lambda p, c: ~F.coalesce(c("_cmd"), F.lit(False)), name="group")
    conf = F.coalesce("confidence", F.lit(1.0))
    return isl.groupBy("meeting_id", "group").agg(
        F.min_by("start_ms", "ord").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.when(F.count("*") > 1, tx.strip(joined_text(tx.strip("text"), "ord"))).otherwise(F.first("text")).alias("text"),
        F.min_by("speaker_id", "ord").alias("speaker_id"),
        F.min(conf).alias("confidence"),
        F.when(F.count("attribution_confidence") == F.count("*"), F.min("attribution_confidence")).alias("attribution_confidence"),
    ).withColumnRenamed("group", "ord")


def _find(text: Column, word: Column, after: Column) -> Column:
    """1-based position of ``word`` in ``text`` at or after 0-based ``after``, 0 when absent."""
    hit = F.call_function("locate", word, F.substr(text, after + 1))
    return F.when(hit > 0, hit + after).otherwise(F.lit(0))
