"""Interval operators: overlap joins, speaker attribution, nearest fallback, window membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordered import BLOCK_MS, Timeline, by_time, fill, islands, neighbours
from parlance.session import cut

# Fixed values of the attribution rules (milliseconds and ratios).
OVERLAP_SHARE = 0.10
CONTESTED_CAP = 0.55
MIN_CROSS_TALK_MS = 50
ATOMIC_MIN_MS = 10
RUN_MERGE_GAP_MS = 120
RUN_MIN_MS = 250
DEFAULT_SPEAKER = "speaker_0"

BUCKET_MS = 10_000


def ordered_bounds(df: DataFrame) -> DataFrame:
    """Swap inverted start/end."""
    return df.withColumns({"start_ms": F.least("start_ms", "end_ms"), "end_ms": F.greatest("start_ms", "end_ms")})


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width)))


def interval_join(
    left: DataFrame, right: DataFrame, keys: list[str], lcols: tuple[str, str], rcols: tuple[str, str], width: int = BUCKET_MS, points: bool = False
) -> DataFrame:
    """Every pair with the same ``keys`` whose half-open intervals intersect, each exactly once.

    Both sides are cut into time buckets so the shuffle key is ``(keys, bucket)``: a long meeting spreads
    over many tasks.  A pair is kept only in the bucket where its intersection begins.  With ``points``, an interval of no length inside another
    meets it too (``left start < right end`` and ``right start < left end``).
    """
    ls, le = lcols
    rs, re_ = rcols
    lb = left.withColumn("_bucket", _buckets(F.col(ls), F.col(le), width))
    rb = right.withColumn("_bucket", _buckets(F.col(rs), F.col(re_), width))
    joined = lb.join(rb, [*keys, "_bucket"], "inner")
    begins = F.greatest(ls, rs)
    meets = (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) if points else begins < F.least(le, re_)
    return joined.where(meets & (F.floor(begins / width) == F.col("_bucket"))).drop("_bucket")


def overlap_join(segments: DataFrame, diarization: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """Segment x diarisation row of one meeting with the shared milliseconds ``overlap_ms`` (> 0)."""
    d = diarization.select(
        "meeting_id",
        F.col("d_ord"),
        F.col("speaker_id").alias("d_speaker"),
        F.col("start_ms").alias("d_start"),
        F.col("end_ms").alias("d_end"),
        *[F.col(c).alias(f"d_{c}") for c in ("speaker_name", "is_overlap") if c in diarization.columns],
    )
    pairs = interval_join(segments, d, ["meeting_id"], ("start_ms", "end_ms"), ("d_start", "d_end"), width)
    return pairs.withColumn("overlap_ms", F.least("end_ms", "d_end") - F.greatest("start_ms", "d_start"))


def attribute(pairs: DataFrame, key: tuple[str, ...] = ("meeting_id", "ord")) -> DataFrame:
    """J2 + J4: winner by total overlap (earliest first-seen row on ties), confidence, talk-over cap."""
    named = F.col("d_speaker_name").isNotNull() & (F.col("d_speaker_name") != "")
    per = pairs.groupBy(*key, "d_speaker").agg(
        F.sum("overlap_ms").alias("ov"),
        F.min("d_ord").alias("first_seen"),
        F.min_by("d_speaker_name", F.when(named, F.col("d_ord"))).alias("name"),
        F.sum(F.when(F.col("d_is_overlap"), F.col("overlap_ms")).otherwise(0)).alias("talk_over"),
    )
    best = F.max_by(F.struct("d_speaker", "name", "ov"), F.struct(F.col("ov"), -F.col("first_seen")))
    won = per.groupBy(*key).agg(best.alias("b"), F.sum("ov").alias("total"), F.sum("talk_over").alias("talk_over"))
    raw = F.bround(F.col("b.ov") / F.col("total"), 3)
    capped = F.when(F.col("talk_over") / F.col("total") >= OVERLAP_SHARE, F.least(raw, F.lit(CONTESTED_CAP))).otherwise(raw)
    return won.select(
        *key,
        F.col("b.d_speaker").alias("speaker_id"),
        F.col("b.name").alias("speaker_name"),
        F.col("b.ov").alias("win_ms"),
        F.col("total").alias("total_ms"),
        F.col("talk_over").alias("talk_over_ms"),
        capped.alias("attribution_confidence"),
    )


def nearest_speaker(unmatched: DataFrame, diarization: DataFrame) -> DataFrame:
    """The diarisation row whose midpoint is nearest, earliest row on ties.

    Segments and rows are merged on one doubled-midpoint axis; the nearest row is the last one at or before or
    the first one at or after the segment, so no segment is compared with a whole meeting.
    """
    cand = (
        diarization.groupBy("meeting_id", (F.col("start_ms") + F.col("end_ms")).alias("mid2"))
        .agg(F.min(F.struct("d_ord", "speaker_id", "speaker_name")).alias("row"))
        .select("meeting_id", "mid2", F.lit(-1).cast("long").alias("ord"), F.struct("mid2", F.col("row.*")).alias("cand"))
    )
    seg = unmatched.select("meeting_id", (F.col("start_ms") + F.col("end_ms")).alias("mid2"), F.col("ord").cast("long").alias("ord"))
    axis = cand.unionByName(seg, allowMissingColumns=True)
    tl = Timeline(("meeting_id",), ("mid2", "ord"), 2 * BLOCK_MS)
    filled = fill(axis, tl, forward={"below": F.col("cand")}, backward={"above": F.col("cand")}).where("ord >= 0")
    dist = lambda s: F.abs(F.col(f"{s}.mid2") - F.col("mid2"))
    take_below = F.col("above").isNull() | (dist("below") < dist("above")) | (
        (dist("below") == dist("above")) & (F.col("below.d_ord") < F.col("above.d_ord"))
    )
    pick = F.when(F.col("below").isNotNull() & take_below, F.col("below")).otherwise(F.col("above"))
    return filled.withColumn("pick", pick).where("pick is not null").select(
        "meeting_id", "ord", F.col("pick.speaker_id").alias("speaker_id"), F.col("pick.speaker_name").alias("speaker_name"), F.col("pick.d_ord").alias("d_ord")
    )


def align(segments: DataFrame, diarization: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """Who said what: J1-J5 for every segment; meetings without diarisation get the default speaker."""
    seg = ordered_bounds(segments)
    # A narrow table read three times below: staged instead of joining the intervals three times.
    won = cut(attribute(overlap_join(seg.select("meeting_id", "ord", "start_ms", "end_ms"), diarization, width)))
    joined = seg.join(won.select("meeting_id", "ord", "speaker_id", "speaker_name", "attribution_confidence"), ["meeting_id", "ord"], "left")
    near = nearest_speaker(seg.select("meeting_id", "ord", "start_ms", "end_ms").join(won.select("meeting_id", "ord"), ["meeting_id", "ord"], "left_anti"), diarization)
    near = near.select("meeting_id", "ord", F.col("speaker_id").alias("near_id"), F.col("speaker_name").alias("near_name"))
    return (
        joined.join(near, ["meeting_id", "ord"], "left")
        .withColumn("speaker_name", F.when(F.col("speaker_id").isNotNull(), F.col("speaker_name")).otherwise(F.col("near_name")))
        .withColumn("speaker_id", F.coalesce("speaker_id", "near_id", F.lit(DEFAULT_SPEAKER)))
        .drop("near_id", "near_name")
    )


def default_when_undiarised(segments: DataFrame, diarization: DataFrame) -> DataFrame:
    """Segments of meetings without any diarisation row, given the default speaker and no confidence."""
    meetings = diarization.select("meeting_id").distinct()
    return ordered_bounds(segments.join(meetings, "meeting_id", "left_anti")).withColumns(
        {"speaker_id": F.lit(DEFAULT_SPEAKER), "attribution_confidence": F.lit(None).cast("double")}
    )


def mark_overlaps(diarization: DataFrame, min_overlap_ms: int = MIN_CROSS_TALK_MS, width: int = BUCKET_MS) -> DataFrame:
    """Flag a row when a different speaker shares at least ``min_overlap_ms`` with it."""
    cols = ["meeting_id", "d_ord", "speaker_id", "start_ms", "end_ms"]
    a = diarization.select(*cols)
    b = a.select("meeting_id", *[F.col(c).alias(f"o_{c}") for c in cols[1:]])
    pairs = interval_join(a, b, ["meeting_id"], ("start_ms", "end_ms"), ("o_start_ms", "o_end_ms"), width)
    hit = pairs.where(
        (F.col("speaker_id") != F.col("o_speaker_id"))
        & (F.least("end_ms", "o_end_ms") - F.greatest("start_ms", "o_start_ms") >= min_overlap_ms)
    )
    flagged = hit.select("meeting_id", "d_ord").distinct().withColumn("_hit", F.lit(True))
    return (
        diarization.join(flagged, ["meeting_id", "d_ord"], "left")
        .withColumn("is_overlap", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def words_into_runs(words: DataFrame, runs: DataFrame) -> DataFrame:
    """A word belongs to the run of its segment that holds its midpoint, ``[start, end)``."""
    r = runs.select("meeting_id", "seg_ord", "run_no", F.col("start_ms").alias("run_start"), F.col("end_ms").alias("run_end"), F.col("speaker_id").alias("run_speaker"))
    mid2 = F.col("start_ms") + F.col("end_ms")
    return words.join(r, ["meeting_id", "seg_ord"]).where((mid2 >= 2 * F.col("run_start")) & (mid2 < 2 * F.col("run_end")))


def cross_source(anchor: DataFrame, *others: tuple[str, DataFrame], width: int = 60_000) -> DataFrame:
    """For every anchor turn, the ordered overlapping turns of each other source (empty array if none)."""
    out = anchor
    key = ["meeting_id", "ord"]
    for name, src in others:
        o = src.select("meeting_id", F.col("ord").alias("o_ord"), F.col("start_ms").alias("o_start"), F.col("end_ms").alias("o_end"), F.col("text").alias("o_text"))
        hits = interval_join(anchor.select(*key, "start_ms", "end_ms"), o, ["meeting_id"], ("start_ms", "end_ms"), ("o_start", "o_end"), width, points=True)
        got = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o_ord", "o_start", "o_end", "o_text"))).alias(name))
        out = out.join(got, key, "left").withColumn(name, F.coalesce(name, F.array().cast(got.schema[name].dataType)))
    return out


def window_members(windows: DataFrame, segments: DataFrame, width: int = 300_000) -> DataFrame:
    """Segments touching a window (``end > window start`` and ``start < window end``)."""
    w = windows.select("meeting_id", "win", F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"))
    return interval_join(segments, w, ["meeting_id"], ("start_ms", "end_ms"), ("w_start", "w_end"), width, points=True)


def topic_slices(turns: DataFrame, topics: DataFrame, block: int = 256) -> DataFrame:
    """Turns whose dense index lies in a topic's inclusive range.

    Negative, inverted and nameless topics are dropped, then indices are clamped to the last turn.  The range is
    matched through index blocks, so the join key is ``(meeting, block)``.
    """
    last = turns.groupBy("meeting_id").agg(F.max("idx").alias("last_idx"))
    t = (
        topics.join(last, "meeting_id")
        .where((F.trim(F.coalesce("name", F.lit(""))) != "") & (F.col("start_idx") >= 0) & (F.col("end_idx") >= F.col("start_idx")))
        .withColumns({"start_idx": F.least("start_idx", "last_idx"), "end_idx": F.least("end_idx", "last_idx")})
        .withColumn("_ib", F.explode(F.sequence(F.floor(F.col("start_idx") / block), F.floor(F.col("end_idx") / block))))
        .drop("last_idx")
    )
    keyed = turns.withColumn("_ib", F.floor(F.col("idx") / block))
    return keyed.join(t, ["meeting_id", "_ib"]).where("idx between start_idx and end_idx").drop("_ib")


def speaker_runs(segments: DataFrame, diarization: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """Dominant-speaker runs inside every segment.

    All steps are keyed by ``(meeting_id, seg_ord)``: boundaries of the clipped rows cut the segment into atomic
    pieces, each piece takes its widest speaker, neighbours of one speaker merge over short gaps.
    """
    key = ["meeting_id", "seg_ord"]
    seg = segments.select("meeting_id", F.col("ord").alias("seg_ord"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    d = diarization.select("meeting_id", "d_ord", "speaker_id", F.col("start_ms").alias("ds"), F.col("end_ms").alias("de"))
    clipped = (
        interval_join(seg, d, ["meeting_id"], ("s", "e"), ("ds", "de"), width)
        .withColumns({"cs": F.greatest("s", "ds"), "ce": F.least("e", "de")})
        .select(*key, "s", "e", "d_ord", "speaker_id", "cs", "ce")
    )
    # A segment's own rows are bounded by its length, so its boundary list is a small array in its row.
    per_seg = clipped.groupBy(*key, "s", "e").agg(
        F.array_sort(F.collect_list(F.struct("d_ord", "speaker_id", "cs", "ce"))).alias("rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("s", "e", "cs", "ce"))))).alias("pts"),
    )
    atoms = per_seg.select(
        *key,
        "rows",
        F.posexplode(
            F.expr("filter(transform(sequence(1, size(pts) - 1), i -> struct(pts[i-1] as a, pts[i] as b)), p -> p.b - p.a >= %d)" % ATOMIC_MIN_MS)
        ).alias("atom", "p"),
    )
    hits = atoms.select(*key, "atom", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.explode("rows").alias("r")).where("r.cs <= a and r.ce >= b")
    per = hits.groupBy(*key, "atom", "a", "b", "r.speaker_id").agg(F.count("*").alias("n"), F.min("r.d_ord").alias("first_seen"))
    best = per.groupBy(*key, "atom", "a", "b").agg(
        F.max_by("speaker_id", F.struct(F.col("n"), -F.col("first_seen"))).alias("speaker_id")
    )
    tl = Timeline(("meeting_id", "seg_ord"), ("a",), BLOCK_MS)
    runs = islands(
        best,
        tl,
        ["speaker_id", "a", "b"],
        lambda p, c: (p("speaker_id") != c("speaker_id")) | (c("a") - p("b") > RUN_MERGE_GAP_MS),
        name="run",
    )
    return (
        runs.groupBy(*key, "run")
        .agg(F.min("a").alias("start_ms"), F.max("b").alias("end_ms"), F.first("speaker_id").alias("speaker_id"))
        .where(F.col("end_ms") - F.col("start_ms") >= RUN_MIN_MS)
        .select(*key, F.col("run").alias("run_no"), "start_ms", "end_ms", "speaker_id")
    )


def gap_series(diarization: DataFrame) -> DataFrame:
    """Gap to the next row by start, per meeting."""
    out = neighbours(diarization, by_time(order=("start_ms", "d_ord")), ["start_ms"], prev=None, following="nxt")
    return out.withColumn("gap_ms", F.col("nxt.start_ms") - F.col("end_ms")).drop("nxt")


def first_turn_offset(anchor: DataFrame, other: DataFrame, low_ms: int = 30_000, high_ms: int = 3_600_000) -> DataFrame:
    """P10: offset between the first turns of two sources, used only inside ``[low, high]``."""
    first = lambda df, n: df.groupBy("meeting_id").agg(F.min_by("start_ms", "ord").alias(n))
    delta = F.col("a0") - F.col("o0")
    return first(anchor, "a0").join(first(other, "o0"), "meeting_id").select(
        "meeting_id", F.when(delta.between(low_ms, high_ms), delta).otherwise(0).alias("offset_ms")
    )


def shift_back(df: DataFrame, offsets: DataFrame) -> DataFrame:
    moved = df.join(offsets, "meeting_id", "left")
    off = F.coalesce("offset_ms", F.lit(0))
    return moved.withColumns({c: F.greatest(F.lit(0), F.col(c) - off) for c in ("start_ms", "end_ms")}).drop("offset_ms")
