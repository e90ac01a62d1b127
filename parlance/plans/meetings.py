"""End-to-end plans over many meetings at once.

Stage tables are the fault-tolerance boundary: with ``stages`` set, each stage is materialised once (checkpointed), so
later stages neither recompute it nor carry its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import stats
from parlance.operators.intervals import align, mark_overlaps
from parlance.operators.ordered import ROWS_PER_BLOCK, Timeline, dense_index
from parlance.operators.people import apply_matches
from parlance.operators.turns import build_turns, clean_segments, smooth, split_by_diarization, split_by_sentences
from parlance.session import cut


def _stage(df: DataFrame, stages: bool) -> DataFrame:
    return cut(df) if stages else df


def renumber(df: DataFrame) -> DataFrame:
    """Pieces of split segments take dense positions in their meeting, so blocks of positions hold as many rows as before the split."""
    order = Timeline(("meeting_id",), ("ord", "piece"), ROWS_PER_BLOCK)
    return dense_index(df, order, "_dense").drop("ord", "piece").withColumnRenamed("_dense", "ord")


def attributed_segments(
    segments: DataFrame, diarization: DataFrame, sentence_split: bool = True, speaker_split: bool = False, stages: bool = True
) -> DataFrame:
    """Smoothed diarisation joined to (optionally split) recogniser segments: who said what."""
    dia = smooth(mark_overlaps(diarization) if "is_overlap" not in diarization.columns else diarization)
    dia = _stage(dia, stages)
    seg = segments
    if sentence_split:
        seg = renumber(split_by_sentences(seg))
        seg = seg.withColumns({c: F.bround(c, 0).cast("bigint") for c in ("start_ms", "end_ms")})
    if speaker_split:
        seg = renumber(split_by_diarization(_stage(seg, stages), dia))
    seg = _stage(seg, stages)
    return align(seg, dia)


def finished_turns(attributed: DataFrame, language: str = "ru", rules: list[tuple[str, str]] | None = None, matches: DataFrame | None = None, stages: bool = True) -> DataFrame:
    """Cleaned text, speaker turns, then rule-based spelling fixes on the reader-facing text."""
    named = apply_matches(attributed, matches) if matches is not None else attributed
    cleaned = _stage(clean_segments(named, language), stages)
    turns = build_turns(cleaned)
    return turns.withColumn("text", tx.apply_rules("text", rules)) if rules else turns


def process_meetings(segments: DataFrame, diarization: DataFrame, language: str = "ru", rules: list[tuple[str, str]] | None = None, stages: bool = True) -> DataFrame:
    """Segments and diarisation rows of many meetings to finished speaker turns."""
    attributed = _stage(attributed_segments(segments, diarization, stages=stages), stages)
    return finished_turns(attributed, language, rules, stages=stages)


def replay_comparison(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """Offline replay: statistics, confidence bands and share changes of two runs over the same meetings."""
    both = old.withColumn("run_id", F.lit("old")).unionByName(new.withColumn("run_id", F.lit("new")), allowMissingColumns=True)
    return {
        "statistics": stats.run_statistics(both, ["run_id"]),
        "histogram": stats.confidence_histogram(both, ["run_id"]),
        "shares": stats.share_delta(old, new),
    }
