"""Quality checks per meeting: score, pass flag, and the issues behind them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators.intervals import gap_series
from parlance.operators.turns import order_flags

# Fixed values of the checks.
MIN_AUDIO_MS, MAX_AUDIO_MS = 10_000, 7_200_000
KNOWN_CODECS = ["pcm_s16le", "wav", "mp3", "aac", "flac"]
MIN_CONFIDENCE, VERY_LOW_CONFIDENCE = 0.6, 0.3
MIN_REPEAT, MAX_REPEAT = 20, 100
MAX_CHARS_PER_SEC = 200
MEAN_BLOCK = 4096
SHORT_ROW_MS, GAP_COUNTED_MS, GAP_MEAN_MS, MIN_SHARE = 300, 1000, 2000, 0.05


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).cast("double")


def _minus(points: int, when: Column) -> Column:
    return F.when(when, points).otherwise(0)


def _present(*messages: Column) -> Column:
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def _finding(when: Column, severity: str, message: str, value: Column | float = 0.0) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"), (value if isinstance(value, Column) else F.lit(value)).cast("double").alias("value")))


def audio_quality(meta: DataFrame) -> DataFrame:
    """A4: duration, sample rate, channels, codec and size of each recording."""
    d = F.col("duration_ms")
    short, long_ = d < MIN_AUDIO_MS, d > MAX_AUDIO_MS
    rate, mono = F.col("sample_rate") != 16000, F.col("channels") != 1
    score = 100 - _minus(50, short) - _minus(10, long_) - _minus(5, rate) - _minus(5, mono)
    return meta.withColumns(
        {
            "score": _clamped(score),
            "passed": ~short & ~long_,
            "issues": _present(F.when(short, "audio too short"), F.when(long_, "audio very long")),
            "warnings": _present(
                F.when(rate, "non-standard sample rate"),
                F.when(mono, "not mono"),
                F.when(~F.col("codec").isin(*KNOWN_CODECS), "uncommon codec"),
                F.when((F.col("file_size") == 0) & (d > 0), "file size unknown"),
            ),
        }
    )


def _repeat_finder():
    def find(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return []
            codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
            n, hits = len(codes), []
            for size in range(MIN_REPEAT, MAX_REPEAT + 1):
                starts = n - 2 * size
                if starts <= 0:
                    break
                # s[i:i+size] == s[i+size:i+2*size] iff all of `size` consecutive shifted comparisons hold.
                same = np.concatenate(([0], np.cumsum(codes[:-size] == codes[size:])))
                at = np.flatnonzero(same[size:][:starts] - same[:starts] == size)
                if len(at):
                    hits.append({"size": size, "at": int(at[0])})
            return hits

        return texts.map(one)

    return F.pandas_udf(find, "array<struct<size:int,at:int>>")


def repeated_text(segments: DataFrame) -> DataFrame:
    """One row per (segment, length) whose text holds an immediate repeat of that length."""
    low = F.lower(F.col("text"))
    long_enough = segments.where(F.length(low) >= MAX_REPEAT)
    hits = long_enough.withColumn("low", F.lower("text")).withColumn("h", F.explode(_repeat_finder()(F.col("low"))))
    return hits.select("meeting_id", "ord", F.col("h.size").alias("size"), F.col("h.at").alias("at"), F.substr("low", F.col("h.at") + 1, F.col("h.size")).alias("repeated"))


def dense_text(segments: DataFrame) -> DataFrame:
    """More than 200 characters per second."""
    dur = F.col("end_ms") - F.col("start_ms")
    return segments.where((dur > 0) & (F.length("text") * 1000 > MAX_CHARS_PER_SEC * dur))


def _mean_confidence(segments: DataFrame) -> DataFrame:
    """Mean confidence per meeting, added up in the order of its segments (blocks of them by themselves): the last digits, and what is rounded from them, don't depend on where rows lie."""
    known = segments.where("confidence is not null").withColumn("block", F.floor(F.col("ord") / MEAN_BLOCK))
    added = lambda xs: F.aggregate(F.array_sort(xs), F.lit(0.0), lambda s, x: s + x["x"])
    blocks = known.groupBy("meeting_id", "block").agg(F.collect_list(F.struct("ord", F.col("confidence").cast("double").alias("x"))).alias("xs")).select("meeting_id", "block", F.size("xs").alias("n"), added("xs").alias("x"))
    return blocks.groupBy("meeting_id").agg(F.collect_list(F.struct("block", "x")).alias("xs"), F.sum("n").alias("n")).select("meeting_id", (added("xs") / F.col("n")).alias("avg_confidence"))


def transcript_quality(meetings: DataFrame, segments: DataFrame) -> DataFrame:
    """A5: confidence, empty text and hallucination checks; meetings without segments score 0."""
    suspects = repeated_text(segments).select("meeting_id").unionByName(dense_text(segments).select("meeting_id")).distinct().withColumn("suspect", F.lit(True))
    blank = tx.strip(F.coalesce("text", F.lit(""))) == ""
    per = segments.groupBy("meeting_id").agg(
        F.min("confidence").alias("min_confidence"),
        F.count_if(F.col("confidence") < VERY_LOW_CONFIDENCE).alias("very_low"),
        F.count_if(blank).alias("empty"),
    )
    df = meetings.select("meeting_id").join(per, "meeting_id", "left").join(_mean_confidence(segments), "meeting_id", "left").join(suspects, "meeting_id", "left")
    none = F.col("avg_confidence").isNull()
    low = F.col("avg_confidence") < MIN_CONFIDENCE
    suspect = F.coalesce("suspect", F.lit(False))
    score = 100 - _minus(20, low) - _minus(5, F.col("very_low") > 0) - 5 * F.least(F.col("empty"), F.lit(5)) - _minus(15, suspect)
    return df.select(
        "meeting_id",
        "avg_confidence",
        "min_confidence",
        "very_low",
        "empty",
        suspect.alias("suspect"),
        F.when(none, 0.0).otherwise(_clamped(score)).alias("score"),
        (~none & ~low & ~suspect).alias("passed"),
        _present(
            _finding(none, "critical", "no segments"),
            _finding(low, "warning", "low average confidence", F.rint(F.col("avg_confidence") * 100) / 100),
            _finding(suspect, "warning", "repeated or dense text"),
            _finding(F.col("very_low") > 0, "note", "segments with very low confidence", F.col("very_low")),
            _finding(F.col("empty") > 0, "note", "segments without text", F.col("empty")),
        ).alias("findings"),
    )


def diarization_quality(meetings: DataFrame, diarization: DataFrame) -> DataFrame:
    """Speaker count, very short rows, mean of the larger gaps, speakers with a small share."""
    dur = F.col("end_ms") - F.col("start_ms")
    per = diarization.groupBy("meeting_id", "speaker_id").agg(F.sum(dur).alias("d"), F.count_if(dur < SHORT_ROW_MS).alias("short"))
    total = F.sum("d").over(Window.partitionBy("meeting_id"))
    speakers = per.withColumn("quiet", (total > 0) & (F.col("d") / total < MIN_SHARE)).groupBy("meeting_id").agg(
        F.count("*").alias("speakers"), F.sum("short").alias("short_rows"), F.count_if("quiet").alias("quiet_speakers")
    )
    gaps = gap_series(diarization).where(F.col("gap_ms") > GAP_COUNTED_MS).groupBy("meeting_id").agg(F.avg("gap_ms").alias("mean_gap_ms"))
    df = meetings.select("meeting_id").join(speakers, "meeting_id", "left").join(gaps, "meeting_id", "left")
    none = F.col("speakers").isNull()
    wide = F.coalesce(F.col("mean_gap_ms") > GAP_MEAN_MS, F.lit(False))
    score = 100 - _minus(10, F.col("speakers") < 2) - _minus(5, F.col("short_rows") > 0) - _minus(10, wide)
    return df.select(
        "meeting_id",
        "speakers",
        "short_rows",
        "quiet_speakers",
        wide.alias("large_gaps"),
        F.when(none, 0.0).otherwise(_clamped(score)).alias("score"),
        (~none).alias("passed"),
        _present(
            _finding(none, "critical", "no rows"),
            _finding(F.col("speakers") < 2, "note", "few speakers", F.col("speakers")),
            _finding(F.col("short_rows") > 0, "note", "very short rows", F.col("short_rows")),
            _finding(wide, "note", "large gaps", F.bround("mean_gap_ms", 0)),
            _finding(F.col("quiet_speakers") > 0, "note", "speakers with a small share", F.col("quiet_speakers")),
        ).alias("findings"),
    )


def alignment_quality(meetings: DataFrame, aligned: DataFrame) -> DataFrame:
    """Missing speakers, inverted ranges, order and empty text; the first ten offending positions."""
    flagged = order_flags(aligned)
    missing = F.coalesce("speaker_id", F.lit("")) == ""
    blank = tx.strip(F.coalesce("text", F.lit(""))) == ""
    per = flagged.groupBy("meeting_id").agg(
        F.count("*").alias("n"),
        F.count_if(missing).alias("missing_speaker"),
        F.count_if("inverted").alias("inverted"),
        F.count_if("out_of_order").alias("out_of_order"),
        F.count_if(blank).alias("empty"),
    )
    ranked = aligned.where(missing).withColumn("rn", F.row_number().over(Window.partitionBy("meeting_id").orderBy("ord"))).where("rn <= 10")
    first = ranked.groupBy("meeting_id").agg(F.array_sort(F.collect_list("ord")).alias("missing_at"))
    df = meetings.select("meeting_id").join(per, "meeting_id", "left").join(first, "meeting_id", "left")
    none = F.col("n").isNull()
    score = 100 - _minus(50, F.col("missing_speaker") > 0) - _minus(20, F.col("out_of_order") > 0) - _minus(5, F.col("empty") > 0)
    return df.select(
        "meeting_id",
        "missing_speaker",
        "inverted",
        "out_of_order",
        "empty",
        "missing_at",
        F.when(none, 0.0).otherwise(_clamped(score)).alias("score"),
        F.when(none, False).otherwise((F.col("missing_speaker") == 0) & (F.col("inverted") == 0)).alias("passed"),
        _present(
            _finding(none, "critical", "no segments"),
            _finding(F.col("missing_speaker") > 0, "critical", "segments without speaker", F.col("missing_speaker")),
            _finding(F.col("inverted") > 0, "critical", "inverted time ranges", F.col("inverted")),
            _finding(F.col("out_of_order") > 0, "note", "segments out of order", F.col("out_of_order")),
            _finding(F.col("empty") > 0, "note", "segments without text", F.col("empty")),
        ).alias("findings"),
    )


def protocol_quality(protocols: DataFrame) -> DataFrame:
    """A10: completeness of a meeting protocol row (topic, summary and nested lists)."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    topic, summary = tx.strip(F.coalesce("topic", F.lit(""))), F.coalesce("summary", F.lit(""))
    empty = (F.length(summary) == 0) & (size("key_topics") == 0) & (size("decisions") == 0) & (size("tasks") == 0)
    rules = [
        (50, empty, "critical", "no content"),
        (10, F.length(topic) < 3, "note", "short topic"),
        (20, F.length(tx.strip(summary)) < 50, "note", "short summary"),
        (15, size("participants") == 0, "note", "no participants"),
        (5, size("decisions") == 0, "note", "no decisions"),
        (5, size("tasks") == 0, "note", "no tasks"),
        (10, size("transcript") == 0, "note", "no transcript"),
        (5, F.length(summary) > 5000, "note", "long summary"),
    ]
    score = F.lit(100)
    for points, when, _, _ in rules:
        score = score - _minus(points, when)
    findings = _present(*[_finding(when, severity, message, float(points)) for points, when, severity, message in rules])
    return protocols.withColumns({"score": _clamped(score), "passed": ~empty, "findings": findings})
