"""Aggregations over aligned turns and runs: participation, review rows, statistics, language, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators.turns import display_label, first_samples, shortened

LOW_CONFIDENCE = 0.8
CONTESTED = 0.6
MIXED_SHARE = 0.20
SPARSE_FROM_MS = 1_800_000


def duration() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def participants(aligned: DataFrame) -> DataFrame:
    """A1: name at the first turn, speaking time, share (percent, one decimal, halves to even) and place per meeting and speaker.

    Places follow speaking time, longest first, and among equals the first turn.
    """
    name = F.min_by("speaker_name", "ord") if "speaker_name" in aligned.columns else F.first(F.lit(None).cast("string"))
    per = aligned.groupBy("meeting_id", "speaker_id").agg(name.alias("speaker_name"), F.sum(duration()).alias("speaking_ms"), F.min("ord").alias("_first"))
    # One row per speaker: a meeting's speakers fit a window.
    whole = Window.partitionBy("meeting_id")
    total = F.sum("speaking_ms").over(whole)
    share = F.when(total > 0, F.bround(F.col("speaking_ms") * 100 / total, 1)).otherwise(F.lit(0.0))
    place = F.row_number().over(whole.orderBy(F.desc("speaking_ms"), "_first"))
    return per.withColumns({"speaking_share": share, "place": place}).drop("_first")


def low_confidence() -> Column:
    """P5: rows for review; a missing confidence never counts."""
    return F.coalesce(F.col("attribution_confidence") < LOW_CONFIDENCE, F.lit(False))


def attribution_band(c: str = "attribution_confidence") -> Column:
    x = F.col(c)
    return F.when(x.isNull(), "").when(x >= 0.8, "ok").when(x >= 0.6, "warn").otherwise("bad")


def histogram_band(c: str = "attribution_confidence") -> Column:
    x = F.col(c)
    return F.when(x >= 1.0, "[1.00]").when(x >= 0.8, "[0.80, 1.00)").when(x >= 0.6, "[0.60, 0.80)").otherwise("[0.00, 0.60)")


def error_rate_band(c: str) -> Column:
    return F.when(F.col(c) < 0.10, "good").when(F.col(c) < 0.30, "mid").otherwise("bad")


def speaker_review(aligned: DataFrame) -> DataFrame:
    """A2: per speaker turns, time, rows to review, first known name and suggestion, three samples."""
    present = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col("ord"))
    per = aligned.groupBy("meeting_id", "speaker_id").agg(
        F.count("*").alias("turn_count"),
        F.sum(F.greatest(F.lit(0), duration())).alias("duration_ms"),
        F.count_if(low_confidence()).alias("low_confidence_turns"),
        F.min_by("speaker_name", present("speaker_name")).alias("speaker_name"),
        F.min_by("suggested_speaker_name", present("suggested_speaker_name")).alias("suggested_speaker_name"),
        F.min_by("suggested_speaker_confidence", present("suggested_speaker_name")).alias("suggested_speaker_confidence"),
    )
    samples = first_samples(aligned, 3, 1, shortened(140, 140, "..."))
    texts = samples.groupBy("meeting_id", "speaker_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sample"))), lambda s: s["sample"]).alias("samples"))
    return per.join(texts, ["meeting_id", "speaker_id"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def speaker_count_check(aligned: DataFrame, expected: DataFrame) -> DataFrame:
    """A3: detected speakers against the expected range; null when a bound is missing."""
    found = aligned.groupBy("meeting_id").agg(F.count_distinct("speaker_id").alias("detected"))
    lo, hi, n = F.col("expected_min"), F.col("expected_max"), F.col("detected")
    return found.join(expected, "meeting_id", "left").withColumns(
        {
            "matches": F.when(lo.isNotNull() & hi.isNotNull(), n.between(lo, hi)),
            "exact_conflict": F.coalesce((lo == hi) & (n != lo), F.lit(False)),
        }
    )


def run_statistics(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Segment, speaker, duration and confidence statistics per run."""
    return aligned.groupBy(*keys).agg(
        F.count("*").alias("n_segments"),
        F.count_distinct("speaker_id").alias("n_speakers"),
        F.sum(duration()).alias("total_ms"),
        F.avg(duration()).alias("avg_ms"),
        F.max(duration()).alias("longest_ms"),
        F.count("attribution_confidence").alias("n_conf"),
        F.avg("attribution_confidence").alias("avg_conf"),
        F.count_if(F.col("attribution_confidence") < CONTESTED).alias("contested"),
    )


def confidence_histogram(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per confidence band with percent and the overall mean."""
    known = aligned.where("attribution_confidence is not null")
    per = known.groupBy(*keys, histogram_band().alias("band")).agg(F.count("*").alias("n"), F.sum("attribution_confidence").alias("s"))
    w = Window.partitionBy(*keys)
    return per.select(
        *keys,
        "band",
        "n",
        F.bround(100 * F.col("n") / F.sum("n").over(w), 1).alias("pct"),
        F.bround(F.sum("s").over(w) / F.sum("n").over(w), 3).alias("mean"),
    )


def corpus_statistics(turns: DataFrame) -> DataFrame:
    """Turns, characters and words per speaker and in total (null speaker)."""
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    turns = turns.withColumns({"n_chars": F.length("text"), "n_words": words})
    return turns.groupingSets([[F.col("recording_id"), F.col("speaker")], [F.col("recording_id")]], "recording_id", "speaker").agg(
        F.count("*").alias("turns"), F.sum("n_chars").alias("chars"), F.sum("n_words").alias("words")
    )


def source_header(turns: DataFrame) -> DataFrame:
    """Turns, distinct speakers and last end per source."""
    return turns.groupBy("source").agg(F.count("*").alias("turns"), F.count_distinct("speaker_id").alias("speakers"), F.max("end_ms").alias("max_end_ms"))


def script_language(segments: DataFrame) -> DataFrame:
    """Ru when at least half of the counted letters are Cyrillic, or none is counted."""
    t = F.coalesce("text", F.lit(""))
    cyr = F.length(F.regexp_replace(t, "[^Ѐ-ӿ]", ""))
    lat = F.length(F.regexp_replace(F.lower(t), "[^a-z]", ""))
    per = segments.groupBy("meeting_id").agg(F.sum(cyr).alias("cyrillic"), F.sum(lat).alias("latin"))
    total = F.col("cyrillic") + F.col("latin")
    return per.withColumn("language", F.when((total == 0) | (2 * F.col("cyrillic") >= total), "ru").otherwise("en"))


def language_mix(meetings: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean probabilities, majority language (first seen on ties) and the routing flag."""
    votes = windows.groupBy("meeting_id", "lang").agg(
        F.count("*").alias("n"), F.min("win").alias("first_win"), F.sum("ru_p").alias("ru"), F.sum("en_p").alias("en")
    )
    per = votes.groupBy("meeting_id").agg(
        F.max_by("lang", F.struct(F.col("n"), -F.col("first_win"))).alias("primary"),
        (F.sum("ru") / F.sum("n")).alias("ru_probability"),
        (F.sum("en") / F.sum("n")).alias("en_probability"),
        F.sum("n").alias("windows"),
    )
    return meetings.select("meeting_id").join(per, "meeting_id", "left").select(
        "meeting_id",
        F.coalesce("primary", F.lit("ru")).alias("primary"),
        F.coalesce("ru_probability", F.lit(1.0)).alias("ru_probability"),
        F.coalesce("en_probability", F.lit(0.0)).alias("en_probability"),
        F.coalesce("windows", F.lit(0)).alias("windows"),
        (F.coalesce("en_probability", F.lit(0.0)) >= MIXED_SHARE).alias("mixed"),
    )


def sampling_windows(meta: DataFrame, n: int = 6, window_ms: int = 30_000) -> DataFrame:
    """Evenly spaced window starts, first at 0, last at the end minus one window."""
    single = (F.col("duration_ms") <= window_ms) | F.lit(n <= 1)
    last = F.greatest(F.lit(0), F.col("duration_ms") - window_ms)
    wins = meta.withColumn("win", F.explode(F.when(single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))))
    return wins.withColumn("offset_ms", F.when(single, F.lit(0.0)).otherwise(last * F.col("win") / max(1, n - 1)))


def protocol_sparsity(items: DataFrame, spans: DataFrame, per_hour: int = 15) -> DataFrame:
    """Items found against the minimum expected for the meeting's length, and the recall trigger."""
    counts = items.groupBy("meeting_id").agg(F.count("*").alias("total_items"))
    d = F.col("duration_ms")
    expected = F.greatest(F.lit(8), F.floor(d / 300_000)).cast("long")
    recall = F.greatest(F.lit(12), F.ceil(d * per_hour / 3_600_000)).cast("long")
    n = F.coalesce("total_items", F.lit(0))
    return spans.join(counts, "meeting_id", "left").select(
        "meeting_id",
        "duration_ms",
        n.alias("total_items"),
        expected.alias("expected_min"),
        ((d >= SPARSE_FROM_MS) & (n < expected)).alias("sparse"),
        ((d >= SPARSE_FROM_MS) & (n < recall)).alias("needs_recall"),
    )


def item_counts_delta(items: DataFrame, old: str, new: str, kinds: list[str]) -> DataFrame:
    """Items per kind in two runs and the change."""
    per = items.where(F.col("run_id").isin(old, new)).groupBy("kind").pivot("run_id", [old, new]).count()
    kind_rows = items.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    o, n = F.coalesce(F.col(f"`{old}`"), F.lit(0)), F.coalesce(F.col(f"`{new}`"), F.lit(0))
    return kind_rows.join(per, "kind", "left").select("kind", o.alias("old_count"), n.alias("new_count"), (n - o).alias("delta"))


def duplicates(items: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Texts that occur more than once, with counts."""
    return items.groupBy(*keys, text).agg(F.count("*").alias("n")).where("n > 1")


def stage_shares(timings: DataFrame) -> DataFrame:
    """Time per stage, its share of the run and the real-time factor."""
    per = timings.groupBy("run_id", "stage").agg(F.sum("elapsed_ms").alias("elapsed_ms"), F.max("audio_ms").alias("audio_ms"), F.max("peak").alias("peak"))
    total = F.sum("elapsed_ms").over(Window.partitionBy("run_id"))
    return per.withColumns(
        {
            "share_pct": F.bround(100 * F.col("elapsed_ms") / total, 1),
            "real_time_factor": F.when(F.col("elapsed_ms") > 0, F.bround(F.col("audio_ms") / F.col("elapsed_ms"), 2)),
        }
    )


def display_summary(turns: DataFrame) -> DataFrame:
    """Distinct speakers, turns and the span between the first and last start."""
    labelled = turns.withColumn("label", display_label())
    return labelled.groupBy("meeting_id").agg(
        F.count_distinct(F.when(F.col("label") != "", F.col("label"))).alias("speakers"),
        F.count("*").alias("turns"),
        (F.max("start_ms") - F.min("start_ms")).alias("span_ms"),
    )


def share_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Speaking share of two runs per speaker, 0 where a speaker is missing."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        per = df.groupBy("meeting_id", F.when(F.coalesce("speaker_id", F.lit("")) == "", "?").otherwise(F.col("speaker_id")).alias("speaker_id")).agg(F.sum(duration()).alias("d"))
        total = F.sum("d").over(Window.partitionBy("meeting_id"))
        return per.select("meeting_id", "speaker_id", F.when(total > 0, F.bround(100 * F.col("d") / total, 1)).otherwise(0.0).alias(name))

    both = shares(old, "old_share").join(shares(new, "new_share"), ["meeting_id", "speaker_id"], "full")
    o, n = F.coalesce("old_share", F.lit(0.0)), F.coalesce("new_share", F.lit(0.0))
    return both.select("meeting_id", "speaker_id", o.alias("old_share"), n.alias("new_share"), F.bround(n - o, 1).alias("delta"))


def side_by_side(runs: dict[str, DataFrame], keys: list[str], order: str, value: str, first: int | None = None) -> DataFrame:
    """The n-th row of every run next to each other, empty where a run is shorter.

    Runs share dense positions (``dense_index``); ``first`` keeps the leading rows only.
    """
    from parlance.operators.ordered import by_position, dense_index

    out = None
    for name, df in runs.items():
        if first:
            # The rank filter runs before the shuffle, so only `first` rows per key and task move.
            w = Window.partitionBy(*keys).orderBy(order)
            one = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first)
        else:
            one = dense_index(df.select(*keys, order, value), by_position(keys, order), "rn", 1)
        one = one.select(*keys, F.col("rn").cast("long").alias("rn"), F.col(value).alias(name))
        out = one if out is None else out.join(one, [*keys, "rn"], "full")
    return out.na.fill("", list(runs))
