"""Readers: stage artifacts, logs, RTTM, audit lines, job catalogues, voice profiles and rule files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx

AUDIT_SCHEMA = (
    "timestamp string, action string, username string, ip_address string, resource_type string, resource_id string, "
    "details map<string,string>, success boolean, error string"
)
GOLD_SCHEMA = "turn bigint, speaker string, text string"
JOB_SCHEMA = "id string, filename string, state string, created_at string, updated_at string, progress double, retry_count int, owner string, meeting_type string"


def ms(seconds: Column) -> Column:
    return F.bround(seconds.cast("double") * 1000, 0).cast("bigint")


def whole_files(spark: SparkSession, path: str, key: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """One row per file: the meeting key (by default the parent directory) and the content."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.regexp_extract("_metadata.file_path", key, 1).alias("meeting_id"), F.col("value").alias("content"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def artifact_rows(files: DataFrame, content: str = "content") -> DataFrame:
    """Rows of an artifact that is either a bare list or an object with ``segments``."""
    v = F.try_parse_json(content)
    rows = F.coalesce(F.try_variant_get(v, "$.segments", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.posexplode(rows).alias("pos", "v")).withColumn("pos", F.col("pos").cast("bigint"))


def tolerant_segments(rows: DataFrame) -> DataFrame:
    """Segment columns with field fallbacks and defaults."""
    get = lambda f, t="string": F.try_variant_get("v", f"$.{f}", t)
    present = lambda c: F.when(c != "", c)
    words = F.transform(
        F.coalesce(get("words", "array<variant>"), F.array().cast("array<variant>")),
        lambda w: F.struct(
            ms(F.try_variant_get(w, "$.start", "double")).alias("start_ms"),
            ms(F.try_variant_get(w, "$.end", "double")).alias("end_ms"),
            F.coalesce(present(F.try_variant_get(w, "$.word", "string")), F.try_variant_get(w, "$.text", "string"), F.lit("")).alias("word"),
            F.coalesce(F.try_variant_get(w, "$.confidence", "double"), F.lit(1.0)).alias("confidence"),
        ),
    )
    return rows.select(
        *[c for c in rows.columns if c != "v"],
        ms(get("start", "double")).alias("start_ms"),
        ms(get("end", "double")).alias("end_ms"),
        F.coalesce(get("text"), F.lit("")).alias("text"),
        F.coalesce(get("confidence", "double"), F.lit(1.0)).alias("confidence"),
        F.coalesce(present(get("speaker_id")), present(get("speaker")), F.lit("SPEAKER_?")).alias("speaker_id"),
        get("speaker_name").alias("speaker_name"),
        words.alias("words"),
    )


def json_lines(raw: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Lines parsed with a fixed schema; undecodable ones have ``bad`` set instead of being lost."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    keep = [c for c in raw.columns if c != value]
    parsed = raw.where(F.trim(value) != "").select(*keep, F.from_json(value, schema + ", _bad string", opts).alias("r"))
    return parsed.select(*keep, "r.*").withColumnRenamed("_bad", "bad")


def gold_turns(raw: DataFrame) -> DataFrame:
    """S3: reference turns; malformed lines skipped."""
    return json_lines(raw, GOLD_SCHEMA).where("bad is null").drop("bad")


def malformed_count(raw: DataFrame, schema: str = GOLD_SCHEMA) -> DataFrame:
    return json_lines(raw, schema).agg(F.count_if(F.col("bad").isNotNull()).alias("malformed"))


LOG_TURN = r"(?U)^\s*\[(\d+):(\d+):(\d+\.\d+)\s*-\s*(\d+):(\d+):(\d+\.\d+)\]\s+([^:]+?):\s+(.*)$"


def log_turns(raw: DataFrame) -> DataFrame:
    """``[H:M:S.f - H:M:S.f] SPEAKER: text`` lines; others are dropped."""
    g = lambda i: F.regexp_extract("value", LOG_TURN, i)
    at = lambda h, m, s: (g(h).cast("bigint") * 3600 + g(m).cast("bigint") * 60) * 1000 + ms(g(s))
    hit = raw.where(F.col("value").rlike(LOG_TURN))
    return hit.select(*[c for c in raw.columns if c != "value"], at(1, 2, 3).alias("start_ms"), at(4, 5, 6).alias("end_ms"), tx.strip(g(7)).alias("speaker"), tx.strip(g(8)).alias("text"))


def rttm_turns(raw: DataFrame) -> DataFrame:
    """RTTM lines to intervals."""
    f = F.split(F.trim("value"), " +")
    ok = raw.where(F.get(f, F.lit(0)) == "SPEAKER")
    start = ms(F.get(f, F.lit(3)))
    return ok.select(F.get(f, F.lit(1)).alias("recording_id"), start.alias("start_ms"), (start + ms(F.get(f, F.lit(4)))).alias("end_ms"), F.get(f, F.lit(7)).alias("speaker"))


def audit_events(raw: DataFrame) -> DataFrame:
    """Audit lines; undecodable ones skipped."""
    return json_lines(raw, AUDIT_SCHEMA).where("bad is null").drop("bad")


def job_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """``*/job.json`` under a root; the job id is the directory."""
    df = spark.read.schema(JOB_SCHEMA).option("multiLine", True).json(f"{root}/*/job.json")
    return df.withColumn("job_id", F.regexp_extract("_metadata.file_path", r"([^/]+)/job\.json$", 1))


def voice_profiles(spark: SparkSession, profiles: str, embeddings: str) -> tuple[DataFrame, DataFrame]:
    """Profiles and their samples; counters absent in older files get defaults."""
    p = spark.read.option("mergeSchema", True).parquet(profiles)
    for name, default in (("match_count", F.lit(0).cast("bigint")), ("last_used_at", F.lit(None).cast("bigint")), ("department", F.lit(""))):
        p = p.withColumn(name, F.coalesce(F.col(name), default) if name in p.columns else default)
    return p, spark.read.parquet(embeddings)


def compiled_rules(config: dict) -> list[dict]:
    """Sections of ``pattern: replacement`` to an ordered rule list; unusable entries are skipped."""
    out = []
    for section, entries in config.items():
        for key, value in (entries.items() if isinstance(entries, dict) else ()):
            if not isinstance(key, str) or not isinstance(value, str):
                continue
            try:
                re.compile(key)
            except re.error:
                continue
            java = re.sub(r"\\(\d)", r"$\1", value.replace("$", r"\$"))
            out.append({"section": section, "ord": len(out), "pattern": tx.rule_pattern(key), "replacement": java})
    return out


def rule_table(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame(compiled_rules(config), "section string, ord int, pattern string, replacement string")
