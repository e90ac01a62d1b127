"""Deterministic transcript-shaped views over the given tables, for Spark and (as CTEs) for DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.ordered import by_position, running_totals
from parlance.session import cut

_STAGED: dict[tuple[str, str], DataFrame] = {}
GAP_STEP_MS = 600
MS_PER_CHAR = 60


def epoch_ms(column: str):
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def segments(self) -> DataFrame:
        """The segment table of these files, laid out once per application and stored like any base table."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _STAGED:
            _STAGED[key] = cut(self._laid_out())
        return _STAGED[key]

    def _laid_out(self) -> DataFrame:
        """One row per non-empty line of a conversation turn, on a millisecond clock."""
        lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
        turns = self.table("conversations").select(
            F.col("conv_id").alias("meeting_id"), "turn", F.col("role").alias("speaker_id"), lines.alias("lines")
        )
        chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
        totals = running_totals(
            turns.withColumns({"n": F.size("lines").cast("long"), "c": chars}),
            by_position(order="turn"),
            {"n_upto": F.col("n"), "c_upto": F.col("c")},
        )
        placed = F.transform(
            "lines",
            lambda x, i: F.struct(
                (F.col("n_upto") - F.col("n") + i + 1).alias("ord"),
                x.alias("text"),
                (F.col("c_upto") - F.col("c") + F.aggregate(F.slice("lines", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + F.length(y))).alias("c"),
            ),
        )
        rows = totals.select("meeting_id", "speaker_id", F.inline(placed))
        gap = lambda k: (F.col("meeting_id") * 7 + k * 13) % 5
        # Gaps repeat with period 5 and sum to 10 steps per period, so their prefix sum has a closed form.
        steps = F.floor(F.col("ord") / 5) * 10
        for k in range(1, 5):
            steps = steps + F.when(F.col("ord") % 5 >= k, gap(F.lit(k))).otherwise(0)
        dur = F.length("text").cast("long") * MS_PER_CHAR
        end = (F.col("c") * MS_PER_CHAR + steps * GAP_STEP_MS).cast("long")
        return rows.select(
            "meeting_id",
            "ord",
            "speaker_id",
            "text",
            (end - dur).alias("start_ms"),
            end.alias("end_ms"),
            (((F.col("meeting_id") * 31 + F.col("ord") * 17) % 101) / F.lit(100.0)).alias("confidence"),
        )

    @cached_property
    def diarization(self) -> DataFrame:
        ord_ = F.col("ord")
        flipped = F.when(F.col("speaker_id") == "user", "assistant").otherwise("user")
        speaker = F.when(ord_ % 11 == 0, flipped).otherwise(F.col("speaker_id"))
        return self.segments.select(
            "meeting_id",
            ord_.alias("d_ord"),
            speaker.alias("speaker_id"),
            F.when(ord_ % 4 == 0, F.concat(F.lit("Name "), speaker)).alias("speaker_name"),
            F.greatest(F.lit(0), F.col("start_ms") + ((ord_ * 29) % 7 - 3) * 150).alias("start_ms"),
            (F.col("end_ms") + ((ord_ * 23) % 5 - 2) * 150).alias("end_ms"),
            (ord_ % 9 == 0).alias("is_overlap"),
        )

    @cached_property
    def asr(self) -> DataFrame:
        return self.segments.drop("speaker_id")

    @cached_property
    def aligned(self) -> DataFrame:
        """Segments attributed to their role, with a nullable attribution confidence and partial names."""
        ord_ = F.col("ord")
        return self.segments.select(
            "meeting_id",
            "ord",
            "start_ms",
            "end_ms",
            "text",
            "speaker_id",
            F.when(ord_ % 3 == 1, F.concat(F.lit("Name "), F.col("speaker_id"))).alias("speaker_name"),
            F.when(ord_ % 4 == 2, F.concat(F.lit("Maybe "), F.col("speaker_id"))).alias("suggested_speaker_name"),
            F.when(ord_ % 4 == 2, (ord_ % 10) / F.lit(10.0)).alias("suggested_speaker_confidence"),
            "confidence",
            F.when(ord_ % 6 != 0, ((F.col("meeting_id") * 11 + ord_ * 19) % 101) / F.lit(100.0)).alias("attribution_confidence"),
            self.meeting_type(),
        )

    @staticmethod
    def meeting_type():
        m = F.col("meeting_id") % 5
        return (
            F.when(m == 0, "court_hearing").when(m == 1, "administrative").when(m == 2, "client_meeting").when(m == 3, "interview").otherwise("general")
        ).alias("meeting_type")

    @cached_property
    def words(self) -> DataFrame:
        """Words of every segment with times spread evenly over it."""
        ws = F.filter(F.split("text", " "), lambda w: w != "")
        return (
            self.segments.withColumn("ws", ws)
            .withColumn("n", F.size("ws"))
            .select("meeting_id", "ord", "start_ms", "end_ms", "n", "confidence", F.posexplode("ws").alias("pos", "word"))
            .select(
                "meeting_id",
                F.col("ord").alias("seg_ord"),
                F.col("pos").cast("long").alias("w_pos"),
                "word",
                (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * F.col("pos") / F.col("n"))).alias("start_ms"),
                (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * (F.col("pos") + 1) / F.col("n"))).alias("end_ms"),
                (((F.col("ord") * 7 + F.col("pos") * 3) % 100) / F.lit(100.0)).alias("confidence"),
            )
        )

    @cached_property
    def audit(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id",
            "ts",
            F.when(kind == "signup", "user.create").when(kind == "view", "meeting.transcript.view").when(kind == "click", "meeting.upload")
            .when(kind == "purchase", "meeting.process.complete").otherwise("meeting.process.fail").alias("action"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
            (F.col("event_id") % 97).cast("string").alias("resource_id"),
            (kind != "error").alias("success"),
            F.col("props").alias("details"),
        )

    @cached_property
    def job_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            (F.col("event_id") % 500).alias("job_id"),
            "event_id",
            F.col("ts").alias("updated_at"),
            F.when(kind == "signup", "uploaded").when(kind == "view", "transcribing").when(kind == "click", "diarizing")
            .when(kind == "purchase", "completed").otherwise("error").alias("state"),
            F.least(F.lit(100), F.greatest(F.lit(0), F.floor("value"))).cast("int").alias("progress"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """One job per order: owner, state and progress are functions of the order row."""
        k = F.col("o_orderkey")
        states = ["uploaded", "transcribing", "diarizing", "completed", "error", "completed", "summarizing", "completed"]
        return self.table("orders").select(
            k.alias("job_id"),
            F.element_at(F.array(*[F.lit(s) for s in states]), (k % 8 + 1).cast("int")).alias("state"),
            F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, F.lit("")).otherwise(F.concat(F.lit("user_"), (F.col("o_custkey") % 50).cast("string"))).alias("owner"),
            (k * 7 % 101).cast("int").alias("progress"),
            F.col("o_orderdate").alias("created_at"),
            F.concat(F.lit("Meeting: "), F.col("o_orderpriority"), F.lit(" / "), k.cast("string")).alias("title"),
        )

    @cached_property
    def audio_meta(self) -> DataFrame:
        q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
        codecs = ["pcm_s16le", "wav", "mp3", "opus", "aac", "flac", "wma"]
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("meeting_id"),
            n.alias("part_no"),
            ((q * q * 3500) - 3500).alias("duration_ms"),
            F.when(n % 3 == 0, 44100).otherwise(16000).alias("sample_rate"),
            F.when(n % 4 == 0, 2).otherwise(1).alias("channels"),
            F.element_at(F.array(*[F.lit(c) for c in codecs]), (n % 7 + 1).cast("int")).alias("codec"),
            F.when(q % 5 == 0, F.lit(0)).otherwise(q * 1000).alias("file_size"),
        )


# Shared CTEs: name -> (names it reads, SQL text).
PRELUDE: dict[str, tuple[str, str]] = {
    "pieces": ("", """
SELECT conv_id AS meeting_id, turn, pos - 1 AS piece, role AS speaker_id, trim(line) AS text
FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations)
WHERE length(trim(line)) > 0"""),
    "segments": ("pieces", """
SELECT meeting_id, ord, speaker_id, text,
  CAST(sum(dur + gap) OVER w - dur AS BIGINT) AS start_ms, CAST(sum(dur + gap) OVER w AS BIGINT) AS end_ms,
  ((meeting_id * 31 + ord * 17) % 101) / 100.0::DOUBLE AS confidence
FROM (SELECT *, (meeting_id * 7 + ord * 13) % 5 * 600 AS gap, CAST(length(text) AS BIGINT) * 60 AS dur
      FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY turn, piece) AS ord FROM pieces))
WINDOW w AS (PARTITION BY meeting_id ORDER BY ord ROWS UNBOUNDED PRECEDING)"""),
    "diarization": ("segments", """
SELECT meeting_id, d_ord, sp AS speaker_id, CASE WHEN d_ord % 4 = 0 THEN 'Name ' || sp END AS speaker_name,
  start_ms, end_ms, d_ord % 9 = 0 AS is_overlap
FROM (SELECT meeting_id, ord AS d_ord,
  CASE WHEN ord % 11 = 0 AND speaker_id = 'user' THEN 'assistant' WHEN ord % 11 = 0 THEN 'user' ELSE speaker_id END AS sp,
  greatest(0, start_ms + ((ord * 29) % 7 - 3) * 150) AS start_ms, end_ms + ((ord * 23) % 5 - 2) * 150 AS end_ms FROM segments)"""),
    "aligned": ("segments", """
SELECT meeting_id, ord, start_ms, end_ms, text, speaker_id,
  CASE WHEN ord % 3 = 1 THEN 'Name ' || speaker_id END AS speaker_name,
  CASE WHEN ord % 4 = 2 THEN 'Maybe ' || speaker_id END AS suggested_speaker_name,
  CASE WHEN ord % 4 = 2 THEN (ord % 10) / 10.0::DOUBLE END AS suggested_speaker_confidence,
  confidence,
  CASE WHEN ord % 6 <> 0 THEN ((meeting_id * 11 + ord * 19) % 101) / 100.0::DOUBLE END AS attribution_confidence,
  CASE meeting_id % 5 WHEN 0 THEN 'court_hearing' WHEN 1 THEN 'administrative' WHEN 2 THEN 'client_meeting' WHEN 3 THEN 'interview' ELSE 'general' END AS meeting_type
FROM segments"""),
    "words": ("segments", """
SELECT meeting_id, ord AS seg_ord, pos AS w_pos, word,
  start_ms + CAST(floor((end_ms - start_ms) * pos / n) AS BIGINT) AS start_ms,
  start_ms + CAST(floor((end_ms - start_ms) * (pos + 1) / n) AS BIGINT) AS end_ms,
  ((ord * 7 + pos * 3) % 100) / 100.0::DOUBLE AS confidence
FROM (SELECT meeting_id, ord, start_ms, end_ms, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos
      FROM (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM segments))"""),
    "audit": ("", """
SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'user.create' WHEN 'view' THEN 'meeting.transcript.view' WHEN 'click' THEN 'meeting.upload'
  WHEN 'purchase' THEN 'meeting.process.complete' ELSE 'meeting.process.fail' END AS action,
  'user_' || user_id AS username, CAST(event_id % 97 AS VARCHAR) AS resource_id, event_type <> 'error' AS success, props AS details FROM events"""),
    "job_events": ("", """
SELECT event_id % 500 AS job_id, event_id, ts AS updated_at, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'transcribing' WHEN 'click' THEN 'diarizing'
  WHEN 'purchase' THEN 'completed' ELSE 'error' END AS state, CAST(least(100, greatest(0, floor(value))) AS INT) AS progress FROM events"""),
    "jobs": ("", """
SELECT o_orderkey AS job_id,
  ['uploaded','transcribing','diarizing','completed','error','completed','summarizing','completed'][o_orderkey % 8 + 1] AS state,
  CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'user_' || (o_custkey % 50) END AS owner,
  CAST(o_orderkey * 7 % 101 AS INT) AS progress, o_orderdate AS created_at,
  'Meeting: ' || o_orderpriority || ' / ' || o_orderkey AS title FROM orders"""),
    "audio_meta": ("", """
SELECT l_orderkey AS meeting_id, CAST(l_linenumber AS BIGINT) AS part_no,
  CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT) * 3500 - 3500 AS duration_ms,
  CASE WHEN l_linenumber % 3 = 0 THEN 44100 ELSE 16000 END AS sample_rate, CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 1 END AS channels,
  ['pcm_s16le','wav','mp3','opus','aac','flac','wma'][l_linenumber % 7 + 1] AS codec,
  CASE WHEN CAST(l_quantity AS BIGINT) % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1000 END AS file_size FROM lineitem"""),
}
