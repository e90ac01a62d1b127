"""Structured Streaming jobs: audit ingest, job states, stalled jobs, online turns."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from parlance.operators.catalog import ACTIVE_STATES, INTERRUPTED, latest_states
from parlance.operators.turns import TURN_GAP_MS, build_turns
from parlance.sources.readers import audit_events
from parlance.sources.writers import audit_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# ---- T1 ---------------------------------------------------------------------------------------
def audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    return audit_rows(audit_events(spark.readStream.text(folder)))


def ingest_audit(events: DataFrame, path: str, checkpoint: str):
    """Append events to day partitions; the checkpoint makes every line land exactly once."""
    return (
        events.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("log_date").outputMode("append").trigger(availableNow=True).start(path)
    )


# ---- T2 ---------------------------------------------------------------------------------------
def follow_job_states(events: DataFrame, path: str, checkpoint: str):
    """Keep the newest state per job in a table of numbered changes.

    A micro-batch writes only the jobs that changed, under its own number, so a repeated batch rewrites the same folder.  Late events
    lose by event time inside ``latest_states``, so a job's row of the highest number is its newest.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={number}")

    return latest_states(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest row of every job; None before the first batch.  Any other failure to read is raised."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    names = [c for c in versions.columns if c not in ("job_id", "v")]
    return versions.groupBy("job_id").agg(F.max_by(F.struct(*names), "v").alias("s")).select("job_id", "s.*")


# ---- T3 ---------------------------------------------------------------------------------------
class StalledJobs(StatefulProcessor):
    """Remembers the last event of a job and fires once event time passes it by the timeout."""

    def __init__(self, timeout_ms: int, active: tuple[str, ...]):
        self.timeout_ms, self.active = timeout_ms, active

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, progress int, at_ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        best = self.last.get() if self.last.exists() else None
        for pdf in rows:
            for r in pdf[["state", "progress", "at_ms"]].itertuples(index=False, name=None):
                if best is None or r[2] >= best[2]:
                    best = (r[0], int(r[1]), int(r[2]))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.last.update(tuple(best))
        if best[0] in self.active:
            self.handle.registerTimer(best[2] + self.timeout_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, progress, at_ms = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"job_id": [key[0]], "state": ["error"], "progress": [min(progress, 99)], "stage": [INTERRUPTED], "last_state": [state], "at_ms": [at_ms]})

    def close(self) -> None:
        pass


def stalled_jobs(events: DataFrame, timeout: str = "1 hour", timeout_ms: int = 3_600_000) -> DataFrame:
    """Error rows for jobs left in an active state without further events for the timeout."""
    kind = dict(events.dtypes)["job_id"]
    timed = events.select("job_id", "state", "progress", "at_ms", F.timestamp_millis("at_ms").alias("event_time")).withWatermark("event_time", timeout)
    return timed.groupBy("job_id").transformWithStateInPandas(
        StalledJobs(timeout_ms, tuple(ACTIVE_STATES)),
        outputStructType=f"job_id {kind}, state string, progress int, stage string, last_state string, at_ms bigint",
        outputMode="append",
        timeMode="eventTime",
    )


# ---- T4 ---------------------------------------------------------------------------------------
SEGMENT_FIELDS = ["ord", "start_ms", "end_ms", "text", "speaker_id", "speaker_name", "confidence", "attribution_confidence"]
SEGMENT_DDL = "ord bigint, start_ms bigint, end_ms bigint, text string, speaker_id string, speaker_name string, confidence double, attribution_confidence double"


class OpenTurn(StatefulProcessor):
    """Holds the segments of the turn that is still open and releases them when it closes."""

    def __init__(self, gap_ms: int, key_name: str):
        self.gap_ms, self.key_name = gap_ms, key_name

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", SEGMENT_DDL + ", wall_ms bigint")

    def _frame(self, key, rows) -> pd.DataFrame:
        out = pd.DataFrame([r[: len(SEGMENT_FIELDS)] for r in rows], columns=SEGMENT_FIELDS)
        out.insert(0, self.key_name, key[0])
        return out

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values("ord", kind="stable")
        new = [tuple(None if pd.isna(v) else v for v in r) for r in new[[*SEGMENT_FIELDS, "wall_ms"]].itertuples(index=False, name=None)]
        held = [tuple(r) for r in self.open.get()]
        released = []
        for r in new:
            if held and (r[4] != held[-1][4] or r[1] - held[-1][2] >= self.gap_ms):
                released.extend(held)
                held = []
            held.append(r)
        self.open.clear()
        self.open.put([tuple(r) for r in held])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        last = held[-1]
        self.handle.registerTimer(int(last[-1] + last[2] - last[1] + self.gap_ms))
        if released:
            yield self._frame(key, released)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = [tuple(r) for r in self.open.get()]
        self.open.clear()
        if held:
            yield self._frame(key, held)

    def close(self) -> None:
        pass


def closed_turn_segments(segments: DataFrame, delay: str = "10 seconds", gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """T4: segments of closed turns, in whole turns.

    ``event_time`` is the wall-clock time at which the segment starts: meetings share one watermark, so their own
    clocks, which all begin at zero, would close each other's turns.
    """
    kind = dict(segments.dtypes)["meeting_id"]
    timed = segments.withColumn("wall_ms", F.unix_millis("event_time")).withWatermark("event_time", delay)
    return timed.groupBy("meeting_id").transformWithStateInPandas(
        OpenTurn(gap_ms, "meeting_id"), outputStructType=f"meeting_id {kind}, {SEGMENT_DDL}", outputMode="append", timeMode="eventTime"
    )


def online_turns(segments: DataFrame, path: str, checkpoint: str, delay: str = "10 seconds"):
    """Closed turns go through the same text and confidence rules as the batch operator."""

    def build(batch: DataFrame, number: int) -> None:
        build_turns(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return closed_turn_segments(segments, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(build).trigger(availableNow=True).start()


def stalled_now(events: DataFrame, timeout_ms: int) -> DataFrame:
    """T3 on a table: jobs whose newest event is active and older than the newest event of all by the timeout."""
    now = events.agg(F.max("at_ms").alias("now_ms"))
    newest = latest_states(events).where(F.col("state").isin(*ACTIVE_STATES))
    # `now` is one row: a scalar comparison, not a join of two tables.
    return newest.where(F.col("at_ms") + timeout_ms <= now.scalar()).select("job_id", F.col("state").alias("last_state"), "at_ms")
