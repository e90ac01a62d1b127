"""Job, audit and file catalogues: visibility, filters, pages, timelines, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordered import Timeline, dense_index, islands, neighbours
from parlance.session import cut

# Job states.
ACTIVE_STATES = ["uploaded", "preprocessing", "transcribing", "diarizing", "aligning", "summarizing", "qa_validating", "formatting", "retrying"]
PROCESSING_STATES = ["transcribing", "diarizing", "summarizing"]
INTERRUPTED = "Interrupted by backend restart"
DAY_MS = 86_400_000


def visible_jobs(jobs: DataFrame, user: str, role: str) -> DataFrame:
    """Admins see all; others see their own and unowned rows."""
    if role == "admin":
        return jobs
    return jobs.where(F.col("owner").isNull() | F.col("owner").isin("", user))


def audit_filter(audit: DataFrame, action: str = "", user: str = "", since: str = "") -> DataFrame:
    """Exact action, part of the user name in any case, and a lower time bound (ISO text order)."""
    out = audit
    if action:
        out = out.where(F.col("action") == action)
    if user:
        out = out.where(F.contains(F.lower(F.coalesce("username", F.lit(""))), F.lit(user.lower())))
    if since:
        kind = dict(audit.dtypes)["ts"]
        out = out.where(F.col("ts") >= (F.lit(since) if kind == "string" else F.lit(since).cast(kind)))
    return out


def audit_page(audit: DataFrame, limit: int = 200, offset: int = 0, tie: str = "event_id", **filters) -> DataFrame:
    """O1: one page of matching events, newest first; the sort keeps only offset + limit rows per task."""
    n, skip = max(1, min(500, limit)), max(0, offset)
    return audit_filter(audit, **filters).orderBy(F.desc("ts"), F.desc(tie)).offset(skip).limit(n)


def audit_total(audit: DataFrame, **filters) -> DataFrame:
    return audit_filter(audit, **filters).agg(F.count("*").alias("total"))


def repair_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs found active after a restart become errors with progress at most 99."""
    active = F.col("state").isin(*ACTIVE_STATES)
    return jobs.withColumns(
        {
            "stage": F.when(active, INTERRUPTED),
            "progress": F.when(active, F.least("progress", F.lit(99))).otherwise(F.col("progress")),
            "state": F.when(active, "error").otherwise(F.col("state")),
        }
    )


def job_statistics(jobs: DataFrame) -> DataFrame:
    """Jobs in total and by outcome."""
    s = F.col("state")
    done, bad, busy = s == "completed", s == "error", s.isin(*PROCESSING_STATES)
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(done).alias("completed_jobs"),
        F.count_if(bad).alias("failed_jobs"),
        F.count_if(busy).alias("processing_jobs"),
        F.count_if(~(done | bad | busy)).alias("pending_jobs"),
    )


def stage_timeline(events: DataFrame) -> DataFrame:
    """Stages of each job in order; a stage ends when the next begins, the last at the last event."""
    tl = Timeline(("job_id",), ("at_ms", "event_id"), 7 * DAY_MS)
    runs = islands(events, tl, ["state"], lambda p, c: p("state") != c("state"), name="run")
    per = runs.groupBy("job_id", "run").agg(F.first("state").alias("state"), F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("last_ms"), F.min_by("progress", F.struct("at_ms", "event_id")).alias("progress_at_start"))
    per = per.select("job_id", F.col("run.at_ms").alias("at_ms"), F.col("run.event_id").alias("event_id"), "state", "start_ms", "last_ms", "progress_at_start")
    per = cut(per)
    nxt = neighbours(per, tl, ["start_ms"], prev=None, following="nxt")
    end = F.coalesce("nxt.start_ms", "last_ms")
    out = nxt.withColumns({"end_ms": end, "duration_ms": end - F.col("start_ms")}).drop("nxt", "last_ms")
    return dense_index(out, tl, "stage_no", 1).drop("at_ms")


def eta(events: DataFrame) -> DataFrame:
    """Remaining time per job from its latest progress and the time since its first event."""
    per = events.groupBy("job_id").agg(
        F.min("at_ms").alias("created_ms"), F.max("at_ms").alias("updated_ms"), F.max_by("progress", F.struct("at_ms", "event_id")).alias("progress")
    )
    p = F.least(F.lit(100), F.greatest(F.lit(0), F.col("progress")))
    elapsed = F.col("updated_ms") - F.col("created_ms")
    return per.withColumns({"progress": p, "remaining_ms": F.when((p > 0) & (p < 100) & (elapsed > 0), (100 - p) * elapsed / p)})


def latest_states(events: DataFrame) -> DataFrame:
    """The newest state of every job; the same plan runs on a table and on a stream."""
    newest = F.max_by(F.struct("state", "progress", "at_ms"), F.struct("at_ms", "event_id"))
    return events.groupBy("job_id").agg(newest.alias("s")).select("job_id", "s.*")


def orphaned_meetings(jobs: DataFrame, finals: DataFrame, now_ms: Column | int, timeout_hours: int = 24) -> DataFrame:
    """Meetings untouched for a day without any final output."""
    cutoff = (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)) - timeout_hours * 3_600_000
    return jobs.where(F.col("modified_ms") <= cutoff).join(finals.select("job_id").distinct(), "job_id", "left_anti")


def expired(files: DataFrame, now_ms: int, retention_hours: int) -> DataFrame:
    """Rows older than the retention; a candidate table, nothing is deleted."""
    return files.where(F.col("modified_ms") < now_ms - retention_hours * 3_600_000)


def beyond_newest(files: DataFrame, keep: int, key: str = "path") -> DataFrame:
    """Everything but the newest ``keep`` files."""
    newest = files.orderBy(F.desc("modified_ms"), F.desc(key)).limit(keep).select(key)
    return files.join(newest, key, "left_anti")


def profiles_by_name(profiles: DataFrame) -> DataFrame:
    """Ordered by name without regard to case."""
    return profiles.orderBy(F.lower("name"), "name")


def archive_folders(jobs: DataFrame) -> DataFrame:
    """Month and folder name of a finished meeting's archive."""
    stem = F.regexp_replace(F.regexp_extract("filename", r"(?s)([^/]*)$", 1), r"(?s)^(.+)\.[^.]*$", "$1")
    safe = F.substring(F.translate(stem, " /\\", "___"), 1, 80)
    return jobs.withColumns({"month": F.date_format("created_at", "yyyy-MM"), "folder": F.concat(safe, F.lit("_"), F.right(F.col("job_id").cast("string"), F.lit(8)))})


def latest_run(listing: DataFrame, prefix: str, artifact: str = "aligned.json") -> DataFrame:
    """The newest ``<prefix>_<stamp>`` directory that holds the artifact."""
    held = listing.where(F.col("run").startswith(prefix + "_") & (F.col("file") == artifact))
    return held.agg(F.max("run").alias("run"))


# Artifact precedence by preference.
PRECEDENCE = {
    "original": ["aligned.json", "aligned_v2_polished.json", "aligned_v2.json", "aligned_raw.json"],
    "repolished": ["aligned_v2_polished.json", "aligned_v2.json", "aligned.json", "aligned_raw.json"],
    "raw": ["aligned_raw.json", "aligned.json", "aligned_v2.json", "aligned_v2_polished.json"],
}


def preferred_source(listing: DataFrame, prefer: str = "original") -> DataFrame:
    """The first available artifact per meeting; a minimum, so no meeting is sorted."""
    order = PRECEDENCE.get(prefer, PRECEDENCE["original"])
    rank = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("file"))
    return listing.where(rank > 0).groupBy("meeting_id").agg(F.min_by("file", rank).alias("file"))
