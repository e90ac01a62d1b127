"""Checked queries that run a stream over the given files and return the table it wrote."""

import uuid

from pyspark.sql import functions as F

from checks.adapters import epoch_ms
from checks.registry import check
from parlance.operators import evaluation as ev
from parlance.operators import people as pp
from parlance.sources import writers as wr
from parlance.session import checkpoint_dir
from parlance.streaming import jobs


def events_stream(t):
    schema = t.table("events").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def folder(t):
    return f"{checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@check("t1_audit_ingest", "SELECT strftime(ts, '%Y-%m-%d') AS log_date, action, count(*) AS n FROM audit GROUP BY 1, 2", "audit")
def _(t):
    out = folder(t)
    kind = F.col("event_type")
    action = F.when(kind == "signup", "user.create").when(kind == "view", "meeting.transcript.view").when(kind == "click", "meeting.upload").when(kind == "purchase", "meeting.process.complete").otherwise("meeting.process.fail")
    events = events_stream(t).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), action.alias("action"), "event_id")
    jobs.ingest_audit(wr.audit_rows(events), f"{out}/data", f"{out}/ck").awaitTermination()
    return t.spark.read.parquet(f"{out}/data").groupBy(F.col("log_date").cast("string").alias("log_date"), "action").agg(F.count("*").alias("n"))


@check("t2_job_state_stream", "SELECT job_id, arg_max(state, (at_ms, event_id)) AS state, arg_max(progress, (at_ms, event_id)) AS progress, max(at_ms) AS at_ms FROM ems GROUP BY 1", "ems")
def _(t):
    out = folder(t)
    kind = F.col("event_type")
    state = F.when(kind == "signup", "uploaded").when(kind == "view", "transcribing").when(kind == "click", "diarizing").when(kind == "purchase", "completed").otherwise("error")
    events = events_stream(t).select(
        (F.col("event_id") % 500).alias("job_id"), "event_id", state.alias("state"), F.least(F.lit(100), F.greatest(F.lit(0), F.floor("value"))).cast("int").alias("progress"), epoch_ms("ts").alias("at_ms")
    )
    jobs.follow_job_states(events, f"{out}/data", f"{out}/ck").awaitTermination()
    return jobs.snapshot(t.spark, f"{out}/data").select("job_id", "state", "progress", "at_ms")


@check("t3_stalled_jobs_batch", """
SELECT job_id, state AS last_state, at_ms FROM (SELECT job_id, arg_max(state, (at_ms, event_id)) AS state, max(at_ms) AS at_ms FROM ems GROUP BY 1) WHERE state IN ('uploaded','transcribing','diarizing') AND at_ms + 86400000 <= (SELECT max(at_ms) FROM ems)""", "ems")
def _(t):
    from checks.catalog import events_ms

    return jobs.stalled_now(events_ms(t), 86_400_000)


@check("j16_rename_in_protocols", "SELECT meeting_id, CAST(count_if(speaker_id = 'user') AS BIGINT) AS renamed, CAST(count_if(speaker_id = 'assistant') AS BIGINT) AS kept FROM segments GROUP BY 1", "segments")
def _(t):
    turn = F.array(F.struct(F.col("speaker_id").alias("speaker"), F.col("text")))
    prot = t.segments.select("meeting_id", "ord", turn.alias("turns"), F.array("speaker_id").alias("participants"))
    ren = t.segments.select("meeting_id").distinct().select("meeting_id", F.lit("user").alias("old_name"), F.lit("Ann").alias("new_name"))
    got = pp.rename_in_protocols(prot, ren).select("meeting_id", F.col("turns")[0]["speaker"].alias("s"))
    return got.groupBy("meeting_id").agg(F.count_if(F.col("s") == "Ann").alias("renamed"), F.count_if(F.col("s") == "assistant").alias("kept"))


@check("f3_word_edit_alignment", "SELECT doc_id, CAST(len(ws) AS INT) AS hits, 0 AS substitutions, 0 AS deletions, 1 AS insertions FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents)")
def _(t):
    ws = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    mid = F.floor(F.size("ws") / 2).cast("int")
    hyp = F.concat(F.slice("ws", F.lit(1), mid), F.array(F.lit("")), F.slice("ws", mid + 1, F.size("ws")))
    df = t.table("documents").select("doc_id", ws.alias("ws")).select("doc_id", "ws", hyp.alias("h"))
    return df.select("doc_id", ev.edits_of("ws", "h").alias("e")).select("doc_id", "e.*")


@check("f4_speaker_mapping", """
WITH c AS (SELECT s.meeting_id AS r, s.speaker_id AS ref, d.speaker_id AS hyp, sum(least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms)) AS ms FROM segments s JOIN diarization d ON s.meeting_id = d.meeting_id AND least(s.end_ms, d.end_ms) > greatest(s.start_ms, d.start_ms) GROUP BY 1, 2, 3),
p AS (SELECT * FROM (VALUES (1,'user','assistant','system'),(2,'user','system','assistant'),(3,'assistant','user','system'),(4,'assistant','system','user'),(5,'system','user','assistant'),(6,'system','assistant','user')) v(k,a,b,d)),
g AS (SELECT c.r, p.k, sum(CASE WHEN (ref = 'user' AND hyp = a) OR (ref = 'assistant' AND hyp = b) OR (ref = 'system' AND hyp = d) THEN ms ELSE 0 END) AS gain FROM c CROSS JOIN p GROUP BY 1, 2)
SELECT r AS recording_id, CAST(max(gain) AS BIGINT) AS matched_ms FROM g GROUP BY 1""", "segments diarization")
def _(t):
    from parlance.operators.intervals import overlap_join

    pairs = overlap_join(t.segments.select("meeting_id", "ord", "start_ms", "end_ms", F.col("speaker_id").alias("ref")), t.diarization)
    over = pairs.groupBy(F.col("meeting_id").alias("recording_id"), "ref", F.col("d_speaker").alias("hyp")).agg(F.sum("overlap_ms").alias("ms"))
    return ev.speaker_mapping(over).join(over, ["recording_id", "ref", "hyp"]).groupBy("recording_id").agg(F.sum("ms").alias("matched_ms"))
