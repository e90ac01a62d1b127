"""Checked queries for catalogues, sources and sinks."""

from pyspark.sql import functions as F

from checks.adapters import PRELUDE, epoch_ms
from checks.registry import check
from parlance.functions import text as tx
from parlance.operators import catalog as ct
from parlance.operators import stats as st
from parlance.sources import readers as rd
from parlance.sources import writers as wr


def events_ms(t):
    return t.job_events.withColumn("at_ms", epoch_ms("updated_at"))


PRELUDE["ems"] = ("job_events", "SELECT *, CAST(floor(epoch_us(updated_at) / 1000) AS BIGINT) AS at_ms FROM job_events")


@check("p1_visible_jobs", "SELECT job_id, state FROM jobs WHERE owner IS NULL OR owner = '' OR owner = 'user_7'", "jobs")
def _(t):
    return ct.visible_jobs(t.jobs, "user_7", "user").select("job_id", "state")


@check("p2_audit_filter", "SELECT event_id, action, username FROM audit WHERE action = 'meeting.upload' AND contains(lower(username), 'r_1') AND ts >= TIMESTAMP '2024-01-10 00:00:00'", "audit")
def _(t):
    return ct.audit_filter(t.audit, "meeting.upload", "R_1", "2024-01-10 00:00:00").select("event_id", "action", "username")


@check("p12_repair_jobs", """
SELECT job_id, CASE WHEN a THEN 'error' ELSE state END AS state, CASE WHEN a THEN least(progress, 99) ELSE progress END AS progress, CASE WHEN a THEN 'Interrupted by backend restart' END AS stage
FROM (SELECT *, state IN ('uploaded','transcribing','diarizing','summarizing') AS a FROM jobs)""", "jobs")
def _(t):
    return ct.repair_jobs(t.jobs).select("job_id", "state", "progress", "stage")


@check("o1_audit_page", "SELECT event_id, action FROM audit WHERE contains(lower(username), '3') ORDER BY ts DESC, event_id DESC LIMIT 200 OFFSET 50", "audit")
def _(t):
    return ct.audit_page(t.audit, 200, 50, user="3").select("event_id", "action")


@check("o1_audit_total", "SELECT count(*) AS total FROM audit WHERE contains(lower(username), '3')", "audit")
def _(t):
    return ct.audit_total(t.audit, user="3")


@check("a11_job_statistics", """
SELECT count(*) AS total_jobs, CAST(count_if(state = 'completed') AS BIGINT) AS completed_jobs, CAST(count_if(state = 'error') AS BIGINT) AS failed_jobs, CAST(count_if(state IN ('transcribing','diarizing','summarizing')) AS BIGINT) AS processing_jobs,
 CAST(count_if(state NOT IN ('completed','error','transcribing','diarizing','summarizing')) AS BIGINT) AS pending_jobs FROM jobs""", "jobs")
def _(t):
    return ct.job_statistics(t.jobs)


@check("a31_stage_timeline", """
SELECT job_id, event_id, state, start_ms, coalesce(lead(start_ms) OVER w, last_ms) AS end_ms, coalesce(lead(start_ms) OVER w, last_ms) - start_ms AS duration_ms, progress_at_start, row_number() OVER w AS stage_no FROM (
 SELECT job_id, run, arg_min(event_id, (at_ms, event_id)) AS event_id, any_value(state) AS state, min(at_ms) AS start_ms, max(at_ms) AS last_ms, arg_min(progress, (at_ms, event_id)) AS progress_at_start FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR p <> state THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY at_ms, event_id) AS run FROM (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY at_ms, event_id) AS p FROM ems)) GROUP BY 1, 2)
WINDOW w AS (PARTITION BY job_id ORDER BY start_ms, event_id)""", "ems")
def _(t):
    return ct.stage_timeline(events_ms(t)).withColumn("stage_no", F.col("stage_no").cast("bigint"))


@check("w22_eta", """
SELECT job_id, c AS created_ms, u AS updated_ms, p AS progress, CASE WHEN p > 0 AND p < 100 AND u > c THEN round((100 - p) * (u - c) / p::DOUBLE, 2) END AS remaining_ms FROM (
 SELECT job_id, min(at_ms) AS c, max(at_ms) AS u, arg_max(progress, (at_ms, event_id)) AS p FROM ems GROUP BY 1)""", "ems")
def _(t):
    return ct.eta(events_ms(t)).withColumn("remaining_ms", F.round("remaining_ms", 2))


@check("t2_latest_states", "SELECT job_id, arg_max(state, (at_ms, event_id)) AS state, arg_max(progress, (at_ms, event_id)) AS progress, max(at_ms) AS at_ms FROM ems GROUP BY 1", "ems")
def _(t):
    return ct.latest_states(events_ms(t))


@check("j28_orphans", """
SELECT o_orderkey AS job_id FROM orders o WHERE epoch_ms(o_orderdate) <= epoch_ms(TIMESTAMP '1998-01-01') - 86400000 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linenumber = 4)""")
def _(t):
    jobs = t.table("orders").select(F.col("o_orderkey").alias("job_id"), epoch_ms("o_orderdate").alias("modified_ms"))
    finals = t.table("lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("job_id"))
    return ct.orphaned_meetings(jobs, finals, 883612800000).select("job_id")


def files(t):
    return t.table("orders").select(F.concat(F.lit("log_"), F.col("o_orderkey").cast("string")).alias("path"), epoch_ms("o_orderdate").alias("modified_ms"))


@check("o7_beyond_newest", "SELECT 'log_' || o_orderkey AS path FROM orders ORDER BY o_orderdate DESC, 'log_' || o_orderkey DESC OFFSET 30")
def _(t):
    return ct.beyond_newest(files(t), 30).select("path")


@check("o7_expired", "SELECT 'log_' || o_orderkey AS path FROM orders WHERE epoch_ms(o_orderdate) < epoch_ms(TIMESTAMP '1998-01-01') - 72 * 3600000")
def _(t):
    return ct.expired(files(t), 883612800000, 72).select("path")


@check("o4_profiles_by_name", "SELECT c_custkey, c_mktsegment AS name FROM customer ORDER BY lower(c_mktsegment), c_mktsegment")
def _(t):
    return ct.profiles_by_name(t.table("customer").select("c_custkey", F.col("c_mktsegment").alias("name")))


@check("s13_archive_folders", """
SELECT job_id, strftime(created_at, '%Y-%m') AS month, left(replace(replace(regexp_replace(regexp_extract(fn, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1'), ' ', '_'), '\\', '_'), 80) || '_' || right(CAST(job_id AS VARCHAR), 8) AS folder FROM (
 SELECT job_id + 1000000000 AS job_id, created_at, repeat(title, 3) || '.wav' AS fn FROM jobs)""", "jobs")
def _(t):
    jobs = t.jobs.select((F.col("job_id") + 1000000000).alias("job_id"), "created_at", F.concat(F.repeat("title", F.lit(3)), F.lit(".wav")).alias("filename"))
    return ct.archive_folders(jobs).select("job_id", "month", "folder")


@check("s14_latest_run", "SELECT max(event_type || '_' || strftime(ts, '%Y%m%d%H%M%S')) AS run FROM events WHERE event_type = 'click' AND user_id % 3 = 0")
def _(t):
    ls = t.table("events").select(F.concat_ws("_", "event_type", F.date_format("ts", "yyyyMMddHHmmss")).alias("run"), F.when(F.col("user_id") % 3 == 0, "aligned.json").otherwise("other.json").alias("file"))
    return ct.latest_run(ls, "click")


@check("s15_preferred_source", """
SELECT user_id AS meeting_id, arg_min(f, rk) AS file FROM (SELECT user_id, f, list_position(['aligned_raw.json','aligned.json','aligned_v2.json','aligned_v2_polished.json'], f) AS rk FROM (
 SELECT user_id, CASE event_type WHEN 'view' THEN 'aligned.json' WHEN 'click' THEN 'aligned_v2.json' WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'aligned_raw.json' ELSE 'x' END ELSE 'other' END AS f FROM events)) WHERE rk > 0 GROUP BY 1""")
def _(t):
    k, u = F.col("event_type"), F.col("user_id")
    f = F.when(k == "view", "aligned.json").when(k == "click", "aligned_v2.json").when((k == "error") & (u % 2 == 0), "aligned_raw.json").otherwise("other")
    return ct.preferred_source(t.table("events").select(u.alias("meeting_id"), f.alias("file")), "raw")


@check("s1_artifact_rows", "SELECT conv_id, turn, pos - 1 AS pos, trim(line) AS text FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations)")
def _(t):
    seg = F.transform(F.split("text", "\n"), lambda x: F.struct(F.trim(x).alias("text")))
    body = F.when(F.col("turn") % 2 == 0, F.to_json(seg)).otherwise(F.to_json(F.struct(seg.alias("segments"))))
    files_ = t.table("conversations").select("conv_id", "turn", body.alias("content"))
    return rd.artifact_rows(files_).select("conv_id", "turn", "pos", F.try_variant_get("v", "$.text", "string").alias("text"))


@check("s2_tolerant_segments", """
SELECT meeting_id, ord, start_ms, end_ms, CASE ord % 3 WHEN 2 THEN 'SPEAKER_?' ELSE speaker_id END AS speaker_id, CASE WHEN ord % 2 = 0 THEN confidence ELSE 1.0 END AS confidence, CASE WHEN ord % 4 = 0 THEN '' ELSE text END AS text FROM segments""", "segments")
def _(t):
    o = F.col("ord")
    seg = F.struct(
        (F.col("start_ms") / 1000).alias("start"),
        (F.col("end_ms") / 1000).alias("end"),
        F.when(o % 3 == 0, F.col("speaker_id")).alias("speaker_id"),
        F.when(o % 3 == 1, F.col("speaker_id")).alias("speaker"),
        F.when(o % 2 == 0, F.col("confidence")).alias("confidence"),
        F.when(o % 4 != 0, F.col("text")).alias("text"),
    )
    rows = rd.artifact_rows(t.segments.select("meeting_id", "ord", F.to_json(F.array(seg)).alias("content")))
    return rd.tolerant_segments(rows).select("meeting_id", "ord", "start_ms", "end_ms", "speaker_id", "confidence", "text")


@check("s3_gold_jsonl", "SELECT turn, role AS speaker, text FROM conversations WHERE conv_id % 3 <> 1")
def _(t):
    good = F.to_json(F.struct("turn", F.col("role").alias("speaker"), "text"))
    return rd.gold_turns(t.table("conversations").select(F.when(F.col("conv_id") % 3 == 1, F.concat(F.lit("{oops "), good)).otherwise(good).alias("value")))


@check("s3_malformed_count", "SELECT CAST(count_if(conv_id % 3 = 1) AS BIGINT) AS malformed FROM conversations")
def _(t):
    good = F.to_json(F.struct("turn", F.col("role").alias("speaker"), "text"))
    return rd.malformed_count(t.table("conversations").select(F.when(F.col("conv_id") % 3 == 1, F.concat(F.lit("{oops "), good)).otherwise(good).alias("value")))


@check("s4_log_turns", "SELECT meeting_id, ord, start_ms, end_ms, speaker_id AS speaker, text FROM segments WHERE ord % 5 <> 0", "segments")
def _(t):
    line = F.concat(F.lit(" ["), tx.hms_hundredths(F.col("start_ms")), F.lit("0 - "), tx.hms_hundredths(F.col("end_ms")), F.lit("0]  "), F.col("speaker_id"), F.lit(" : "), F.col("text"))
    return rd.log_turns(t.segments.select("meeting_id", "ord", F.when(F.col("ord") % 5 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value")))


@check("s5_rttm_lines", """
SELECT meeting_id AS recording_id, start_ms, printf('SPEAKER %d 1 %.3f %.3f <NA> <NA> The_%s <NA> <NA>', meeting_id, start_ms / 1000.0, greatest(50, end_ms - start_ms) / 1000.0, speaker_id) AS value FROM diarization""", "diarization")
def _(t):
    d = t.diarization.select(F.col("meeting_id").alias("recording_id"), "start_ms", "end_ms", F.concat(F.lit(" The  "), "speaker_id").alias("speaker"))
    return wr.rttm_lines(d)


@check("s5_rttm_round_trip", "SELECT CAST(meeting_id AS VARCHAR) AS recording_id, start_ms, start_ms + greatest(50, end_ms - start_ms) AS end_ms, speaker_id AS speaker FROM diarization", "diarization")
def _(t):
    d = t.diarization.select(F.col("meeting_id").alias("recording_id"), "start_ms", "end_ms", F.col("speaker_id").alias("speaker"))
    return rd.rttm_turns(wr.rttm_lines(d).select("value"))


def audit_json(t):
    a = t.audit.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "action", "username", F.lit(None).cast("string").alias("ip_address"), "resource_id",
        F.create_map(F.lit("k"), F.get_json_object("details", "$.k")).alias("details"), "success",
    )
    return a.select(F.to_json(F.struct(*a.columns)).alias("value"))


@check("s6_audit_scan", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, action, username, resource_id, success, json_extract_string(details, '$.k') AS k FROM audit", "audit")
def _(t):
    return rd.audit_events(audit_json(t)).select("timestamp", "action", "username", "resource_id", "success", F.col("details")["k"].alias("k"))


@check("s7_audit_days", "SELECT strftime(ts, '%Y-%m-%d') AS log_date, count(*) AS n FROM audit GROUP BY 1", "audit")
def _(t):
    return wr.audit_rows(rd.audit_events(audit_json(t))).groupBy("log_date").agg(F.count("*").alias("n"))


@check("s9_audit_csv", r"""
SELECT '"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","' || action || '","' || username || '","","","' || resource_id || '","' || CASE WHEN success THEN 'success' ELSE 'failure' END || '","{""k"":""' || json_extract_string(details, '$.k') || '""}"' AS value FROM audit""", "audit")
def _(t):
    return wr.csv_lines(rd.audit_events(audit_json(t)))


PRELUDE["shares"] = ("aligned", "SELECT meeting_id, speaker_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, round_even(sum(end_ms - start_ms) * 100::DOUBLE / sum(sum(end_ms - start_ms)) OVER (PARTITION BY meeting_id), 1) AS share FROM aligned GROUP BY 1, 2")


@check("s10_protocol_lines", """
SELECT meeting_id, 0::INT AS section, i - 1 AS ord, v AS value FROM (SELECT meeting_id, unnest([repeat('=', 80), 'MEETING PROTOCOL', repeat('=', 80), '', 'Date: 2024-01-01']) AS v, unnest(range(1, 6)) AS i FROM (SELECT DISTINCT meeting_id FROM aligned))
UNION ALL SELECT DISTINCT meeting_id, 1, 0, 'Topic: Meeting ' || meeting_id FROM aligned UNION ALL SELECT DISTINCT meeting_id, 2, 0, '' FROM aligned
UNION ALL SELECT DISTINCT meeting_id, 3, 0, 'PARTICIPANTS:' FROM aligned UNION ALL SELECT meeting_id, 4, -ms, '  - ' || speaker_id || printf(': %.1fs (%.1f%%)', ms / 1000.0, share) FROM shares UNION ALL SELECT DISTINCT meeting_id, 5, 0, '' FROM aligned
UNION ALL SELECT DISTINCT meeting_id, 30, 0, 'ACTION ITEMS:' FROM aligned UNION ALL SELECT DISTINCT meeting_id, 31, 0, '  - Write it [Ann] - Due: Friday' FROM aligned UNION ALL SELECT DISTINCT meeting_id, 32, 0, '' FROM aligned
UNION ALL SELECT meeting_id, 80, i - 1, v FROM (SELECT meeting_id, unnest([repeat('=', 80), 'TRANSCRIPT', repeat('=', 80)]) AS v, unnest(range(1, 4)) AS i FROM (SELECT DISTINCT meeting_id FROM aligned))
UNION ALL SELECT meeting_id, 90, ord, coalesce(nullif(speaker_name, ''), speaker_id) || printf(' [%02d:%02d:%02d]: ', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || text FROM aligned""", "aligned shares")
def _(t):
    m = F.col("meeting_id")
    none = F.array().cast("array<string>")
    prot = t.table("conversations").select(F.col("conv_id").alias("meeting_id")).distinct().select(
        m,
        F.lit("2024-01-01").alias("date"),
        F.concat(F.lit("Meeting "), m.cast("string")).alias("topic"),
        F.lit("").alias("summary"),
        none.alias("key_topics"),
        F.array().cast("array<struct<text:string,responsible:string>>").alias("decisions"),
        F.array(F.struct(F.lit("Write it").alias("text"), F.lit("Ann").alias("assignee"), F.lit("Friday").alias("deadline"))).alias("tasks"),
        none.alias("open_questions"),
    )
    people = st.participants(t.aligned).withColumn("speaker_name", F.lit(None).cast("string"))
    return wr.protocol_lines(prot, people, t.aligned)


@check("s11_markdown_lines", """
SELECT meeting_id, ord, CAST(count(*) AS BIGINT) AS lines, max(v) FILTER (starts_with(v, '###')) AS heading FROM (
 SELECT meeting_id, ord, unnest(CASE WHEN new THEN ['', '### ' || speaker_id || '  `[' || a || ' – ' || b || ']`', '', text, ''] ELSE ['_([' || a || ' – ' || b || '])_', '', text, ''] END) AS v FROM (
  SELECT *, coalesce(lag(speaker_id) OVER (PARTITION BY meeting_id ORDER BY ord) <> speaker_id, true) AS new, printf('%d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) AS a, printf('%d:%02d:%02d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60) AS b FROM aligned)
 UNION ALL SELECT meeting_id, 0, unnest(['','','','','','','']) FROM (SELECT DISTINCT meeting_id FROM aligned)) GROUP BY 1, 2""", "aligned")
def _(t):
    out = wr.markdown_lines(t.aligned)
    return out.groupBy("meeting_id", "ord").agg(F.count("*").alias("lines"), F.max(F.when(F.col("value").startswith("###"), F.col("value"))).alias("heading"))


@check("s12_tagged_payload", """SELECT o_orderkey, '{"meeting_type":"court_hearing","payload":{"title":"' || o_orderpriority || '","n":' || o_custkey || '}}' AS value FROM orders""")
def _(t):
    p = t.table("orders").select("o_orderkey", F.lit("court_hearing").alias("meeting_type"), F.struct(F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("n")).alias("payload"))
    return wr.tagged_payload(p)


NW = r"[^\p{L}\p{N}_]"


@check("s16_rule_table", rf"""
SELECT meeting_id, ord, regexp_replace(regexp_replace(regexp_replace(text, '(^|{NW})die({NW}|$)', '\1DIE\2', 'g'), '(^|{NW})die({NW}|$)', '\1DIE\2', 'g'), 'th(e|an)', 'dh\1', 'g') AS text FROM segments""", "segments")
def _(t):
    rules = rd.compiled_rules({"names": {"die": "DIE", "th(e|an)": r"dh\1", "bad(": "x"}, "note": "skip"})
    return t.segments.select("meeting_id", "ord", tx.apply_rules("text", [(r["pattern"], r["replacement"]) for r in rules]).alias("text"))


@check("s17_profile_tables", "SELECT label AS profile_id, count(*) AS samples, max(len(embedding))::INT AS dims FROM embeddings GROUP BY 1")
def _(t):
    from parlance.operators.people import profile_samples

    prof = t.table("embeddings").select(F.col("label").alias("profile_id")).distinct()
    emb = t.table("embeddings").select(F.col("label").alias("profile_id"), F.col("vec_id").alias("sample_idx"), "embedding")
    return profile_samples(prof, emb).groupBy("profile_id").agg(F.count("*").alias("samples"), F.max(F.size("embedding")).alias("dims"))
