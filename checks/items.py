"""Checked queries for replies, items and corrections."""

from pyspark.sql import functions as F

from checks.adapters import PRELUDE
from checks.registry import check
from parlance.functions import json as js
from parlance.operators import items as it
from parlance.operators import turns as tn

KINDS = ["Decision", "action", "QUESTION", "blocker", "misc", "agreement"]
PRELUDE["replies"] = ("segments", """
SELECT meeting_id, ord, ['decision','task','open_question','risk','thesis','decision'][ord % 6 + 1] AS kind, text, speaker_id, CASE WHEN ord % 5 = 0 THEN '' ELSE trim(left(text, 20)) END AS evidence, printf('%02d:%02d', start_ms // 60000, start_ms // 1000 % 60) AS timestamp,
 CASE ord % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM segments""")


def reply_rows(t):
    """Item rows of every meeting with one JSON object text each (fenced, bare, or wrapped in prose)."""
    o = F.col("ord")
    kinds = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (o % 6 + 1).cast("int"))
    conf = F.when(o % 3 == 0, "HIGH").when(o % 3 == 1, "sure").otherwise("low")
    rows = t.segments.select(
        "meeting_id",
        "ord",
        "text",
        F.struct(
            kinds.alias("type"),
            "text",
            F.col("speaker_id").alias("speaker"),
            F.when(o % 5 == 0, "n/a").otherwise(F.substring("text", 1, 20)).alias("evidence_quote"),
            F.format_string("%02d:%02d", F.floor(F.col("start_ms") / 60000), F.floor(F.col("start_ms") / 1000) % 60).alias("timestamp"),
            F.lit("нет").alias("deadline"),
            conf.alias("confidence"),
        ).alias("item"),
    )
    blank = F.struct(*[(F.lit(" ") if f == "text" else F.lit("x")).alias(f) for f in ("type", "text", "speaker", "evidence_quote", "timestamp", "deadline", "confidence")])
    body = F.to_json(F.struct(F.array("item", blank).alias("items"), F.array(F.lit("None"), F.lit("Ann")).alias("participants")))
    wrapped = F.when(o % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(o % 3 == 1, body).otherwise(F.concat(F.lit("Sure: "), body, F.lit(" end")))
    return rows.select("meeting_id", "ord", "text", wrapped.alias("reply"))


@check("x19_recover_json", "SELECT meeting_id, ord, ord % 4 <> 3 AS ok FROM segments", "segments")
def _(t):
    reply = F.when(F.col("ord") % 4 == 3, F.concat(F.lit("{broken "), F.col("text"))).otherwise(F.col("reply"))
    return reply_rows(t).select("meeting_id", "ord", js.recover_object(reply).isNotNull().alias("ok"))


@check("x20_practical_items", "SELECT meeting_id, ord, kind, text, speaker_id AS speaker, evidence, timestamp, CAST(NULL AS VARCHAR) AS deadline, confidence FROM replies", "replies")
def _(t):
    rows = reply_rows(t).select("meeting_id", "ord", F.inline(js.practical_items(js.recover_object("reply"))))
    return rows.drop("owner")


@check("x17_enum_canonical", "SELECT event_id, CASE event_type WHEN 'view' THEN 'decision' WHEN 'click' THEN 'task' WHEN 'error' THEN 'risk' ELSE 'thesis' END AS kind, CASE WHEN event_type = 'click' THEN 'client' ELSE 'host' END AS party FROM events")
def _(t):
    k = F.when(F.col("event_type") == "view", " Agreement").when(F.col("event_type") == "click", "action_item").when(F.col("event_type") == "error", "BLOCKER").otherwise(F.col("event_type"))
    p = F.when(F.col("event_type") == "click", " Клиента ").otherwise(F.col("event_type"))
    return t.table("events").select("event_id", js.item_kind(k).alias("kind"), js.commitment_party(p).alias("party"))


@check("x18_context_participants", """
SELECT o_orderkey, 'Ann ' || o_custkey || '|Bob' AS names FROM orders""")
def _(t):
    ctx = F.concat(F.lit("Goal\nУчастники  совещания : Ann "), F.col("o_custkey").cast("string"), F.lit(" ; Bob ,, . Rest, of it\nmore"))
    return t.table("orders").select("o_orderkey", F.array_join(js.context_participants(ctx), "|").alias("names"))


@check("u1_unified_items", """
SELECT meeting_id, ord, kind, text, CAST(row_number() OVER (PARTITION BY meeting_id, ord ORDER BY k) - 1 AS INT) AS pos FROM (
 SELECT meeting_id, ord, 0 AS k, kind, text FROM replies WHERE ord % 2 = 0
 UNION ALL SELECT meeting_id, ord, 1, 'decision', 'D ' || ord FROM segments WHERE ord % 2 = 1 UNION ALL SELECT meeting_id, ord, 2, 'task', 'T ' || ord FROM segments WHERE ord % 2 = 1 UNION ALL SELECT meeting_id, ord, 3, 'risk', 'R ' || ord FROM segments WHERE ord % 2 = 1)""", "replies segments")
def _(t):
    o = F.col("ord").cast("string")
    row = lambda p, f: F.array(F.struct(F.concat(F.lit(p), o).alias("text"), F.lit("x").alias(f)))
    flat = F.to_json(F.struct(row("R ", "speaker").alias("risks"), row("T ", "owner").alias("tasks"), row("D ", "speaker").alias("decisions")))
    r = reply_rows(t).select("meeting_id", "ord", F.when(F.col("ord") % 2 == 0, F.col("reply")).otherwise(flat).alias("reply"), F.lit("").alias("context"))
    p = js.administrative_payload("reply", "context")
    return r.select("meeting_id", "ord", p.alias("p")).select("meeting_id", "ord", F.posexplode("p.items").alias("pos", "i")).select("meeting_id", "ord", "i.kind", "i.text", "pos")


@check("u2_topic_union", """
SELECT meeting_id, topic_no, bucket, text, kind FROM (SELECT meeting_id, ord AS topic_no, CAST(0 AS INT) AS bucket, 'D ' || ord AS text, 'decision' AS kind FROM segments WHERE ord % 5 <> 0 UNION ALL SELECT meeting_id, ord, 1, 'T ' || ord, 'task' FROM segments)""", "segments")
def _(t):
    o = F.col("ord")
    dec = F.array(F.struct(F.concat(F.lit("D "), o.cast("string")).alias("text"), F.when(o % 5 == 0, "").otherwise("quote").alias("evidence")))
    task = F.array(F.struct(F.concat(F.lit("T "), o.cast("string")).alias("text"), F.lit("q").alias("evidence"), F.lit("null").alias("deadline")))
    topics = t.segments.select("meeting_id", o.alias("topic_no"), F.to_json(F.struct(dec.alias("decisions"), task.alias("tasks"))).alias("reply"))
    return it.topic_union(topics).select("meeting_id", "topic_no", "bucket", "text", "kind")


@check("u5_first_seen_union", """
SELECT stage, run, ord FROM (SELECT stage, run, ord, row_number() OVER (PARTITION BY stage ORDER BY run, ord) AS rk FROM (SELECT event_type || '_' || (user_id % 13) AS stage, event_id % 7 AS run, event_id AS ord FROM events)) WHERE rk = 1""")
def _(t):
    s = t.table("events").select(F.concat_ws("_", "event_type", (F.col("user_id") % 13).cast("string")).alias("stage"), (F.col("event_id") % 7).alias("run"), F.col("event_id").alias("ord"))
    return it.first_seen_union(s)


@check("o2_item_order", """
SELECT meeting_id, ord, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY CASE WHEN ord % 4 = 0 THEN 1000000000 ELSE start_ms // 60000 * 60 + start_ms // 1000 % 60 END, CASE WHEN ord % 4 = 0 THEN encode(text) ELSE encode('') END, ord) AS INT) AS place FROM segments""", "segments")
def _(t):
    from pyspark.sql import Window

    ts = F.when(F.col("ord") % 4 == 0, "later").otherwise(F.format_string("%02d:%02d", F.floor(F.col("start_ms") / 60000), F.floor(F.col("start_ms") / 1000) % 60))
    rows = t.segments.select("meeting_id", "ord", "text", ts.alias("timestamp"))
    return rows.select("meeting_id", "ord", F.row_number().over(Window.partitionBy("meeting_id").orderBy(*it.item_order(), "ord")).alias("place"))


@check("x22_sectioned_reply", r"""
SELECT conv_id AS reply_id, turn, section, text, assignee FROM (
 SELECT conv_id, turn, 'summary' AS section, trim(line) AS text, CAST(NULL AS VARCHAR) AS assignee FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE trim(line) <> ''
 UNION ALL SELECT conv_id, turn, 'decisions', 'We ' || turn, NULL FROM conversations
 UNION ALL SELECT conv_id, turn, 'tasks', 'Do ' || turn, CASE WHEN turn % 2 = 0 THEN role END FROM conversations)""")
def _(t):
    k = F.col("turn").cast("string")
    bullets = F.replace("text", F.lit("\n"), F.lit("\n- "))
    who = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("net")
    reply = F.concat(
        F.lit("preamble\n### **SUMMARY:**\n- "), bullets, F.lit("\n\n**РЕШЕНИЯ**:\n- We "), k, F.lit("\n* нет\nnot a bullet\n- Note: skip\nACTION ITEMS\n1. Do "), k, F.lit(" | "), who, F.lit(" | -\n- --\n")
    )
    df = t.table("conversations").select(F.struct("conv_id", "turn").alias("reply_id"), reply.alias("reply"))
    return it.sectioned_lines(df).select(F.col("reply_id.conv_id").alias("reply_id"), F.col("reply_id.turn").alias("turn"), "section", "text", "assignee")


@check("x33_polish_invariants", "SELECT meeting_id, ord, ord % 3 = 0 AS ok FROM segments", "segments")
def _(t):
    o = F.col("ord")
    doc = lambda text, who: F.to_json(F.struct(F.array(F.struct(text.alias("text"), who.alias("speaker"), F.lit("e").alias("evidence"))).alias("items"), F.lit("s").alias("summary")))
    orig = doc(F.col("text"), F.col("speaker_id"))
    pol = F.when(o % 3 == 0, doc(F.upper("text"), F.col("speaker_id"))).when(o % 3 == 1, doc(F.col("text"), F.lit("other"))).otherwise(F.lit('{"items": [], "summary": "s"}'))
    return t.segments.select("meeting_id", "ord", js.polish_is_valid(orig, pol).alias("ok"))


@check("x34_context_block", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'COURT_PARTICIPANTS_AND_ROLES:' || chr(10) || o_orderpriority END || CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN chr(10) || chr(10) ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'COURT_DICTIONARY_TERMS:' || chr(10) || o_orderstatus ELSE '' END AS block FROM orders")
def _(t):
    k = F.col("o_orderkey")
    return t.table("orders").select("o_orderkey", js.context_block(F.when(k % 3 != 0, F.col("o_orderpriority")), F.when(k % 2 == 0, F.concat(F.lit(" "), F.col("o_orderstatus")))).alias("block"))


@check("x21_court_payload", "SELECT o_orderkey, 'Стенограмма судебного заседания' || CASE WHEN o_orderkey % 2 = 0 THEN ' № ' || o_orderkey ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' от ' || strftime(o_orderdate, '%d.%m.%Y') ELSE '' END AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'judge' END AS role FROM orders")
def _(t):
    k = F.col("o_orderkey")
    body = F.to_json(
        F.struct(
            F.when(k % 2 == 0, k).alias("case_number"),
            F.when(k % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).alias("hearing_date"),
            F.when(k % 5 == 0, F.create_map(F.lit("S0"), F.lit(" judge "))).alias("speaker_roles"),
        )
    )
    p = js.court_payload(body)
    return t.table("orders").select(k, p.alias("p")).select("o_orderkey", "p.title", F.try_element_at("p.speaker_roles", F.lit("S0")).alias("role"))


@check("x21_client_payload", "SELECT o_orderkey, 'Протокол встречи с клиентом — Client ' || o_custkey AS title, 'client' AS party, CAST(NULL AS VARCHAR) AS deadline FROM orders")
def _(t):
    one = F.array(F.struct(F.lit("Send ").alias("text"), F.lit("Client").alias("party"), F.lit("None").alias("deadline")))
    body = F.to_json(F.struct(F.concat(F.lit("Client "), F.col("o_custkey").cast("string")).alias("client_name"), one.alias("commitments")))
    p = js.client_payload(body)
    return t.table("orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.title", F.inline("p.commitments")).select("o_orderkey", "title", "party", "deadline")


@check("x21_interview_payload", "SELECT o_orderkey, 'C ' || o_custkey AS external_name, o_orderpriority AS strength FROM orders")
def _(t):
    body = F.to_json(
        F.struct(
            F.struct(F.concat(F.lit("C "), F.col("o_custkey").cast("string")).alias("candidate_name"), F.array(F.struct(F.col("o_orderpriority").alias("observation")), F.struct(F.lit("").alias("observation"))).alias("strengths")).alias("internal"),
            F.struct(F.lit(" ").alias("candidate_name")).alias("external"),
        )
    )
    p = js.interview_payload(body)
    return t.table("orders").select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p.external.candidate_name").alias("external_name"), F.col("p.internal.strengths")[0]["observation"].alias("strength"))


PRELUDE["batches"] = ("aligned", """
SELECT *, ord // 6 * 6 AS batch, ord - 1 AS turn_id, row_number() OVER (PARTITION BY meeting_id, ord // 6 ORDER BY ord) - 1 AS pos, coalesce(nullif(speaker_name, ''), speaker_id) AS speaker FROM aligned""")
PRELUDE["corrected"] = ("batches", """
SELECT meeting_id, batch, ord, text, status, CASE WHEN status = 'corrected' THEN trim(text) || ' ok' ELSE trim(text) END AS new_text FROM (
 SELECT *, CASE (meeting_id + batch // 6) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'rejected' ELSE CASE WHEN ord % 4 = 0 THEN CASE WHEN n / (n + has)::DOUBLE < 0.7 THEN 'reverted' ELSE 'corrected' END WHEN ord % 4 = 1 THEN 'reverted' ELSE 'kept' END END AS status FROM (
  SELECT *, len(list_distinct(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1))) AS n, CASE WHEN list_contains(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1), 'ok') THEN 0 ELSE 1 END AS has FROM batches))""")


def corrections(t):
    batched = t.aligned.withColumn("batch", F.floor(F.col("ord") / 6) * 6)
    turns = it.correction_turns(batched)
    changed = F.when(F.col("ord") % 4 == 0, F.concat("text", F.lit(" ok"))).when(F.col("ord") % 4 == 1, "totally different words here instead").otherwise(F.col("text"))
    edited = turns.withColumn("text", changed)
    kind = (F.col("meeting_id") + F.col("batch") / 6).cast("bigint") % 5

    def reply(payloads):
        return payloads

    raw = it.enrich(it.batch_payloads(edited), reply)
    bad = F.when(kind == 0, F.lit("no json at all")).when(kind == 1, F.regexp_replace("raw", '"turn_id":', '"turn":')).when(kind == 2, F.concat(F.lit("```json\n"), "raw", F.lit("\n```"))).otherwise(F.col("raw"))
    return it.validated_corrections(turns, raw.withColumn("raw", bad))


@check("j21_validated_corrections", "SELECT meeting_id, batch, ord, status, new_text FROM corrected", "corrected")
def _(t):
    return corrections(t).select("meeting_id", "batch", "ord", "status", "new_text")


@check("j22_splice_corrections", "SELECT meeting_id, ord, speaker_id, CASE WHEN status IN ('corrected','kept','reverted') THEN new_text ELSE a.text END AS text FROM aligned a JOIN (SELECT meeting_id, ord, status, new_text FROM corrected) c USING (meeting_id, ord)", "aligned corrected")
def _(t):
    return it.splice_corrections(t.aligned, corrections(t)).select("meeting_id", "ord", "speaker_id", "text")


@check("a21_correction_statistics", """
SELECT meeting_id, CAST(sum(n) AS BIGINT) AS total_turns, CAST(sum(c) AS BIGINT) AS corrected_turns, CAST(count_if(s = 'rejected') AS BIGINT) AS rejected_batches, CAST(sum(CASE WHEN s = 'rejected' THEN n ELSE 0 END) AS BIGINT) AS rejected_turns,
 CAST(count_if(s = 'failed') AS BIGINT) AS failed_batches, CAST(sum(cb) AS BIGINT) AS chars_before, CAST(sum(ca) AS BIGINT) AS chars_after FROM (
 SELECT meeting_id, batch, any_value(status) AS s, count(*) AS n, count_if(status = 'corrected') AS c, sum(length(trim(text))) AS cb, sum(length(new_text)) AS ca FROM corrected GROUP BY 1, 2) GROUP BY 1""", "corrected")
def _(t):
    return it.correction_statistics(corrections(t))


@check("f1_enrichment", "SELECT meeting_id, batch, CAST(count(*) AS BIGINT) AS turns FROM batches GROUP BY 1, 2", "batches")
def _(t):
    batched = t.aligned.withColumn("batch", F.floor(F.col("ord") / 6) * 6)
    raw = it.enrich(it.batch_payloads(it.correction_turns(batched)), lambda ps: ps)
    return raw.select("meeting_id", "batch", F.size(js.elements(F.col("raw"), "$")).cast("bigint").alias("turns"))


@check("u4_fuzzy_union")
def _(t):
    rows = t.segments.select("meeting_id", "ord", F.lit("task").alias("kind"), "text", F.substring("text", 1, 30).alias("evidence"), F.format_string("%02d:%02d", F.floor(F.col("start_ms") / 60000), F.floor(F.col("start_ms") / 1000) % 60).alias("timestamp"))
    noisy = rows.withColumn("text", F.when(F.col("ord") % 2 == 0, F.concat("text", F.lit(" indeed"))).otherwise(F.reverse("text"))).withColumn("evidence", F.lit(""))
    return it.fuzzy_union(rows.where("ord % 3 <> 0"), noisy)
