"""Checked queries for quality checks and statistics."""

from pyspark.sql import functions as F

from checks.adapters import PRELUDE
from checks.registry import check
from parlance.operators import quality as ql
from parlance.operators import stats as st

AL = "aligned"
PRELUDE["meetings"] = ("", "SELECT DISTINCT conv_id AS meeting_id FROM conversations UNION ALL SELECT -1 UNION ALL SELECT -2")


def meetings(t):
    ids = t.table("conversations").select(F.col("conv_id").alias("meeting_id")).distinct()
    return ids.union(t.spark.range(-2, 0).toDF("meeting_id"))


@check("a2_speaker_review", """
SELECT a.*, coalesce(b.samples, '') AS samples FROM (
 SELECT meeting_id, speaker_id, count(*) AS turn_count, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS duration_ms, CAST(count_if(coalesce(attribution_confidence < 0.8, false)) AS BIGINT) AS low_confidence_turns,
  arg_min(speaker_name, ord) FILTER (speaker_name <> '') AS speaker_name, arg_min(suggested_speaker_name, ord) FILTER (suggested_speaker_name <> '') AS suggested_speaker_name,
  arg_min(suggested_speaker_confidence, ord) FILTER (suggested_speaker_name <> '') AS suggested_speaker_confidence FROM aligned GROUP BY 1, 2) a
LEFT JOIN (SELECT meeting_id, speaker_id, string_agg(CASE WHEN length(x) > 140 THEN left(x, 140) || '...' ELSE x END, '|' ORDER BY rn) AS samples FROM (
  SELECT meeting_id, speaker_id, trim(text) AS x, row_number() OVER (PARTITION BY meeting_id, speaker_id ORDER BY ord) AS rn FROM aligned WHERE trim(text) <> '') WHERE rn <= 3 GROUP BY 1, 2) b USING (meeting_id, speaker_id)""", AL)
def _(t):
    return st.speaker_review(t.aligned).withColumn("samples", F.array_join("samples", "|"))


@check("a3_speaker_count", """
SELECT meeting_id, detected, lo AS expected_min, hi AS expected_max, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN detected BETWEEN lo AND hi END AS matches, coalesce(lo = hi AND detected <> lo, false) AS exact_conflict FROM (
 SELECT meeting_id, count(DISTINCT speaker_id) AS detected, CASE WHEN meeting_id % 4 <> 0 THEN meeting_id % 3 + 1 END AS lo, CASE WHEN meeting_id % 5 <> 0 THEN meeting_id % 2 + 2 END AS hi FROM aligned GROUP BY 1)""", AL)
def _(t):
    m = F.col("meeting_id")
    exp = t.table("conversations").select(F.col("conv_id").alias("meeting_id")).distinct().select(m, F.when(m % 4 != 0, m % 3 + 1).alias("expected_min"), F.when(m % 5 != 0, m % 2 + 2).alias("expected_max"))
    return st.speaker_count_check(t.aligned, exp)


@check("a4_audio_quality", """
SELECT meeting_id, part_no, greatest(0.0, least(100.0, 100 - CASE WHEN duration_ms < 10000 THEN 50 ELSE 0 END - CASE WHEN duration_ms > 7200000 THEN 10 ELSE 0 END - CASE WHEN sample_rate <> 16000 THEN 5 ELSE 0 END - CASE WHEN channels <> 1 THEN 5 ELSE 0 END))::DOUBLE AS score,
 duration_ms BETWEEN 10000 AND 7200000 AS passed,
 CAST((sample_rate <> 16000)::INT + (channels <> 1)::INT + (codec NOT IN ('pcm_s16le','wav','mp3','aac','flac'))::INT + (file_size = 0 AND duration_ms > 0)::INT AS INT) AS n_warnings FROM audio_meta""", "audio_meta")
def _(t):
    return ql.audio_quality(t.audio_meta).select("meeting_id", "part_no", "score", "passed", F.size("warnings").alias("n_warnings"))


PRELUDE["loopy"] = ("segments", "SELECT meeting_id, ord, start_ms, CASE WHEN ord % 17 = 0 THEN start_ms + 50 ELSE end_ms END AS end_ms, confidence, CASE WHEN ord % 7 = 3 THEN left(text, 40) || left(text, 40) || left(text, 40) || text WHEN ord % 23 = 1 THEN ' ' ELSE text END AS text FROM segments")


def loopy(t):
    o, x = F.col("ord"), F.col("text")
    head = F.substring(x, 1, 40)
    return t.asr.withColumns(
        {
            "text": F.when(o % 7 == 3, F.concat(head, head, head, x)).when(o % 23 == 1, " ").otherwise(x),
            "end_ms": F.when(o % 17 == 0, F.col("start_ms") + 50).otherwise(F.col("end_ms")),
        }
    )


PRELUDE["repeats"] = ("loopy", """
SELECT meeting_id, ord, size, min(i) - 1 AS pos FROM (SELECT meeting_id, ord, x, size, unnest(range(1, length(x) - 2 * size + 1)) AS i FROM (
  SELECT meeting_id, ord, lower(text) AS x, unnest(range(20, 101)) AS size FROM loopy WHERE length(text) >= 100) WHERE length(x) > 2 * size)
WHERE substring(x, i, size) = substring(x, i + size, size) GROUP BY ALL""")


@check("a6_repeated_text", "SELECT meeting_id, ord, CAST(size AS INT) AS size, CAST(pos AS INT) AS first_at FROM repeats", "repeats")
def _(t):
    return ql.repeated_text(loopy(t)).select("meeting_id", "ord", "size", F.col("at").alias("first_at"))


@check("a7_dense_text", "SELECT meeting_id, ord FROM loopy WHERE end_ms > start_ms AND length(text) * 1000 > 200 * (end_ms - start_ms)", "loopy")
def _(t):
    return ql.dense_text(loopy(t)).select("meeting_id", "ord")


def findings():
    return F.array_join(F.transform("findings", lambda f: F.concat(f["severity"], F.lit(" "), f["message"], F.lit("="), f["value"].cast("string"))), ";")


@check("a5_transcript_quality", """
SELECT meeting_id, round(a, 5) AS avg_confidence, mn AS min_confidence, vl AS very_low, em AS empty, sus AS suspect,
 CASE WHEN a IS NULL THEN 0.0 ELSE greatest(0, least(100, 100 - CASE WHEN a < 0.6 THEN 20 ELSE 0 END - CASE WHEN vl > 0 THEN 5 ELSE 0 END - 5 * least(em, 5) - CASE WHEN sus THEN 15 ELSE 0 END)) END::DOUBLE AS score,
 a IS NOT NULL AND a >= 0.6 AND NOT sus AS passed,
 array_to_string(list_filter([CASE WHEN a IS NULL THEN 'critical no segments=' || '0.0' END, CASE WHEN a < 0.6 THEN 'warning low average confidence=' || CAST(round_even(a, 2) AS DOUBLE) END, CASE WHEN sus THEN 'warning repeated or dense text=' || '0.0' END, CASE WHEN vl > 0 THEN 'note segments with very low confidence=' || CAST(vl AS DOUBLE) END, CASE WHEN em > 0 THEN 'note segments without text=' || CAST(em AS DOUBLE) END], lambda x: x IS NOT NULL), ';') AS findings FROM (
 SELECT m.meeting_id, a, mn, vl, em, coalesce(s.meeting_id IS NOT NULL, false) AS sus FROM meetings m
 LEFT JOIN (SELECT meeting_id, avg(confidence) AS a, min(confidence) AS mn, CAST(count_if(confidence < 0.3) AS BIGINT) AS vl, CAST(count_if(trim(text) = '') AS BIGINT) AS em FROM loopy GROUP BY 1) p USING (meeting_id)
 LEFT JOIN (SELECT meeting_id FROM repeats UNION SELECT meeting_id FROM loopy WHERE end_ms > start_ms AND length(text) * 1000 > 200 * (end_ms - start_ms)) s ON s.meeting_id = m.meeting_id)""", "meetings repeats loopy")
def _(t):
    # SQL's round works on the multiple, not on the decimal digits: 0.47812499999999997 gives 0.47813.
    return ql.transcript_quality(meetings(t), loopy(t)).withColumns({"avg_confidence": F.round(F.col("avg_confidence") * 100_000) / 100_000, "findings": findings()})


@check("a8_diarization_quality", """
SELECT m.meeting_id, speakers, short_rows, quiet_speakers, coalesce(g > 2000, false) AS large_gaps,
 CASE WHEN speakers IS NULL THEN 0 ELSE 100 - CASE WHEN speakers < 2 THEN 10 ELSE 0 END - CASE WHEN short_rows > 0 THEN 5 ELSE 0 END - CASE WHEN g > 2000 THEN 10 ELSE 0 END END::DOUBLE AS score, speakers IS NOT NULL AS passed,
 array_to_string(list_filter([CASE WHEN speakers IS NULL THEN 'critical no rows=' || '0.0' END, CASE WHEN speakers < 2 THEN 'note few speakers=' || CAST(speakers AS DOUBLE) END, CASE WHEN short_rows > 0 THEN 'note very short rows=' || CAST(short_rows AS DOUBLE) END, CASE WHEN g > 2000 THEN 'note large gaps=' || CAST(round_even(g, 0) AS DOUBLE) END, CASE WHEN quiet_speakers > 0 THEN 'note speakers with a small share=' || CAST(quiet_speakers AS DOUBLE) END], lambda x: x IS NOT NULL), ';') AS findings
FROM meetings m LEFT JOIN (SELECT meeting_id, count(*) AS speakers, CAST(sum(sh) AS BIGINT) AS short_rows, CAST(count_if(d < 0.05 * tot) AS BIGINT) AS quiet_speakers FROM (
  SELECT meeting_id, speaker_id, sum(end_ms - start_ms) AS d, sum(sum(end_ms - start_ms)) OVER (PARTITION BY meeting_id) AS tot, count_if(end_ms - start_ms < 300) AS sh FROM diarization GROUP BY 1, 2) GROUP BY 1) p USING (meeting_id)
LEFT JOIN (SELECT meeting_id, avg(gap) AS g FROM (SELECT meeting_id, lead(start_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, d_ord) - end_ms AS gap FROM diarization) WHERE gap > 1000 GROUP BY 1) q USING (meeting_id)""", "meetings diarization")
def _(t):
    return ql.diarization_quality(meetings(t), t.diarization).withColumn("findings", findings())


@check("a9_alignment_quality", """
SELECT m.meeting_id, missing_speaker, inverted, out_of_order, empty, coalesce(att, '') AS missing_at,
 CASE WHEN n IS NULL THEN 0 ELSE 100 - CASE WHEN missing_speaker > 0 THEN 50 ELSE 0 END - CASE WHEN out_of_order > 0 THEN 20 ELSE 0 END - CASE WHEN empty > 0 THEN 5 ELSE 0 END END::DOUBLE AS score,
 coalesce(missing_speaker = 0 AND inverted = 0, false) AS passed,
 array_to_string(list_filter([CASE WHEN n IS NULL THEN 'critical no segments=' || '0.0' END, CASE WHEN missing_speaker > 0 THEN 'critical segments without speaker=' || CAST(missing_speaker AS DOUBLE) END, CASE WHEN inverted > 0 THEN 'critical inverted time ranges=' || CAST(inverted AS DOUBLE) END, CASE WHEN out_of_order > 0 THEN 'note segments out of order=' || CAST(out_of_order AS DOUBLE) END, CASE WHEN empty > 0 THEN 'note segments without text=' || CAST(empty AS DOUBLE) END], lambda x: x IS NOT NULL), ';') AS findings FROM meetings m LEFT JOIN (
 SELECT meeting_id, count(*) AS n, CAST(count_if(sp = '') AS BIGINT) AS missing_speaker, CAST(count_if(e < start_ms) AS BIGINT) AS inverted, CAST(count_if(start_ms < pe) AS BIGINT) AS out_of_order, CAST(count_if(trim(text) = '') AS BIGINT) AS empty,
  array_to_string(list_slice(list_sort(list(ord) FILTER (sp = '')), 1, 10), ',') AS att FROM (
  SELECT *, lag(e) OVER (PARTITION BY meeting_id ORDER BY ord) AS pe FROM (SELECT *, CASE WHEN ord % 40 = 0 THEN start_ms - 5 ELSE end_ms + (ord % 19 = 0)::INT * 5000 END AS e, CASE WHEN ord % 3 = 0 AND meeting_id % 2 = 0 THEN '' ELSE speaker_id END AS sp FROM aligned))
 GROUP BY 1) USING (meeting_id)""", "meetings aligned")
def _(t):
    o = F.col("ord")
    al = t.aligned.withColumns(
        {
            "end_ms": F.when(o % 40 == 0, F.col("start_ms") - 5).otherwise(F.col("end_ms") + F.when(o % 19 == 0, 5000).otherwise(0)),
            "speaker_id": F.when((o % 3 == 0) & (F.col("meeting_id") % 2 == 0), "").otherwise(F.col("speaker_id")),
        }
    )
    at = F.coalesce(F.array_join(F.transform("missing_at", lambda x: x.cast("string")), ","), F.lit(""))
    return ql.alignment_quality(meetings(t), al).withColumns({"missing_at": at, "findings": findings()})


@check("a10_protocol_quality", """
SELECT doc_id, greatest(0, 100 - CASE WHEN length(topic) < 3 THEN 10 ELSE 0 END - CASE WHEN length(trim(s, e' \\n')) < 50 THEN 20 ELSE 0 END - CASE WHEN p = 0 THEN 15 ELSE 0 END - CASE WHEN d = 0 THEN 5 ELSE 0 END
 - CASE WHEN k = 0 THEN 5 ELSE 0 END - CASE WHEN x = 0 THEN 10 ELSE 0 END - CASE WHEN length(s) > 5000 THEN 5 ELSE 0 END - CASE WHEN s = '' AND d = 0 AND k = 0 THEN 50 ELSE 0 END)::DOUBLE AS score, NOT (s = '' AND d = 0 AND k = 0) AS passed,
 array_to_string(list_filter([CASE WHEN s = '' AND d = 0 AND k = 0 THEN 'critical no content=' || '50.0' END, CASE WHEN length(topic) < 3 THEN 'note short topic=' || '10.0' END, CASE WHEN length(trim(s, e' \\n')) < 50 THEN 'note short summary=' || '20.0' END, CASE WHEN p = 0 THEN 'note no participants=' || '15.0' END, CASE WHEN d = 0 THEN 'note no decisions=' || '5.0' END, CASE WHEN k = 0 THEN 'note no tasks=' || '5.0' END, CASE WHEN x = 0 THEN 'note no transcript=' || '10.0' END, CASE WHEN length(s) > 5000 THEN 'note long summary=' || '5.0' END], lambda x: x IS NOT NULL), ';') AS findings FROM (
 SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN lang ELSE source END AS topic, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS s, doc_id % 3 AS p, doc_id % 2 AS d, (doc_id // 2) % 2 AS k, doc_id % 5 AS x FROM documents)""")
def _(t):
    i = F.col("doc_id")
    rep = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    df = t.table("documents").select(
        i,
        F.when(i % 7 == 0, F.col("lang")).otherwise(F.col("source")).alias("topic"),
        F.when(i % 4 == 0, "").otherwise(F.col("text")).alias("summary"),
        rep(i % 3).alias("participants"),
        rep(i % 2).alias("decisions"),
        rep(F.floor(i / 2) % 2).alias("tasks"),
        rep(i % 5).alias("transcript"),
        F.array().cast("array<string>").alias("key_topics"),
    )
    return ql.protocol_quality(df).select("doc_id", "score", "passed", findings().alias("findings"))


@check("p5_review_rows", "SELECT meeting_id, ord FROM aligned WHERE attribution_confidence < 0.8", AL)
def _(t):
    return t.aligned.where(st.low_confidence()).select("meeting_id", "ord")


@check("p6_bands", """
SELECT meeting_id, ord, CASE WHEN a IS NULL THEN '' WHEN a >= 0.8 THEN 'ok' WHEN a >= 0.6 THEN 'warn' ELSE 'bad' END AS badge, CASE WHEN confidence < 0.1 THEN 'good' WHEN confidence < 0.3 THEN 'mid' ELSE 'bad' END AS wer_band
FROM (SELECT *, attribution_confidence AS a FROM aligned)""", AL)
def _(t):
    return t.aligned.select("meeting_id", "ord", st.attribution_band().alias("badge"), st.error_rate_band("confidence").alias("wer_band"))


@check("a12_run_statistics", """
SELECT meeting_type, count(*) AS n_segments, count(DISTINCT speaker_id) AS n_speakers, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, round(avg(end_ms - start_ms), 3) AS avg_ms, max(end_ms - start_ms) AS longest_ms,
 count(attribution_confidence) AS n_conf, round(avg(attribution_confidence), 5) AS avg_conf, CAST(count_if(attribution_confidence < 0.6) AS BIGINT) AS contested FROM aligned GROUP BY 1""", AL)
def _(t):
    out = st.run_statistics(t.aligned, ["meeting_type"])
    return out.withColumns({"avg_ms": F.round("avg_ms", 3), "avg_conf": F.round("avg_conf", 5)})


@check("a13_confidence_histogram", """
SELECT meeting_type, band, n, round_even(100::DOUBLE * n / sum(n) OVER w, 1) AS pct, round_even(sum(s) OVER w / sum(n) OVER w, 3) AS mean FROM (
 SELECT meeting_type, CASE WHEN a >= 1.0 THEN '[1.00]' WHEN a >= 0.8 THEN '[0.80, 1.00)' WHEN a >= 0.6 THEN '[0.60, 0.80)' ELSE '[0.00, 0.60)' END AS band, count(*) AS n, sum(a) AS s
 FROM (SELECT *, attribution_confidence AS a FROM aligned) WHERE a IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY meeting_type)""", AL)
def _(t):
    return st.confidence_histogram(t.aligned, ["meeting_type"])


@check("a14_corpus_statistics", """
SELECT lang AS recording_id, source AS speaker, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words
FROM documents GROUP BY GROUPING SETS ((lang, source), (lang))""")
def _(t):
    return st.corpus_statistics(t.table("documents").select(F.col("lang").alias("recording_id"), F.col("source").alias("speaker"), "text"))


@check("a15_source_header", """
SELECT source, count(*) AS turns, count(DISTINCT speaker_id) AS speakers, max(end_ms) AS max_end_ms FROM (SELECT 'asr' AS source, speaker_id, end_ms FROM segments UNION ALL SELECT 'diarization', speaker_id, end_ms FROM diarization) GROUP BY 1""", "segments diarization")
def _(t):
    both = t.segments.select(F.lit("asr").alias("source"), "speaker_id", "end_ms").union(t.diarization.select(F.lit("diarization").alias("source"), "speaker_id", "end_ms"))
    return st.source_header(both)


@check("a16_script_language", r"""
SELECT meeting_id, cyrillic, latin, CASE WHEN cyrillic + latin = 0 OR 2 * cyrillic >= cyrillic + latin THEN 'ru' ELSE 'en' END AS language FROM (
 SELECT meeting_id, CAST(sum(length(regexp_replace(x, '[^\x{0400}-\x{04FF}]', '', 'g'))) AS BIGINT) AS cyrillic, CAST(sum(length(regexp_replace(lower(x), '[^a-z]', '', 'g'))) AS BIGINT) AS latin FROM (
  SELECT meeting_id, CASE WHEN meeting_id % 3 = 0 THEN translate(lower(text), 'aeiounrst', 'аеиоунрст') ELSE text END AS x FROM segments) GROUP BY 1)""", "segments")
def _(t):
    x = F.when(F.col("meeting_id") % 3 == 0, F.translate(F.lower("text"), "aeiounrst", "аеиоунрст")).otherwise(F.col("text"))
    return st.script_language(t.segments.select("meeting_id", x.alias("text")))


@check("a17_language_mix", """
SELECT m.meeting_id, coalesce(p, 'ru') AS primary, round(coalesce(ru, 1.0), 5) AS ru_probability, round(coalesce(en, 0.0), 5) AS en_probability, coalesce(n, 0) AS windows, coalesce(en, 0) >= 0.2 AS mixed FROM meetings m LEFT JOIN (
 SELECT meeting_id, CAST(sum(k) AS BIGINT) AS n, arg_max(lang, k * 100000 - fw) AS p, sum(ru) / sum(k) AS ru, sum(en) / sum(k) AS en FROM (
  SELECT conv_id AS meeting_id, CASE role WHEN 'user' THEN 'ru' WHEN 'assistant' THEN 'en' ELSE 'de' END AS lang, count(*) AS k, min(turn) AS fw, sum((turn * 13 % 10) / 10.0) AS ru, sum((turn * 7 % 5) / 10.0) AS en FROM conversations GROUP BY 1, 2) GROUP BY 1) USING (meeting_id)""", "meetings")
def _(t):
    r = F.col("role")
    wins = t.table("conversations").select(
        F.col("conv_id").alias("meeting_id"),
        F.col("turn").alias("win"),
        F.when(r == "user", "ru").when(r == "assistant", "en").otherwise("de").alias("lang"),
        (F.col("turn") * 13 % 10 / F.lit(10.0)).alias("ru_p"),
        (F.col("turn") * 7 % 5 / F.lit(10.0)).alias("en_p"),
    )
    out = st.language_mix(meetings(t), wins)
    return out.withColumns({c: F.round(c, 5) for c in ("ru_probability", "en_probability")})


@check("a18_sampling_windows", """
SELECT meeting_id, part_no, CAST(w AS INT) AS win, round(CASE WHEN duration_ms <= 30000 THEN 0 ELSE (duration_ms - 30000) * w / 5.0 END, 3)::DOUBLE AS offset_ms FROM (
 SELECT meeting_id, part_no, duration_ms, unnest(CASE WHEN duration_ms <= 30000 THEN [0] ELSE range(6) END) AS w FROM audio_meta)""", "audio_meta")
def _(t):
    return st.sampling_windows(t.audio_meta).select("meeting_id", "part_no", "win", F.round("offset_ms", 3).alias("offset_ms"))


@check("a19_protocol_sparsity", """
SELECT meeting_id, duration_ms, n AS total_items, e AS expected_min, duration_ms >= 1800000 AND n < e AS sparse, duration_ms >= 1800000 AND n < r AS needs_recall FROM (
 SELECT meeting_id, (mx - mn) * 20 AS duration_ms, n, greatest(8, CAST(floor((mx - mn) * 20 / 300000.0) AS BIGINT)) AS e, greatest(12, CAST(ceil((mx - mn) * 20 * 15 / 3600000.0) AS BIGINT)) AS r FROM (
  SELECT meeting_id, min(start_ms) AS mn, max(end_ms) AS mx, CAST(count_if(ord % 2 = 0) AS BIGINT) AS n FROM segments GROUP BY 1))""", "segments")
def _(t):
    spans = t.segments.groupBy("meeting_id").agg(((F.max("end_ms") - F.min("start_ms")) * 20).alias("duration_ms"))
    return st.protocol_sparsity(t.segments.where("ord % 2 = 0"), spans)


@check("a20_item_counts_delta", """
SELECT k.kind, coalesce(o, 0) AS old_count, coalesce(n, 0) AS new_count, coalesce(n, 0) - coalesce(o, 0) AS delta FROM (VALUES ('view'), ('click'), ('error'), ('absent')) k(kind)
LEFT JOIN (SELECT event_type AS kind, CAST(count_if(user_id % 2 = 0) AS BIGINT) AS o, CAST(count_if(user_id % 2 = 1) AS BIGINT) AS n FROM events GROUP BY 1) USING (kind)""")
def _(t):
    items = t.table("events").select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 2 == 0, "before").otherwise("after").alias("run_id"))
    return st.item_counts_delta(items, "before", "after", ["view", "click", "error", "absent"])


@check("a22_duplicates", "SELECT lang, text, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return st.duplicates(t.table("documents"), ["lang"])


@check("a30_stage_shares", """
SELECT o_orderpriority AS run_id, o_orderstatus AS stage, CAST(sum(o_custkey) AS BIGINT) AS elapsed_ms, max(o_orderkey) AS audio_ms, max(o_totalprice) AS peak,
 round_even(100::DOUBLE * sum(o_custkey) / sum(sum(o_custkey)) OVER (PARTITION BY o_orderpriority), 1) AS share_pct, round_even(max(o_orderkey)::DOUBLE / sum(o_custkey), 2) AS real_time_factor FROM orders GROUP BY 1, 2""")
def _(t):
    tm = t.table("orders").select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderstatus").alias("stage"), F.col("o_custkey").alias("elapsed_ms"), F.col("o_orderkey").alias("audio_ms"), F.col("o_totalprice").alias("peak")
    )
    return st.stage_shares(tm)


@check("a32_display_summary", "SELECT meeting_id, count(DISTINCT coalesce(nullif(speaker_name, ''), speaker_id)) AS speakers, count(*) AS turns, max(start_ms) - min(start_ms) AS span_ms FROM aligned GROUP BY 1", AL)
def _(t):
    return st.display_summary(t.aligned)


@check("j24_share_delta", """
SELECT meeting_id, speaker_id, coalesce(o, 0) AS old_share, coalesce(n, 0) AS new_share, round_even(coalesce(n, 0) - coalesce(o, 0), 1) AS delta FROM
 (SELECT meeting_id, speaker_id, round_even(100::DOUBLE * sum(end_ms - start_ms) / sum(sum(end_ms - start_ms)) OVER (PARTITION BY meeting_id), 1) AS o FROM segments GROUP BY 1, 2)
 FULL JOIN (SELECT meeting_id, speaker_id, round_even(100::DOUBLE * sum(end_ms - start_ms) / sum(sum(end_ms - start_ms)) OVER (PARTITION BY meeting_id), 1) AS n FROM diarization GROUP BY 1, 2) USING (meeting_id, speaker_id)""", "segments diarization")
def _(t):
    return st.share_delta(t.segments, t.diarization)


@check("j23_side_by_side", """
SELECT a.meeting_id, a.rn, coalesce(x, '') AS all_rows, coalesce(y, '') AS user_rows FROM (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS rn, text AS x FROM segments) a
FULL JOIN (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS rn, text AS y FROM segments WHERE speaker_id = 'user') b ON a.meeting_id = b.meeting_id AND a.rn = b.rn""", "segments")
def _(t):
    return st.side_by_side({"all_rows": t.segments, "user_rows": t.segments.where("speaker_id = 'user'")}, ["meeting_id"], "ord", "text")


@check("o5_first_rows", """
SELECT a.meeting_id, a.rn, coalesce(x, '') AS all_rows, coalesce(y, '') AS user_rows FROM (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS rn, text AS x FROM segments) a
LEFT JOIN (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS rn, text AS y FROM segments WHERE speaker_id = 'user') b ON a.meeting_id = b.meeting_id AND a.rn = b.rn WHERE a.rn <= 10""", "segments")
def _(t):
    return st.side_by_side({"all_rows": t.segments, "user_rows": t.segments.where("speaker_id = 'user'")}, ["meeting_id"], "ord", "text", first=10)
