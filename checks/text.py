"""Checked queries for text functions (whole texts of the given tables)."""

from pyspark.sql import functions as F

from checks.adapters import PRELUDE
from checks.registry import check
from parlance.functions import text as tx

NW = r"[^\p{L}\p{N}_]"
PRELUDE["spoken"] = ("", """
SELECT conv_id AS meeting_id, turn, CASE turn % 8
  WHEN 0 THEN 'um, ' || text WHEN 1 THEN 'you know ' || replace(text, '. ', '. uhm ') WHEN 2 THEN replace(text, ', ', ',, like ')
  WHEN 3 THEN '- , ' || replace(text, '. ', '. - ') WHEN 4 THEN 'go on go on go on ' || text WHEN 5 THEN '1:02:03 ' || text
  WHEN 6 THEN text || ' Thanks for watching!' ELSE replace(text, '.', ' .') || ',, ' END AS text FROM conversations
 UNION ALL SELECT conv_id, -turn - 1, CASE turn % 3 WHEN 0 THEN '1:02:03 ' || role WHEN 1 THEN 'Thanks for watching!' ELSE ' -' END FROM conversations""")


def spoken(t):
    x = F.col("text")
    k = F.col("turn") % 8
    rep = lambda a, b: F.replace(x, F.lit(a), F.lit(b))
    whole = t.table("conversations").select(
        F.col("conv_id").alias("meeting_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(k == 0, F.concat(F.lit("um, "), x))
        .when(k == 1, F.concat(F.lit("you know "), rep(". ", ". uhm ")))
        .when(k == 2, rep(", ", ",, like "))
        .when(k == 3, F.concat(F.lit("- , "), rep(". ", ". - ")))
        .when(k == 4, F.concat(F.lit("go on go on go on "), x))
        .when(k == 5, F.concat(F.lit("1:02:03 "), x))
        .when(k == 6, F.concat(x, F.lit(" Thanks for watching!")))
        .otherwise(F.concat(rep(".", " ."), F.lit(",, ")))
        .alias("text"),
    )
    # What recognisers leave between turns: rows of their own beside the whole texts.
    left = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("1:02:03 "), "role")).when(F.col("turn") % 3 == 1, "Thanks for watching!").otherwise(" -")
    return whole.unionByName(t.table("conversations").select(F.col("conv_id").alias("meeting_id"), (-F.col("turn") - 1).cast("long").alias("turn"), left.alias("text")))


def filler_sql(col: str) -> str:
    out = col
    for w in sorted(tx.EN_FILLERS, key=len, reverse=True):
        for _ in range(2):
            out = f"regexp_replace({out}, '(?i)(^|{NW}){w}({NW}|$)', '\\1\\2', 'g')"
    out = rf"regexp_replace({out}, '\s{{2,}}', ' ', 'g')"
    out = rf"trim({out}, e' \t\n\r')"
    out = rf"regexp_replace({out}, '^[,.\s]+', '')"
    out = rf"regexp_replace({out}, '[,\s]+$', '')"
    for ch in [".", ",", "!", "?"]:
        out = rf"regexp_replace({out}, '[{ch}](?:\s*[{ch}]+)', '{ch}', 'g')"
    return rf"trim({out}, e' \t\n\r')"


@check("x1_clean_fillers", f"SELECT meeting_id, turn, {filler_sql('text')} AS text FROM spoken", "spoken")
def _(t):
    return spoken(t).select("meeting_id", "turn", tx.clean_fillers("text", "en").alias("text"))


@check("x2_remove_repeats")  # back-references: no SQL twin, tests compare with a regular expression engine
def _(t):
    return spoken(t).select("meeting_id", "turn", tx.remove_repeats("text").alias("text"))


@check("x3_drop_artifacts", r"""
SELECT meeting_id, turn, CASE WHEN length(trim(text)) <= 30 AND (regexp_matches(trim(text), '^\d{1,2}:\d{2}:\d{2}(\s|[.,!?])')
  OR trim(lower(trim(text)), '.!?,;:- ') IN ('subscribe','thanks for watching','like and subscribe','see you next time')) THEN '' ELSE text END AS text FROM spoken""", "spoken")
def _(t):
    return spoken(t).select("meeting_id", "turn", tx.drop_artifacts("text").alias("text"))


@check("p4_meaningful", "SELECT meeting_id, turn FROM spoken WHERE length(trim(text)) >= 3", "spoken")
def _(t):
    return spoken(t).where(tx.is_meaningful("text")).select("meeting_id", "turn")


@check("x4_capitalize_sentences", r"""
SELECT meeting_id, turn, CASE WHEN regexp_matches(j, '^\p{L}') THEN upper(j[1]) || j[2:] ELSE j END AS text FROM (
 SELECT meeting_id, turn, list_aggregate(list_transform(string_split(m, chr(57344)), lambda s, i: CASE WHEN i = 1 THEN s ELSE upper(s[1]) || s[2:] END), 'string_agg', '') AS j FROM (
  SELECT meeting_id, turn, regexp_replace(text, '([.!?])\s+([a-zA-Zа-яА-ЯёЁ])', '\1 ' || chr(57344) || '\2', 'g') AS m FROM spoken))""", "spoken")
def _(t):
    return spoken(t).select("meeting_id", "turn", tx.capitalize_sentences("text").alias("text"))


NORM_TURN = r"""
SELECT meeting_id, turn, CASE WHEN regexp_matches(k, '^\p{Ll}') THEN upper(k[1]) || k[2:] ELSE k END AS text FROM (
 SELECT meeting_id, turn, regexp_replace(regexp_replace(j, ',(?:\s*,)+', ',', 'g'), '^[—–,-][\s,—–-]+', '') AS k FROM (
 SELECT meeting_id, turn, list_aggregate(list_transform(string_split(m, chr(57344)), lambda s, i: CASE WHEN i = 1 THEN s ELSE upper(s[1]) || s[2:] END), 'string_agg', '') AS j FROM (
  SELECT meeting_id, turn, regexp_replace(text, '([.!?…])\s+[—–-][\s,—–-]*(\S)', '\1 ' || chr(57344) || '\2', 'g') AS m FROM spoken)))"""


@check("x5_normalize_turn", NORM_TURN, "spoken")
def _(t):
    return spoken(t).select("meeting_id", "turn", tx.normalize_turn("text").alias("text"))


@check("x6_cleanup_joined", r"SELECT meeting_id, turn, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s+([,.!?;:])', '\1', 'g')) AS text FROM spoken", "spoken")
def _(t):
    return spoken(t).select("meeting_id", "turn", tx.cleanup_joined("text").alias("text"))


@check("x7_seam_polish", r"""
SELECT meeting_id, ord, gap,
  CASE WHEN NOT regexp_matches(p, '[.!?…,;:—–-]$') AND gap >= 600 AND regexp_matches(p, '[\p{L}\p{N}]$') THEN p || '.' ELSE p END AS left_text,
  CASE WHEN regexp_matches(p, '[.!?…]$') THEN up WHEN regexp_matches(p, '[,;:—–-]$') THEN lo WHEN gap >= 600 THEN up WHEN gap <= 150 THEN lo ELSE n END AS right_text FROM (
 SELECT *, CASE WHEN regexp_matches(n, '^\p{Ll}') THEN upper(n[1]) || n[2:] ELSE n END AS up,
           CASE WHEN regexp_matches(n, '^\p{Lu}') THEN lower(n[1]) || n[2:] ELSE n END AS lo FROM (
  SELECT meeting_id, ord, ord * 37 % 1000 AS gap, text AS n, CASE WHEN ord % 4 = 0 THEN rtrim(text, '.!?') WHEN ord % 4 = 1 THEN rtrim(text, '.!?') || ',' ELSE text END AS p FROM segments))""", "segments")
def _(t):
    x = F.col("text")
    k = F.col("ord") % 4
    bare = F.regexp_replace(x, "[.!?]+$", "")
    df = t.segments.select(
        "meeting_id", "ord", (F.col("ord") * 37 % 1000).alias("gap"), x.alias("n"), F.when(k == 0, bare).when(k == 1, F.concat(bare, F.lit(","))).otherwise(x).alias("p")
    )
    p, n, g = F.col("p"), F.col("n"), F.col("gap")
    return df.select("meeting_id", "ord", "gap", F.concat(p, tx.seam_suffix(p, g)).alias("left_text"), tx.seam_case(p, n, g).alias("right_text"))


RULES = [("die", "DIE"), ("th(e|an)", "dh$1"), ("que", "QUE")]


@check("x8_rule_rewriting", rf"""
SELECT meeting_id, ord, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(^|{NW})die({NW}|$)', '\1DIE\2', 'g'), '(^|{NW})die({NW}|$)', '\1DIE\2', 'g'), 'th(e|an)', 'dh\1', 'g'),
 '(^|{NW})que({NW}|$)', '\1QUE\2', 'g'), '(^|{NW})que({NW}|$)', '\1QUE\2', 'g') AS text FROM segments""", "segments")
def _(t):
    rules = [(tx.rule_pattern(k), v) for k, v in RULES]
    return t.segments.select("meeting_id", "ord", tx.apply_rules("text", rules).alias("text"))


@check("x9_scoring_normalise", r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'é', 'e' || chr(769)) ELSE text END)), 'ё', 'е'), '[\p{P}\p{S}]', ' ', 'g'), '[\s\x0b\x85\x{a0}]+', ' ', 'g')) AS text FROM documents")
def _(t):
    # Every other text holds decomposed letters.
    apart = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("é"), F.lit("e\u0301"))).otherwise(F.col("text"))
    return t.table("documents").select("doc_id", tx.scoring_normalise(apart).alias("text"))


@check("x10_trailing_punct", r"""
SELECT punct, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT norm) AS BIGINT) AS norms FROM (
 SELECT norm, CASE WHEN contains(c, '?') THEN '?' WHEN contains(c, '!') THEN '!' WHEN contains(c, '.') THEN '.' ELSE right(c, 1) END AS punct FROM (
  SELECT regexp_replace(replace(lower(w), 'ё', 'е'), '[\p{P}\p{S}]', '', 'g') AS norm,
   regexp_replace(replace(regexp_extract(w, '([\p{P}\p{S}]+)$', 1), '…', '.'), '[^.!?,;:]', '', 'g') AS c
  FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE w <> '')) WHERE norm <> '' GROUP BY punct""")
def _(t):
    w = t.table("documents").select(F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("w")).where("w <> ''")
    out = w.select(tx.token_normalise("w").alias("norm"), tx.trailing_punct("w").alias("punct")).where("norm <> ''")
    return out.groupBy("punct").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("norms"))


@check("x11_first_alpha_case", r"""
SELECT meeting_id, kase, CAST(count(*) AS BIGINT) AS n FROM (SELECT meeting_id, CASE WHEN l = '' THEN NULL WHEN regexp_matches(l, '\p{Lu}') THEN 'U' ELSE 'L' END AS kase
 FROM (SELECT meeting_id, regexp_extract(word, '(\p{L})', 1) AS l FROM words)) GROUP BY ALL""", "words")
def _(t):
    return t.words.select("meeting_id", tx.first_alpha_case("word").alias("kase")).groupBy("meeting_id", "kase").agg(F.count("*").alias("n"))


@check("x12_token_overlap", r"""
SELECT meeting_id, ord, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 4) AS overlap FROM (
 SELECT meeting_id, ord, list_distinct(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)) AS a, list_distinct(regexp_extract_all(lower(p), '([\p{L}\p{N}_]+)', 1)) AS b
 FROM (SELECT meeting_id, ord, text, left(text, CAST(greatest(0, length(text) - ord % 40) AS INT)) || ' zz' AS p FROM segments))""", "segments")
def _(t):
    df = t.segments.withColumn("p", F.expr("concat(left(text, cast(greatest(0, length(text) - ord % 40) as int)), ' zz')"))
    return df.select("meeting_id", "ord", F.round(tx.token_overlap("text", "p"), 4).alias("overlap"))


@check("x13_item_normalise", r"SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^0-9a-z\x{0400}-\x{04ff}]+', ' ', 'g')) AS text FROM documents")
def _(t):
    return t.table("documents").select("doc_id", tx.item_normalise("text").alias("text"))


@check("x14_timestamp_parse", r"""
SELECT event_id, CASE WHEN s <> '' THEN (CASE WHEN h = '' THEN 0 ELSE CAST(h AS BIGINT) END) * 3600 + CAST(m AS BIGINT) * 60 + CAST(s AS BIGINT) END AS seconds FROM (
 SELECT event_id, regexp_extract(x, p, 1) AS h, regexp_extract(x, p, 2) AS m, regexp_extract(x, p, 3) AS s FROM (
  SELECT event_id, '(?:(\d{1,2}):)?(\d{1,2}):(\d{2})' AS p, CASE event_id % 3 WHEN 0 THEN 'at ' || strftime(ts, '%H:%M:%S') WHEN 1 THEN '[' || strftime(ts, '%M:%S') || ']' ELSE 'none ' || event_id END AS x FROM events))""")
def _(t):
    k = F.col("event_id") % 3
    x = (
        F.when(k == 0, F.concat(F.lit("at "), F.date_format("ts", "HH:mm:ss")))
        .when(k == 1, F.concat(F.lit("["), F.date_format("ts", "mm:ss"), F.lit("]")))
        .otherwise(F.concat(F.lit("none "), F.col("event_id").cast("string")))
    )
    return t.table("events").select("event_id", tx.timestamp_seconds(x).alias("seconds"))


@check("x15_timestamp_formats", r"""
SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS hms, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS h_mm_ss,
 CASE WHEN r >= 3600 THEN printf('[%02d:%02d:%02d]', r // 3600, r % 3600 // 60, r % 60) ELSE printf('[%02d:%02d]', r // 60, r % 60) END AS bracket,
 printf('[%02d:%02d]', r // 60, r % 60) AS minutes,
 printf('%02d:%02d:%05.2f', s // 3600, s % 3600 // 60, (ms % 60000) / 1000.0) AS hundredths FROM (
 SELECT event_id, ms, ms // 1000 AS s, CAST(round_even(ms / 1000.0, 0) AS BIGINT) AS r FROM (SELECT event_id, event_id * 530 AS ms FROM events))""")
def _(t):
    ms = F.col("event_id") * 530
    return t.table("events").select(
        "event_id",
        tx.hms_floor(ms).alias("hms"),
        tx.h_mm_ss(ms).alias("h_mm_ss"),
        tx.bracket_stamp(ms).alias("bracket"),
        tx.bracket_stamp(ms, F.lit(False)).alias("minutes"),
        tx.hms_hundredths(ms).alias("hundredths"),
    )


@check("x16_clean_null", "SELECT event_id, CASE WHEN lower(trim(v)) IN ('нет','none','null','n/a','-') THEN '' ELSE trim(v) END AS v FROM (SELECT event_id, ['  None ', 'n/a', event_type, '-', ' ok '][event_id % 5 + 1] AS v FROM events)")
def _(t):
    v = F.element_at(F.array(F.lit("  None "), F.lit("n/a"), F.col("event_type"), F.lit("-"), F.lit(" ok ")), (F.col("event_id") % 5 + 1).cast("int"))
    return t.table("events").select("event_id", tx.clean_null(v).alias("v"))


@check("x23_clean_markup", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(x, '<|im_end|>', ''), '<|user|>', ''), '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*', '', 'g'), e' \t\n\r') AS text FROM (
 SELECT page_id, '<|user|>' || replace(replace(html, '<script>', '<think>'), '</script>', '</think>') || CASE WHEN page_id % 3 = 0 THEN '<|im_end|><think>open' ELSE '' END AS x FROM pages)""")
def _(t):
    h = F.replace(F.replace("html", F.lit("<script>"), F.lit("<think>")), F.lit("</script>"), F.lit("</think>"))
    x = F.concat(F.lit("<|user|>"), h, F.when(F.col("page_id") % 3 == 0, "<|im_end|><think>open").otherwise(""))
    return t.table("pages").select("page_id", tx.clean_markup(x).alias("text"))


@check("p11_noise_items", """
SELECT meeting_id, ord, x IN ('','--','---','—','–','-','**','***') OR starts_with(x, 'Note:') OR starts_with(x, '*Note') OR starts_with(x, '**Note') AS noise
FROM (SELECT meeting_id, ord, CASE ord % 5 WHEN 0 THEN '--' WHEN 1 THEN 'Note: ' || text WHEN 2 THEN '' WHEN 3 THEN '**Note**' ELSE text END AS x FROM segments)""", "segments")
def _(t):
    k = F.col("ord") % 5
    x = F.when(k == 0, "--").when(k == 1, F.concat(F.lit("Note: "), F.col("text"))).when(k == 2, " ").when(k == 3, "**Note**").otherwise(F.col("text"))
    return t.segments.select("meeting_id", "ord", tx.is_noise(x).alias("noise"))


@check("x24_safe_names", r"""
SELECT page_id, CASE WHEN b = '' THEN 'meeting' ELSE b END AS base, CASE WHEN u = '' THEN 'default' ELSE u END AS username FROM (
 SELECT page_id, trim(regexp_replace(regexp_replace(CASE WHEN regexp_matches(nm, '^.+\.[^.]*$') THEN regexp_replace(nm, '^(.+)\.[^.]*$', '\1') ELSE nm END, '[^A-Za-z0-9_\-.]', '_', 'g'), '_+', '_', 'g'), '_.') AS b,
   trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .') AS u
 FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS nm FROM pages))""")
def _(t):
    return t.table("pages").select("page_id", tx.safe_basename("url").alias("base"), tx.safe_username("url").alias("username"))


@check("x25_twin_summary", r"""
SELECT doc_id, CASE WHEN length(x) < 100 THEN false ELSE contains(c[201:], c[1:200]) OR left(trim(c[1:length(c)//2]), 150) = left(trim(c[length(c)//2+1:]), 150) END AS twin FROM (
 SELECT doc_id, x, trim(regexp_replace(x, '[\s\x0b\x85\x{a0}]+', ' ', 'g')) AS c FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' ' || text ELSE text END AS x FROM documents))""")
def _(t):
    x = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text"))
    return t.table("documents").select("doc_id", tx.is_twin_summary(x).alias("twin"))


@check("x26_group_thousands", r"""
SELECT l_orderkey, l_linenumber, 'sum ' || replace(format('{:,}', CAST(round(l_extendedprice * 100) AS BIGINT)), ',', chr(160)) || ' of item' || l_partkey * 10000 AS text
FROM lineitem""")
def _(t):
    x = F.concat(F.lit("sum "), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), F.lit(" of item"), (F.col("l_partkey") * 10000).cast("string"))
    return t.table("lineitem").select("l_orderkey", "l_linenumber", tx.group_thousands(x).alias("text"))


@check("x27_context_tier", """
SELECT doc_id, est, CASE WHEN 65536 >= need THEN 65536 WHEN 131072 >= need THEN 131072 ELSE 262144 END::BIGINT AS tier FROM (
 SELECT doc_id, est, CAST(floor((est + 8192) * 1.15::DOUBLE) AS BIGINT) AS need FROM (SELECT doc_id, greatest(1, CAST(floor(length(text) * 20 / 3.2::DOUBLE) AS BIGINT)) AS est FROM documents))""")
def _(t):
    df = t.table("documents").select("doc_id", tx.token_estimate(F.length("text") * 20).alias("est"))
    return df.select("doc_id", "est", tx.context_tier(F.col("est"), 8192).alias("tier"))


@check("x31_segment_confidence", """
SELECT meeting_id, ord, round(CASE WHEN ord % 4 = 0 AND ord % 10 = 0 THEN 0 WHEN ord % 4 = 0 THEN exp(-(ord % 10) / 5.0) ELSE coalesce(m, 0) END, 5) AS confidence
FROM segments LEFT JOIN (SELECT meeting_id, seg_ord AS ord, avg(confidence) AS m FROM words GROUP BY 1, 2) USING (meeting_id, ord)""", "segments words")
def _(t):
    ws = F.filter(F.split("text", " "), lambda w: w != "")
    conf = F.transform(ws, lambda w, i: (F.col("ord") * 7 + i * 3) % 100 / F.lit(100.0))
    none = F.array().cast("array<double>")
    c = tx.mean_confidence(F.when(F.col("ord") % 4 == 0, none).otherwise(conf), -(F.col("ord") % 10) / F.lit(5.0))
    return t.segments.select("meeting_id", "ord", F.round(c, 5).alias("confidence"))


@check("x32_readable_label", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Спикер #' || (event_id % 30) ELSE event_type END AS label FROM events")
def _(t):
    x = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Speaker_"), F.lpad((F.col("event_id") % 30).cast("string"), 3, "0"))).otherwise(F.col("event_type"))
    return t.table("events").select("event_id", tx.readable_label(x).alias("label"))


@check("p9_unresolved_speakers", "SELECT DISTINCT label FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'SPEAKER ' || (event_id % 30) ELSE event_type END AS label FROM events) WHERE regexp_matches(label, '(?i)^speaker[\\s_-]?\\d+$')")
def _(t):
    x = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("SPEAKER "), (F.col("event_id") % 30).cast("string"))).otherwise(F.col("event_type"))
    df = t.table("events").select(x.alias("label"))
    return df.where(tx.is_unresolved("label")).distinct()


CAPS_SQL = r"""
SELECT meeting_id, ord, {out} FROM (SELECT meeting_id, ord, list_filter(string_split({src}, ' '), lambda w: w <> '') AS ws FROM segments)"""


def caps_expr(ws):
    cap = r"CASE WHEN regexp_matches(w, '\p{L}') THEN regexp_extract(w, '^([^\p{L}]*)', 1) || upper(regexp_extract(w, '(\p{L})', 1)) || regexp_extract(w, '^[^\p{L}]*\p{L}(.*)$', 1) ELSE w END"
    ends = rf"regexp_matches(regexp_replace({ws}[i-1], '[\"»'')\]]+$', ''), '[.!?…]$')"
    return f"array_to_string(list_transform({ws}, lambda w, i: CASE WHEN i = 1 OR {ends} THEN {cap} ELSE w END), ' ')"


@check("x29_casing_variants", "SELECT a.meeting_id, a.ord, a.lowered, b.overlaid FROM (" + CAPS_SQL.format(out=caps_expr("ws") + " AS lowered", src="lower(text)") + ") a JOIN ("
       + CAPS_SQL.format(out=caps_expr("ws") + " AS overlaid", src="text") + ") b USING (meeting_id, ord)", "segments")
def _(t):
    return t.segments.select("meeting_id", "ord", tx.sentence_caps("text", lower=True).alias("lowered"), tx.sentence_caps("text").alias("overlaid"))


@check("x28_proportional_cut", r"""
SELECT meeting_id, ord, CASE WHEN approx <= 0 OR approx >= n THEN approx ELSE coalesce(arg_min, approx) END AS cut FROM (
 SELECT *, list_aggregate(list_transform(list_filter(range(greatest(1, approx - win), least(n - 1, approx + win) + 1), lambda i: text[i+1] = ' '), lambda i: abs(i - approx) * 1000000 + i), 'min') % 1000000 AS arg_min FROM (
  SELECT meeting_id, ord, text, CAST(length(text) AS BIGINT) AS n, CAST(round_even(length(text) * least(1.0, greatest(0.0, (end_ms - 700 - start_ms)::DOUBLE / (end_ms - start_ms))), 0) AS BIGINT) AS approx,
   greatest(8, least(40, length(text) // 8)) AS win FROM segments))""", "segments")
def _(t):
    cut = tx.cut_near(F.col("text"), F.col("start_ms"), F.col("end_ms"), F.col("end_ms") - 700)
    return t.segments.select("meeting_id", "ord", cut.cast("bigint").alias("cut"))


@check("x30_timestamp_text", r"""
SELECT meeting_id, ord, k, a + off AS start_ms, CASE WHEN b <= a THEN least(a + 500, 30000) ELSE b END + off AS end_ms, text FROM (
 SELECT meeting_id, ord, k, ord * 1000 AS off, least(30000, (k - 1) * 2500 + 40 * (ord % 7)) AS a, least(30000, (k - 1) * 2500 + 2000) AS b, text FROM (
  SELECT meeting_id, ord, trim(w) AS text, i AS k FROM (SELECT meeting_id, ord, unnest(ps) AS w, generate_subscripts(ps, 1) AS i FROM (
    SELECT meeting_id, ord, list_filter(string_split(text, ', '), lambda s: trim(s) <> '') AS ps FROM segments))))""", "segments")
def _(t):
    parts = F.filter(F.split("text", ", "), lambda s: F.trim(s) != "")
    stamp = lambda ms: F.concat(F.lit("<|"), F.format_string("%.2f", ms / F.lit(1000.0)), F.lit("|>"))
    spoken_ = F.concat(
        F.lit("<|startoftranscript|><|ru|>"),
        F.array_join(F.transform(parts, lambda s, i: F.concat(stamp(i * 2500 + 40 * (F.col("ord") % 7)), F.lit(" "), s, F.lit(" "), stamp(i * 2500 + 2000))), ""),
    )
    segs = tx.timestamped_text(spoken_, F.col("ord") * 1000, F.lit(30000))
    out = t.segments.select("meeting_id", "ord", F.posexplode(segs).alias("p", "s"))
    return out.select("meeting_id", "ord", (F.col("p") + 1).cast("bigint").alias("k"), "s.start_ms", "s.end_ms", "s.text")
