"""Checked queries for ordered operators."""

from pyspark.sql import functions as F

from checks.adapters import PRELUDE
from checks.registry import check
from parlance.functions import text as tx
from parlance.operators import turns as tn

AL = "aligned"


@check("p3_micro_filter", "SELECT meeting_id, ord FROM aligned WHERE end_ms - start_ms >= CASE WHEN meeting_type = 'court_hearing' THEN 200 ELSE 500 END", AL)
def _(t):
    return tn.drop_micro(t.aligned, tn.min_turn_ms()).select("meeting_id", "ord")


@check("w1_smooth_diarization", """
SELECT meeting_id, min(start_ms) AS start_ms, arg_max(end_ms, (start_ms, d_ord)) AS end_ms, any_value(speaker_id) AS speaker_id, bool_or(is_overlap) AS is_overlap, count(*) AS merged_rows FROM (
 SELECT *, sum(CASE WHEN ps IS NULL OR ps <> speaker_id OR start_ms - pe > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY start_ms, d_ord) AS isl FROM (
  SELECT *, lag(speaker_id) OVER w AS ps, lag(end_ms) OVER w AS pe FROM diarization WHERE end_ms - start_ms >= 150 WINDOW w AS (PARTITION BY meeting_id ORDER BY start_ms, d_ord)))
GROUP BY meeting_id, isl""", "diarization")
def _(t):
    return tn.smooth(t.diarization).drop("speaker_name", "d_ord")


@check("w2_merge_consecutive", """
WITH RECURSIVE n AS (SELECT *, sum(brk) OVER (PARTITION BY meeting_id ORDER BY ord) AS isl FROM (
  SELECT *, CASE WHEN lag(speaker_id) OVER w IS NOT DISTINCT FROM speaker_id AND lag(nm) OVER w IS NOT DISTINCT FROM nm AND ord > 1 THEN 0 ELSE 1 END AS brk
  FROM (SELECT *, CASE WHEN ord % 4 > 1 THEN speaker_name END AS nm FROM aligned) WINDOW w AS (PARTITION BY meeting_id ORDER BY ord))),
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, isl ORDER BY ord) AS k FROM n),
f AS (SELECT meeting_id, isl, k, confidence AS c FROM r WHERE k = 1 UNION ALL SELECT r.meeting_id, r.isl, r.k, (f.c + r.confidence) / 2 FROM f JOIN r ON r.meeting_id = f.meeting_id AND r.isl = f.isl AND r.k = f.k + 1)
SELECT g.*, round(f.c + 1e-7, 5) AS confidence FROM (SELECT meeting_id, isl, min(ord) AS ord, min(start_ms) AS start_ms, arg_max(end_ms, ord) AS end_ms, string_agg(text, ' ' ORDER BY ord) AS text, any_value(speaker_id) AS speaker_id, min(attribution_confidence) AS attribution_confidence, count(*) AS rows FROM n GROUP BY 1, 2) g
JOIN f ON f.meeting_id = g.meeting_id AND f.isl = g.isl AND f.k = g.rows""".replace("SELECT g.*", "SELECT g.meeting_id, g.ord, g.start_ms, g.end_ms, g.text, g.speaker_id, g.attribution_confidence, g.rows"), AL)
def _(t):
    al = t.aligned.withColumn("speaker_name", F.when(F.col("ord") % 4 > 1, F.col("speaker_name")))
    return tn.merge_consecutive(al).select("meeting_id", "ord", "start_ms", "end_ms", "text", "speaker_id", "attribution_confidence", "rows", F.round(F.col("confidence") + 1e-7, 5).alias("confidence"))


PRELUDE["turn_rows"] = ("aligned", r"""
SELECT *, sum(brk) OVER (PARTITION BY meeting_id ORDER BY ord) AS turn, start_ms - pe AS gap FROM (
 SELECT *, CASE WHEN lag(speaker_id) OVER w = speaker_id AND start_ms - lag(end_ms) OVER w < 2000 THEN 0 ELSE 1 END AS brk, lag(end_ms) OVER w AS pe, lag(trim(text)) OVER w AS pt
 FROM aligned WINDOW w AS (PARTITION BY meeting_id ORDER BY ord))""")
PRELUDE["turn_pieces"] = ("turn_rows", r"""
SELECT *, trim(text) AS x,
 CASE WHEN brk = 1 THEN trim(text) WHEN regexp_matches(pt, '[.!?…]$') OR (gap >= 600 AND NOT regexp_matches(pt, '[,;:—–-]$')) THEN CASE WHEN regexp_matches(trim(text), '^\p{Ll}') THEN upper(trim(text)[1]) || trim(text)[2:] ELSE trim(text) END
  WHEN regexp_matches(pt, '[,;:—–-]$') OR gap <= 150 THEN CASE WHEN regexp_matches(trim(text), '^\p{Lu}') THEN lower(trim(text)[1]) || trim(text)[2:] ELSE trim(text) END ELSE trim(text) END
 || CASE WHEN lead(brk) OVER (PARTITION BY meeting_id ORDER BY ord) = 0 AND lead(gap) OVER (PARTITION BY meeting_id ORDER BY ord) >= 600 AND regexp_matches(trim(text), '[\p{L}\p{N}]$') THEN '.' ELSE '' END AS piece,
 row_number() OVER (PARTITION BY meeting_id, turn ORDER BY ord) AS k, min(start_ms) OVER (PARTITION BY meeting_id, turn) AS s0 FROM turn_rows""")
PRELUDE["turns"] = ("turn_pieces", r"""
SELECT meeting_id, min(ord) AS ord, min(start_ms) AS start_ms, arg_max(end_ms, ord) AS end_ms, any_value(speaker_id) AS speaker_id, min(attribution_confidence) AS attribution_confidence, count(*) AS rows,
 regexp_replace(regexp_replace(CASE WHEN count(*) = 1 THEN any_value(text) ELSE trim(regexp_replace(regexp_replace(string_agg(piece, ' ' ORDER BY ord), '\s+', ' ', 'g'), '\s+([,.!?;:])', '\1', 'g')) END, ',(?:\s*,)+', ',', 'g'), '^[—–,-][\s,—–-]+', '') AS text, turn
FROM turn_pieces GROUP BY meeting_id, turn""")


@check("w3_turn_building", """
WITH RECURSIVE f AS (SELECT meeting_id, turn, k, confidence::DOUBLE AS c, end_ms AS e, s0 FROM turn_pieces WHERE k = 1
 UNION ALL SELECT r.meeting_id, r.turn, r.k, (f.c * greatest(1, f.e - f.s0) + r.confidence * greatest(1, r.end_ms - r.start_ms)) / (greatest(1, f.e - f.s0) + greatest(1, r.end_ms - r.start_ms)), r.end_ms, f.s0
 FROM f JOIN turn_pieces r ON r.meeting_id = f.meeting_id AND r.turn = f.turn AND r.k = f.k + 1)
SELECT t.meeting_id, t.ord, t.start_ms, t.end_ms, t.speaker_id, t.attribution_confidence, t.rows, t.text, round(f.c, 5) AS confidence FROM turns t JOIN f ON f.meeting_id = t.meeting_id AND f.turn = t.turn AND f.k = t.rows WHERE length(trim(t.text)) >= 3""", "turns turn_pieces")
def _(t):
    return tn.build_turns(t.aligned).drop("speaker_name").withColumn("confidence", F.round("confidence", 5))


@check("w3_turn_building_skewed_text", """
SELECT CASE WHEN rows = 1 THEN 'single' ELSE 'merged' END AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM turns WHERE length(trim(text)) >= 3 GROUP BY 1""", "turns")
def _(t):
    out = tn.build_turns(t.aligned).groupBy(F.when(F.col("rows") == 1, "single").otherwise("merged").alias("kind"))
    return out.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


PRELUDE["wordsegs"] = ("words", "SELECT meeting_id, start_ms AS ord, start_ms + (seg_ord % 3) * 100 AS start_ms, end_ms, word AS text, confidence, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms) AS k FROM words")


def wordsegs(t):
    return t.words.select(
        "meeting_id", F.col("start_ms").alias("ord"), (F.col("start_ms") + F.col("seg_ord") % 3 * 100).alias("start_ms"), "end_ms", F.col("word").alias("text"), "confidence"
    )


def recursive(cond: str, rows: str, keep: str = "") -> str:
    """Row-by-row SQL walk: ``cond`` says that row r joins the group (s0 = opening start, pe = last end)."""
    return f"""
WITH RECURSIVE g AS (SELECT meeting_id, k, ord AS grp, start_ms AS s0, end_ms AS pe {keep.format('')} FROM {rows} WHERE k = 1
 UNION ALL SELECT r.meeting_id, r.k, CASE WHEN {cond} THEN g.grp ELSE r.ord END, CASE WHEN {cond} THEN g.s0 ELSE r.start_ms END, r.end_ms {keep.format('r.')} FROM g JOIN {rows} r ON r.meeting_id = g.meeting_id AND r.k = g.k + 1)"""


FOLD = " SELECT meeting_id, grp AS ord, arg_min(start_ms, k) AS start_ms, arg_max(end_ms, k) AS end_ms, string_agg(text, ' ' ORDER BY k) AS text, max(confidence) AS confidence, count(*) AS rows FROM {rows} JOIN (SELECT meeting_id, k, grp FROM g) USING (meeting_id, k) GROUP BY meeting_id, grp"


@check("w4_merge_short", recursive("g.pe - g.s0 < 500 AND r.start_ms - g.pe < 300", "wordsegs") + FOLD.format(rows="wordsegs"), "wordsegs")
def _(t):
    return tn.merge_short(wordsegs(t))


@check("w5_merge_adjacent", recursive("r.start_ms - g.pe < 500", "kseg") + FOLD.format(rows="kseg"), "kseg")
def _(t):
    return tn.merge_adjacent(t.asr)


PRELUDE["kseg"] = ("segments", "SELECT *, ord AS k FROM segments")


@check("w6_words_to_segments", recursive("NOT g.ends AND r.start_ms - g.pe <= 800 AND r.end_ms - g.s0 <= 15000", "kwords", ", {0}ends")
       + " SELECT meeting_id, grp AS ord, arg_min(start_ms, k) AS start_ms, arg_max(end_ms, k) AS end_ms, string_agg(word, ' ' ORDER BY k) AS text, round(sum(confidence), 2) AS conf_sum, count(*) AS n_words FROM kwords JOIN (SELECT meeting_id, k, grp FROM g) USING (meeting_id, k) GROUP BY meeting_id, grp", "kwords")
def _(t):
    return tn.words_to_segments(t.words, order="start_ms").withColumn("conf_sum", F.round(F.col("confidence") * F.col("n_words"), 2)).drop("confidence")


PRELUDE["tiedwords"] = ("words", "SELECT *, k AS ord FROM (SELECT meeting_id, t AS start_ms, end_ms, word, confidence, regexp_matches(word, '[.!?…]$') AS ends, row_number() OVER (PARTITION BY meeting_id ORDER BY t, seg_ord, w_pos) AS k FROM (SELECT *, start_ms // 700 * 700 AS t FROM words))")


@check("w6_equal_starts", recursive("NOT g.ends AND r.start_ms - g.pe <= 800 AND r.end_ms - g.s0 <= 15000", "tiedwords", ", {0}ends")
       + " SELECT meeting_id, arg_min(start_ms, k) AS ord, arg_min(start_ms, k) AS start_ms, arg_max(end_ms, k) AS end_ms, string_agg(word, ' ' ORDER BY k) AS text, round(sum(confidence), 2) AS conf_sum, count(*) AS n_words FROM tiedwords JOIN (SELECT meeting_id, k, grp FROM g) USING (meeting_id, k) GROUP BY meeting_id, grp", "tiedwords")
def _(t):
    tied = t.words.withColumn("start_ms", F.floor(F.col("start_ms") / 700) * 700)
    out = tn.words_to_segments(tied, order="start_ms", ties=("seg_ord", "w_pos"))
    return out.withColumn("conf_sum", F.round(F.col("confidence") * F.col("n_words"), 2)).drop("confidence")


PRELUDE["kwords"] = ("words", "SELECT meeting_id, start_ms AS ord, start_ms, end_ms, word, confidence, regexp_matches(word, '[.!?…]$') AS ends, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms) AS k FROM words")


@check("w7_pack_speech", recursive("NOT (g.pe - g.s0 = 0) AND NOT (g.pe - g.s0 > 200 AND (r.end_ms - g.s0 > 22000 OR g.pe - g.s0 > 15000))", "kseg") + """
 , c AS (SELECT meeting_id, grp, arg_min(start_ms, k) AS s, arg_max(end_ms, k) AS e FROM kseg JOIN (SELECT meeting_id, k, grp FROM g) USING (meeting_id, k) GROUP BY meeting_id, grp),
 d AS (SELECT *, CASE WHEN e - s > 30000 THEN (e - s) // 30000 + 1 ELSE 1 END AS n FROM c WHERE e - s > 200), p AS (SELECT *, unnest(range(n)) AS part FROM d)
 SELECT meeting_id, grp AS ord, CAST(part AS BIGINT) AS part, round(s + (e - s) * part::DOUBLE / n, 3) AS start_ms, round(s + (e - s) * (part + 1)::DOUBLE / n, 3) AS end_ms, round(least(s + (e - s) * (part + 1)::DOUBLE / n + 1500, mx), 3) AS read_end_ms
 FROM p JOIN (SELECT meeting_id, max(end_ms) AS mx FROM segments GROUP BY 1) USING (meeting_id)""", "kseg segments")
def _(t):
    last = t.asr.groupBy("meeting_id").agg(F.max("end_ms").alias("audio_ms"))
    out = tn.pack_speech(t.asr.join(last, "meeting_id"))
    return out.withColumns({c: F.round(c, 3) for c in ("start_ms", "end_ms", "read_end_ms")})


@check("w8_chunk_overlap", r"""
WITH RECURSIVE q AS (SELECT meeting_id, ord, list_filter(string_split(text, ' '), lambda w: w <> '') AS own FROM segments),
z AS (SELECT *, CASE WHEN ord > 1 AND ord % 5 > 0 THEN list_concat(list_slice(lag(own) OVER (PARTITION BY meeting_id ORDER BY ord), -(ord % 5), -1), own) ELSE own END AS words FROM q),
n AS (SELECT *, list_transform(words, lambda w: trim(trim(lower(w), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~—–«»… '))) AS nm FROM z),
g AS (SELECT meeting_id, ord, nm AS left_nm, 0::BIGINT AS cut FROM n WHERE ord = 1
 UNION ALL SELECT meeting_id, ord, nm[c + 1:] AS left_nm, c AS cut FROM (
  SELECT n.meeting_id, n.ord, n.nm, coalesce(list_filter([8,7,6,5,4,3,2], lambda m: m <= len(g.left_nm) AND m <= len(n.nm) AND g.left_nm[-m:] = n.nm[1:m])[1], 0)::BIGINT AS c
  FROM g JOIN n ON n.meeting_id = g.meeting_id AND n.ord = g.ord + 1))
SELECT meeting_id, ord, cut FROM g""", "segments")
def _(t):
    ws = F.filter(F.split("text", " "), lambda w: w != "")
    from parlance.operators.ordered import by_position, neighbours

    own = neighbours(t.segments.select("meeting_id", "ord", ws.alias("own")), by_position(), ["own"], prev="prev")
    tail = F.when(F.col("ord") % 5 > 0, F.slice("prev.own", -F.least(F.col("ord") % 5, F.size("prev.own")), F.col("ord") % 5)).otherwise(F.array().cast("array<string>"))
    words = F.when(F.col("prev").isNotNull(), F.concat(tail, F.col("own"))).otherwise(F.col("own"))
    chunks = own.select("meeting_id", "ord", words.alias("words"), F.array_join(words, " ").alias("text"))
    return tn.dedupe_chunk_overlap(chunks).select("meeting_id", "ord", F.col("cut").cast("bigint").alias("cut"))


@check("w9_char_batches", """
WITH RECURSIVE s AS (SELECT meeting_id, ord, ord AS k, length(text) AS c FROM segments),
g AS (SELECT meeting_id, k, ord AS batch, c AS used FROM s WHERE k = 1 UNION ALL
 SELECT s.meeting_id, s.k, CASE WHEN g.used + s.c > 1000 THEN s.ord ELSE g.batch END, CASE WHEN g.used + s.c > 1000 THEN s.c ELSE g.used + s.c END FROM g JOIN s ON s.meeting_id = g.meeting_id AND s.k = g.k + 1)
SELECT meeting_id, k AS ord, batch FROM g""", "segments")
def _(t):
    return tn.batch_by_chars(t.asr, 1000).select("meeting_id", "ord", "batch")


@check("w9_word_chunks", """
SELECT doc_id, c - 1 AS chunk, array_to_string(ws[(c - 1) * 200 + 1:c * 200], ' ') AS text FROM (
 SELECT doc_id, ws, unnest(range(1, (len(ws) + 199) // 200 + 1)) AS c FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents))""")
def _(t):
    return t.table("documents").select("doc_id", F.posexplode(tn.word_chunks(F.col("text"))).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("bigint"))


@check("w10_sentence_split", r"""
SELECT CAST(sum(pieces) AS BIGINT) AS pieces, CAST(sum(chars) AS BIGINT) AS chars FROM (
 SELECT CASE WHEN end_ms - start_ms < 6000 OR len(ps) <= 1 THEN 1 ELSE len(ps) - len(list_filter(ps[2:], lambda s: length(s) * 60 < 400)) END AS pieces,
  CASE WHEN end_ms - start_ms < 6000 OR len(ps) <= 1 THEN length(text) ELSE list_sum(list_transform(ps, lambda s: length(trim(s)))) + len(list_filter(ps[2:], lambda s: length(s) * 60 < 400)) END AS chars FROM (
  SELECT text, start_ms, end_ms, list_filter(string_split(regexp_replace(text, '([.!?]+["'')\]»]?\s+)', '\1' || chr(57344), 'g'), chr(57344)), lambda s: trim(s) <> '') AS ps FROM segments))""", "segments")
def _(t):
    return tn.split_by_sentences(t.asr).agg(F.count("*").alias("pieces"), F.sum(F.length("text")).alias("chars"))


@check("w12_diarization_split")
def _(t):
    return tn.split_by_diarization(t.asr, t.diarization)


@check("w12_diarization_split_words", """
WITH wr AS (SELECT w.*, r.start_ms AS rs, r.end_ms AS re FROM words w JOIN runs r ON w.meeting_id = r.meeting_id AND w.seg_ord = r.seg_ord AND w.start_ms + w.end_ms >= 2 * r.start_ms AND w.start_ms + w.end_ms < 2 * r.end_ms),
ch AS (SELECT meeting_id, seg_ord FROM runs GROUP BY 1, 2 HAVING count(DISTINCT speaker_id) > 1),
pc AS (SELECT meeting_id, seg_ord, rs, re, string_agg(word, ' ' ORDER BY w_pos) AS text FROM wr JOIN ch USING (meeting_id, seg_ord) GROUP BY 1, 2, 3, 4),
ok AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY meeting_id, seg_ord ORDER BY rs) AS i FROM pc WINDOW w AS (PARTITION BY meeting_id, seg_ord))
SELECT s.meeting_id, s.ord, coalesce(i - 1, 0) AS piece, CASE WHEN i IS NULL OR i = 1 THEN s.start_ms ELSE greatest(s.start_ms, rs) END AS start_ms,
 CASE WHEN i IS NULL OR i = n THEN s.end_ms ELSE least(s.end_ms, re) END AS end_ms, coalesce(p.text, s.text) AS text
FROM segments s LEFT JOIN (SELECT * FROM ok WHERE n > 1) p ON p.meeting_id = s.meeting_id AND p.seg_ord = s.ord AND s.end_ms - s.start_ms >= 1200""", "segments words runs")
def _(t):
    out = tn.split_words_by_diarization(t.asr, t.words, t.diarization)
    return out.select("meeting_id", "ord", F.col("piece").cast("bigint").alias("piece"), "start_ms", "end_ms", "text")


@check("w13_longest_segment", """
SELECT meeting_id, speaker_id, ord, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker_id ORDER BY end_ms - start_ms DESC, ord) AS rk FROM aligned WHERE end_ms - start_ms >= 8000) WHERE rk = 1""", AL)
def _(t):
    return tn.longest_turn(t.aligned)


@check("w14_first_samples", """
SELECT meeting_id, speaker_id, CAST(rn AS INT) AS rn, CASE WHEN length(x) > 120 THEN left(x, 119) || '…' ELSE x END AS sample FROM (
 SELECT meeting_id, speaker_id, trim(text) AS x, row_number() OVER (PARTITION BY meeting_id, speaker_id ORDER BY ord) AS rn FROM aligned WHERE length(trim(text)) >= 30) WHERE rn <= 3""", AL)
def _(t):
    return tn.first_samples(t.aligned, 3, 30, tn.shortened(120, 119, "…"))


@check("w15_first_seen_labels", """
SELECT meeting_id, coalesce(nullif(speaker_name, ''), speaker_id) AS label, min(ord) AS first_ord FROM aligned GROUP BY 1, 2""", AL)
def _(t):
    return tn.labels_first_seen(t.aligned)


@check("w17_carry_speakers", """
SELECT recording_id, ord, coalesce(last_value(nullif(sp, '') IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY ord), 'UNKNOWN') AS speaker, text FROM (
 SELECT meeting_id AS recording_id, ord, CASE WHEN ord % 4 = 2 THEN speaker_id ELSE '' END AS sp, text FROM segments)""", "segments")
def _(t):
    rows = t.segments.select(F.col("meeting_id").alias("recording_id"), "ord", F.when(F.col("ord") % 4 == 2, F.col("speaker_id")).otherwise(" ").alias("speaker"), "text")
    return tn.carry_speakers(rows)


PRELUDE["gaps_turns"] = ("segments", """
SELECT meeting_id AS recording_id, ord AS turn, CASE WHEN ord % 3 = 1 THEN start_ms::DOUBLE END AS start_ms, CASE WHEN ord % 3 = 1 THEN end_ms + 900.0::DOUBLE END AS end_ms FROM segments""")
PRELUDE["interp"] = ("gaps_turns", """
SELECT recording_id, turn, CASE WHEN start_ms IS NOT NULL THEN 'aligned' ELSE 'interpolated' END AS status,
 coalesce(start_ms, CASE WHEN p IS NULL AND n IS NULL THEN 0 WHEN p IS NULL THEN greatest(0, n - 500) WHEN n IS NULL THEN p ELSE greatest(p, (p + n) / 2 - 250) END) AS start_ms,
 coalesce(end_ms, CASE WHEN p IS NULL AND n IS NULL THEN 90000 WHEN p IS NULL THEN n WHEN n IS NULL THEN least(90000, p + 500) ELSE least(n, (p + n) / 2 + 250) END) AS end_ms FROM (
 SELECT *, last_value(end_ms IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY turn) AS p, first_value(start_ms IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM gaps_turns)""")


def gaps_turns(t):
    known = F.col("ord") % 3 == 1
    return t.segments.select(
        F.col("meeting_id").alias("recording_id"),
        F.col("ord").alias("turn"),
        F.when(known, F.col("start_ms").cast("double")).alias("start_ms"),
        F.when(known, F.col("end_ms") + F.lit(900.0)).alias("end_ms"),
    )


@check("w18_interpolate", "SELECT * FROM interp", "interp")
def _(t):
    return tn.interpolate_times(gaps_turns(t), F.lit(90000.0))


@check("w19_clip_turns", """
SELECT recording_id, turn, status, greatest(0, least(90000, start_ms)) AS start_ms, greatest(0, least(90000, greatest(start_ms + 50, least(end_ms, coalesce(nx, end_ms))))) AS end_ms
FROM (SELECT *, lead(start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, turn) AS nx FROM interp)""", "interp")
def _(t):
    return tn.clip_turns(tn.interpolate_times(gaps_turns(t), F.lit(90000.0)), F.lit(90000.0))


@check("w20_indexed_lines", """
SELECT meeting_id, idx, '[' || idx || '] ' || coalesce(nullif(speaker_name, ''), speaker_id) || ': ' || trim(text) AS line FROM (
 SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) - 1 AS idx FROM aligned WHERE trim(text) <> '')""", AL)
def _(t):
    return tn.indexed_lines(t.aligned).select("meeting_id", F.col("idx").cast("bigint").alias("idx"), "line")


PRELUDE["wins"] = ("segments", """
SELECT meeting_id, win, greatest(f, f + win * width - CASE WHEN win > 0 THEN least(60000, width * 0.1) ELSE 0 END)::BIGINT AS start_ms, least(l, f + win * width) + 0 AS x, least(l, f + (win + 1) * width) AS end_ms FROM (
 SELECT *, unnest(range(least(12, CAST(ceil((l - f)::DOUBLE / width) AS BIGINT)))) AS win FROM (
  SELECT *, greatest(300000, CAST(ceil((l - f) / 12000.0) AS BIGINT) * 1000) AS width FROM (SELECT meeting_id, min(start_ms) AS f, max(end_ms) * 9 AS l FROM segments GROUP BY 1) WHERE l > f))""")


@check("w21_recall_windows", "SELECT meeting_id, win, start_ms, end_ms FROM wins w WHERE EXISTS (SELECT 1 FROM segments s WHERE s.meeting_id = w.meeting_id AND s.end_ms * 9 > w.start_ms AND s.start_ms < w.end_ms)", "wins segments")
def _(t):
    return tn.recall_windows(t.asr.withColumn("end_ms", F.col("end_ms") * 9), 5, 12)


@check("j9_window_members", """
SELECT w.meeting_id, w.win, CAST(count(*) AS BIGINT) AS n, min(s.ord) AS first_ord, max(s.ord) AS last_ord FROM wins w JOIN segments s ON s.meeting_id = w.meeting_id AND s.end_ms * 9 > w.start_ms AND s.start_ms < w.end_ms GROUP BY 1, 2""", "wins segments")
def _(t):
    from parlance.operators.intervals import window_members

    wide = t.asr.withColumn("end_ms", F.col("end_ms") * 9)
    got = window_members(tn.recall_windows(wide, 5, 12), wide)
    return got.groupBy("meeting_id", "win").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@check("w24_speaker_headers", """
SELECT meeting_id, ord, coalesce(lag(speaker_id) OVER (PARTITION BY meeting_id ORDER BY ord) <> speaker_id, true) AS new_speaker FROM aligned""", AL)
def _(t):
    return tn.header_flags(t.aligned).select("meeting_id", "ord", "new_speaker")


@check("w25_order_flags", """
SELECT meeting_id, d_ord AS ord, coalesce(start_ms < lag(end_ms) OVER (PARTITION BY meeting_id ORDER BY d_ord), false) AS out_of_order, end_ms < start_ms AS inverted FROM diarization""", "diarization")
def _(t):
    return tn.order_flags(t.diarization.withColumnRenamed("d_ord", "ord")).select("meeting_id", "ord", "out_of_order", "inverted")


@check("p8_phrase_context", """
WITH h AS (SELECT meeting_id, ord FROM segments WHERE contains(text, 'ering') OR contains(text, 'ung '))
SELECT DISTINCT s.meeting_id, s.ord FROM segments s JOIN h ON s.meeting_id = h.meeting_id AND s.ord BETWEEN h.ord - 2 AND h.ord + 3""", "segments")
def _(t):
    return tn.phrase_context(t.asr, ["ering", "ung "]).select("meeting_id", "ord")


@check("w23_editor_merge", """
SELECT meeting_id, min(ord) AS ord, arg_min(start_ms, ord) AS start_ms, max(end_ms) AS end_ms, string_agg(trim(text), ' ' ORDER BY ord) AS text, arg_min(speaker_id, ord) AS speaker_id, min(confidence) AS confidence,
 CASE WHEN count(attribution_confidence) = count(*) THEN min(attribution_confidence) END AS attribution_confidence FROM (
 SELECT *, sum(CASE WHEN ord % 5 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY ord) AS g FROM aligned) GROUP BY meeting_id, g""", AL)
def _(t):
    return tn.editor_merge(t.aligned, t.aligned.where("ord % 5 = 0"))


@check("w23_editor_split", r"""
SELECT meeting_id, ord, CAST(CASE WHEN ord % 4 = 1 AND length(text) >= 8 AND l <> '' AND r <> '' THEN 2 ELSE 1 END AS BIGINT) AS pieces FROM (
 SELECT meeting_id, ord, trim(text) AS text, trim(left(text, length(text) // 2)) AS l, trim(right(text, length(text) - length(text) // 2)) AS r FROM segments)""", "segments")
def _(t):
    out = tn.editor_split(t.asr, t.asr.where("ord % 4 = 1"))
    return out.groupBy("meeting_id", "ord").agg(F.count("*").alias("pieces"))
