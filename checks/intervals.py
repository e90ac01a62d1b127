"""Checked queries for interval operators."""

from pyspark.sql import functions as F

from checks.adapters import PRELUDE
from checks.registry import check
from parlance.operators import intervals as iv
from parlance.operators import stats
from parlance.operators.ordered import dense_index, by_position

PRELUDE["pairs"] = ("segments diarization", """
SELECT s.meeting_id, s.ord, d.d_ord, d.speaker_id AS d_speaker, d.speaker_name AS d_name, d.is_overlap AS d_is_overlap,
  least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms) AS overlap_ms
FROM segments s JOIN diarization d ON s.meeting_id = d.meeting_id AND s.start_ms < d.end_ms AND d.start_ms < s.end_ms
  AND least(s.end_ms, d.end_ms) > greatest(s.start_ms, d.start_ms)""")
PRELUDE["won"] = ("pairs", """
SELECT meeting_id, ord, d_speaker AS speaker_id, name AS speaker_name, ov AS win_ms, total AS total_ms, tov AS talk_over_ms,
  CASE WHEN tov::DOUBLE / total >= 0.10 THEN least(round_even(ov::DOUBLE / total, 3), 0.55) ELSE round_even(ov::DOUBLE / total, 3) END AS attribution_confidence
FROM (SELECT *, CAST(sum(ov) OVER m AS BIGINT) AS total, CAST(sum(talk) OVER m AS BIGINT) AS tov,
        row_number() OVER (PARTITION BY meeting_id, ord ORDER BY ov DESC, first_seen) AS rk
      FROM (SELECT meeting_id, ord, d_speaker, CAST(sum(overlap_ms) AS BIGINT) AS ov, min(d_ord) AS first_seen,
              arg_min(d_name, d_ord) FILTER (d_name IS NOT NULL AND d_name <> '') AS name,
              CAST(sum(CASE WHEN d_is_overlap THEN overlap_ms ELSE 0 END) AS BIGINT) AS talk
            FROM pairs GROUP BY ALL)
      WINDOW m AS (PARTITION BY meeting_id, ord)) WHERE rk = 1""")
PRELUDE["nearest"] = ("segments diarization won", """
SELECT meeting_id, ord, speaker_id, speaker_name, d_ord FROM (
  SELECT s.meeting_id, s.ord, d.speaker_id, d.speaker_name, d.d_ord,
    row_number() OVER (PARTITION BY s.meeting_id, s.ord ORDER BY abs(s.start_ms + s.end_ms - d.start_ms - d.end_ms), d.d_ord) AS rk
  FROM (SELECT * FROM segments ANTI JOIN won USING (meeting_id, ord)) s JOIN diarization d ON s.meeting_id = d.meeting_id) WHERE rk = 1""")
PRELUDE["attributed"] = ("segments won nearest", """
SELECT s.meeting_id, s.ord, s.start_ms, s.end_ms, s.text, s.confidence,
  coalesce(w.speaker_id, n.speaker_id, 'speaker_0') AS speaker_id,
  CASE WHEN w.speaker_id IS NOT NULL THEN w.speaker_name ELSE n.speaker_name END AS speaker_name, w.attribution_confidence
FROM segments s LEFT JOIN won w USING (meeting_id, ord) LEFT JOIN nearest n USING (meeting_id, ord)""")


@check("j1_overlap_join", "SELECT meeting_id, ord, d_ord, d_speaker, overlap_ms FROM pairs", "pairs")
def _(t):
    return iv.overlap_join(t.asr, t.diarization).select("meeting_id", "ord", "d_ord", "d_speaker", "overlap_ms")


@check("j2_dominant_speaker", """
SELECT meeting_id, ord, speaker_id, speaker_name, win_ms, total_ms, round_even(win_ms::DOUBLE / total_ms, 3) AS confidence FROM won""", "won")
def _(t):
    won = iv.attribute(iv.overlap_join(t.asr, t.diarization))
    return won.select(
        "meeting_id", "ord", "speaker_id", "speaker_name", "win_ms", "total_ms", F.bround(F.col("win_ms") / F.col("total_ms"), 3).alias("confidence")
    )


@check("j3_nearest_midpoint", "SELECT * FROM nearest", "nearest")
def _(t):
    won = iv.attribute(iv.overlap_join(t.asr, t.diarization))
    lonely = t.asr.join(won.select("meeting_id", "ord"), ["meeting_id", "ord"], "left_anti")
    return iv.nearest_speaker(lonely, t.diarization)


@check("j3_nearest_midpoint_all", """
SELECT meeting_id, ord, speaker_id, speaker_name, d_ord FROM (
  SELECT s.meeting_id, s.ord, d.speaker_id, d.speaker_name, d.d_ord,
    row_number() OVER (PARTITION BY s.meeting_id, s.ord ORDER BY abs(s.start_ms + s.end_ms - d.start_ms - d.end_ms), d.d_ord) AS rk
  FROM segments s JOIN diarization d ON s.meeting_id = d.meeting_id) WHERE rk = 1""", "segments diarization")
def _(t):
    return iv.nearest_speaker(t.asr, t.diarization)


@check("j4_talk_over_cap", "SELECT meeting_id, ord, talk_over_ms, attribution_confidence FROM won", "won")
def _(t):
    return iv.attribute(iv.overlap_join(t.asr, t.diarization)).select("meeting_id", "ord", "talk_over_ms", "attribution_confidence")


@check("j5_default_speaker", """
SELECT meeting_id, ord, start_ms, end_ms, text, confidence, 'speaker_0' AS speaker_id, CAST(NULL AS DOUBLE) AS attribution_confidence FROM segments s
WHERE NOT EXISTS (SELECT 1 FROM diarization d WHERE d.meeting_id = s.meeting_id AND d.speaker_id = 'system')""", "segments diarization")
def _(t):
    return iv.default_when_undiarised(t.asr, t.diarization.where("speaker_id = 'system'"))


@check("j_align", "SELECT * FROM attributed", "attributed")
def _(t):
    return iv.align(t.asr, t.diarization)


@check("j6_mark_overlaps", """
SELECT d.*, EXISTS (SELECT 1 FROM diarization o WHERE o.meeting_id = d.meeting_id AND o.speaker_id <> d.speaker_id
   AND least(o.end_ms, d.end_ms) - greatest(o.start_ms, d.start_ms) >= 50) AS flagged
FROM (SELECT meeting_id, d_ord, speaker_id, start_ms, end_ms FROM diarization) d""", "diarization")
def _(t):
    return iv.mark_overlaps(t.diarization).select("meeting_id", "d_ord", "speaker_id", "start_ms", "end_ms", F.col("is_overlap").alias("flagged"))


PRELUDE["runs"] = ("segments diarization", """
SELECT meeting_id, seg_ord, min(a) AS start_ms, max(b) AS end_ms, any_value(sp) AS speaker_id FROM (
  SELECT *, sum(CASE WHEN psp IS NULL OR psp <> sp OR a - pb > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, seg_ord ORDER BY a) AS run FROM (
    SELECT *, lag(sp) OVER w AS psp, lag(b) OVER w AS pb FROM (
      SELECT * FROM (
        SELECT meeting_id, seg_ord, a, b, sp, row_number() OVER (PARTITION BY meeting_id, seg_ord, a ORDER BY n DESC, fs) AS rk FROM (
          SELECT x.meeting_id, x.seg_ord, x.a, x.b, c.speaker_id AS sp, count(*) AS n, min(c.d_ord) AS fs
          FROM (SELECT * FROM (SELECT meeting_id, seg_ord, pt AS a, lead(pt) OVER (PARTITION BY meeting_id, seg_ord ORDER BY pt) AS b
                FROM (SELECT DISTINCT meeting_id, seg_ord, unnest([s, e, cs, ce]) AS pt FROM clipped)) WHERE b - a >= 10) x
          JOIN clipped c ON c.meeting_id = x.meeting_id AND c.seg_ord = x.seg_ord AND c.cs <= x.a AND c.ce >= x.b
          GROUP BY ALL)) WHERE rk = 1)
    WINDOW w AS (PARTITION BY meeting_id, seg_ord ORDER BY a)))
GROUP BY meeting_id, seg_ord, run HAVING max(b) - min(a) >= 250""")
PRELUDE["clipped"] = ("segments diarization", """
SELECT s.meeting_id, s.ord AS seg_ord, s.start_ms AS s, s.end_ms AS e, d.d_ord, d.speaker_id,
  greatest(s.start_ms, d.start_ms) AS cs, least(s.end_ms, d.end_ms) AS ce
FROM segments s JOIN diarization d ON s.meeting_id = d.meeting_id AND least(s.end_ms, d.end_ms) > greatest(s.start_ms, d.start_ms)""")
PRELUDE["runs"] = ("clipped", PRELUDE["runs"][1])


@check("w11_speaker_runs", "SELECT * FROM runs", "runs")
def _(t):
    return iv.speaker_runs(t.asr, t.diarization).drop("run_no")


@check("j7_words_into_runs", """
SELECT w.meeting_id, w.seg_ord, w.w_pos, w.word, r.start_ms AS run_start, r.speaker_id AS run_speaker
FROM words w JOIN runs r ON w.meeting_id = r.meeting_id AND w.seg_ord = r.seg_ord
 AND w.start_ms + w.end_ms >= 2 * r.start_ms AND w.start_ms + w.end_ms < 2 * r.end_ms""", "words runs")
def _(t):
    return iv.words_into_runs(t.words, iv.speaker_runs(t.asr, t.diarization)).select("meeting_id", "seg_ord", "w_pos", "word", "run_start", "run_speaker")


@check("j8_cross_source", """
SELECT a.meeting_id, a.ord,
  coalesce((SELECT string_agg(CAST(d.d_ord AS VARCHAR), ',' ORDER BY d.d_ord) FROM diarization d
    WHERE d.meeting_id = a.meeting_id AND d.start_ms < a.end_ms AND a.start_ms < d.end_ms), '') AS dia_hits,
  coalesce((SELECT string_agg(CAST(o.ord AS VARCHAR), ',' ORDER BY o.ord) FROM segments o
    WHERE o.meeting_id = a.meeting_id AND o.start_ms + 900 < a.end_ms AND a.start_ms < o.end_ms + 900), '') AS late_hits
FROM segments a""", "segments diarization")
def _(t):
    dia = t.diarization.select("meeting_id", F.col("d_ord").alias("ord"), "start_ms", "end_ms", F.col("speaker_id").alias("text"))
    late = t.asr.select("meeting_id", "ord", (F.col("start_ms") + 900).alias("start_ms"), (F.col("end_ms") + 900).alias("end_ms"), "text")
    out = iv.cross_source(t.asr, ("dia", dia), ("late", late))
    hits = lambda c: F.array_join(F.transform(c, lambda x: x["o_ord"].cast("string")), ",")
    return out.select("meeting_id", "ord", hits("dia").alias("dia_hits"), hits("late").alias("late_hits"))


@check("p7_ordered_bounds", "SELECT meeting_id, ord, least(a, b) AS start_ms, greatest(a, b) AS end_ms FROM (SELECT meeting_id, ord, CASE WHEN ord % 3 = 0 THEN end_ms ELSE start_ms END AS a, CASE WHEN ord % 3 = 0 THEN start_ms ELSE end_ms END AS b FROM segments)", "segments")
def _(t):
    flip = F.col("ord") % 3 == 0
    df = t.asr.select("meeting_id", "ord", F.when(flip, F.col("end_ms")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(flip, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"))
    return iv.ordered_bounds(df)


@check("p10_offset_shift", """
SELECT s.meeting_id, s.ord, greatest(0, s.start_ms - o.off) AS start_ms, greatest(0, s.end_ms - o.off) AS end_ms FROM segments s JOIN (
  SELECT meeting_id, CASE WHEN arg_min(start_ms, ord) + meeting_id * 7000 - arg_min(start_ms, ord) BETWEEN 30000 AND 3600000 THEN arg_min(start_ms, ord) + meeting_id * 7000 - arg_min(start_ms, ord) ELSE 0 END AS off
  FROM segments GROUP BY meeting_id) o USING (meeting_id)""", "segments")
def _(t):
    late = t.asr.withColumn("start_ms", F.col("start_ms") + F.col("meeting_id") * 7000)
    return iv.shift_back(t.asr, iv.first_turn_offset(late, t.asr)).select("meeting_id", "ord", "start_ms", "end_ms")


@check("w16_gap_series", """
SELECT meeting_id, d_ord, lead(start_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, d_ord) - end_ms AS gap_ms FROM diarization""", "diarization")
def _(t):
    return iv.gap_series(t.diarization).select("meeting_id", "d_ord", "gap_ms")


PRELUDE["topics"] = ("segments", """
SELECT meeting_id, k AS topic_no, CASE WHEN k % 4 = 3 THEN ' ' ELSE 'Topic ' || k END AS name,
  CASE WHEN k % 5 = 4 THEN k * 6 ELSE k * 4 - 2 END AS start_idx, k * 4 + 3 AS end_idx
FROM (SELECT DISTINCT meeting_id, ord // 5 AS k FROM segments)""")


@check("j10_topic_slices", """
SELECT t.meeting_id, t.topic_no, t.name, s.ord - 1 AS idx FROM (
  SELECT meeting_id, topic_no, name, least(start_idx, mx) AS a, least(end_idx, mx) AS b
  FROM topics JOIN (SELECT meeting_id, max(ord) - 1 AS mx FROM segments GROUP BY 1) USING (meeting_id) WHERE trim(name) <> '' AND start_idx >= 0 AND end_idx >= start_idx) t
JOIN segments s ON s.meeting_id = t.meeting_id AND s.ord - 1 BETWEEN t.a AND t.b""", "topics segments")
def _(t):
    k = F.floor(F.col("ord") / 5)
    topics = t.segments.select("meeting_id", k.alias("topic_no")).distinct()
    k = F.col("topic_no")
    topics = topics.select(
        "meeting_id",
        "topic_no",
        F.when(k % 4 == 3, " ").otherwise(F.concat(F.lit("Topic "), k.cast("string"))).alias("name"),
        F.when(k % 5 == 4, k * 6).otherwise(k * 4 - 2).alias("start_idx"),
        (k * 4 + 3).alias("end_idx"),
    )
    turns = dense_index(t.segments.select("meeting_id", "ord"), by_position())
    return iv.topic_slices(turns, topics).select("meeting_id", "topic_no", "name", F.col("idx").cast("long").alias("idx"))


@check("a1_participants", """
SELECT meeting_id, speaker_id, arg_min_null(speaker_name, ord) AS speaker_name, CAST(sum(end_ms - start_ms) AS BIGINT) AS speaking_ms,
  round_even(sum(end_ms - start_ms) * 100::DOUBLE / sum(sum(end_ms - start_ms)) OVER (PARTITION BY meeting_id), 1) AS speaking_share,
  CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY sum(end_ms - start_ms) DESC, min(ord)) AS INTEGER) AS place
FROM attributed GROUP BY meeting_id, speaker_id""", "attributed")
def _(t):
    return stats.participants(iv.align(t.asr, t.diarization))
