"""Checked queries for end-to-end plans."""

from pyspark.sql import functions as F

from checks.registry import check
from parlance.plans import meetings as pm


@check("plan_attributed_run_statistics", """
SELECT run_id, count(*) AS n_segments, count(DISTINCT speaker_id) AS n_speakers, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, count(attribution_confidence) AS n_conf FROM (
 SELECT 'new' AS run_id, speaker_id, start_ms, end_ms, attribution_confidence FROM attributed UNION ALL SELECT 'old', speaker_id, start_ms, end_ms, attribution_confidence FROM aligned) GROUP BY 1""", "attributed aligned")
def _(t):
    from parlance.operators.intervals import align

    out = pm.replay_comparison(t.aligned, align(t.asr, t.diarization))["statistics"]
    return out.select("run_id", "n_segments", "n_speakers", "total_ms", "n_conf")


@check("plan_process_meetings")
def _(t):
    turns = pm.process_meetings(t.asr, t.diarization, language="en", rules=[(r"(?U)\bdie\b", "DIE")])
    return turns.select("meeting_id", "ord", "start_ms", "end_ms", "speaker_id", "text", F.round("confidence", 5).alias("confidence"), "rows")
