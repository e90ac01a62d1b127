"""Sinks: line tables (protocol text, markdown, RTTM, CSV, JSON) and their partitioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators.ordered import by_position, neighbours

RULE = "=" * 80
CSV_COLUMNS = ["timestamp", "action", "username", "ip_address", "resource_type", "resource_id", "outcome", "details"]


def rttm_lines(turns: DataFrame) -> DataFrame:
    """One RTTM line per turn, three decimals, at least 50 ms, blanks in labels as underscores."""
    label = F.array_join(F.filter(F.split("speaker", r"(?U)\s+"), lambda w: w != ""), "_")
    dur = F.greatest(F.lit(50), F.col("end_ms") - F.col("start_ms"))
    sec = lambda c: F.format_string("%.3f", c.cast("double") / 1000)
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col("recording_id").cast("string"), F.lit("1"), sec(F.col("start_ms")), sec(dur), F.lit("<NA> <NA>"), label, F.lit("<NA> <NA>"))
    return turns.select("recording_id", "start_ms", line.alias("value"))


def write_rttm(turns: DataFrame, path: str) -> None:
    rttm_lines(turns).repartitionByRange("recording_id", "start_ms").sortWithinPartitions("recording_id", "start_ms").select(
        "recording_id", "value"
    ).write.partitionBy("recording_id").text(path)


def audit_rows(events: DataFrame) -> DataFrame:
    """Events with their UTC day; null fields disappear when written as JSON."""
    return events.withColumn("log_date", F.substring("timestamp", 1, 10))


def write_audit(events: DataFrame, path: str) -> None:
    audit_rows(events).write.partitionBy("log_date").mode("append").json(path)


def csv_cells(events: DataFrame) -> DataFrame:
    """The eight export columns as text; outcome is derived from success, details are JSON."""
    kind = dict(events.dtypes).get("details", "string")
    details = F.col("details") if kind == "string" else F.to_json("details")
    outcome = F.when(F.col("success"), "success").when(~F.col("success"), "failure")
    return events.withColumns({"outcome": outcome, "details": details}).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS])


def csv_lines(events: DataFrame) -> DataFrame:
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in CSV_COLUMNS]
    return csv_cells(events).select(F.concat_ws(",", *quoted).alias("value"))


def write_csv(events: DataFrame, path: str) -> None:
    csv_cells(events).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def _who(name: str = "speaker_name") -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.col(name)).otherwise(F.col("speaker_id"))


def transcript_lines(aligned: DataFrame) -> DataFrame:
    line = F.concat(_who(), F.lit(" ["), tx.hms_floor(F.col("start_ms")), F.lit("]: "), F.col("text"))
    return aligned.select("meeting_id", F.lit(90).alias("section"), F.col("ord").cast("bigint").alias("ord"), line.alias("value"))


def protocol_lines(protocols: DataFrame, participants: DataFrame, aligned: DataFrame) -> DataFrame:
    """All lines of the plain-text protocol, keyed (meeting, section, ord).

    ``protocols`` holds one row per meeting with ``date``, ``topic``, ``summary`` and the lists ``key_topics``,
    ``decisions``, ``tasks``, ``open_questions``; the transcript stays one line per row throughout.
    """

    def block(df: DataFrame, section: int, *values: Column) -> DataFrame:
        return df.select("meeting_id", F.lit(section).alias("section"), F.posexplode(F.array(*values)).alias("ord", "value")).withColumn("ord", F.col("ord").cast("bigint"))

    def listing(name: str, title: str, section: int, value) -> DataFrame:
        some = protocols.where(F.size(name) > 0)
        head = block(some, section, F.lit(title))
        rows = some.select("meeting_id", F.lit(section + 1).alias("section"), F.posexplode(name).alias("ord", "x")).select("meeting_id", "section", F.col("ord").cast("bigint").alias("ord"), value(F.col("x")).alias("value"))
        return head.unionByName(rows).unionByName(block(some, section + 2, F.lit("")))

    dash = lambda x: F.concat(F.lit("  - "), x)
    part = lambda pre, c, post: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(pre), c, F.lit(post))).otherwise("")
    out = block(protocols, 0, F.lit(RULE), F.lit("MEETING PROTOCOL"), F.lit(RULE), F.lit(""), F.concat(F.lit("Date: "), "date"))
    out = out.unionByName(block(protocols.where("topic <> ''"), 1, F.concat(F.lit("Topic: "), "topic"))).unionByName(block(protocols, 2, F.lit("")))
    who = participants.select("meeting_id")
    some = who.distinct()
    row = F.concat(F.lit("  - "), _who(), F.format_string(": %.1fs (%.1f%%)", F.col("speaking_ms") / 1000, F.col("speaking_share")))
    people = participants.select("meeting_id", F.lit(4).alias("section"), (-F.col("speaking_ms")).cast("bigint").alias("ord"), row.alias("value"))
    out = out.unionByName(block(some, 3, F.lit("PARTICIPANTS:"))).unionByName(people).unionByName(block(some, 5, F.lit("")))
    out = out.unionByName(block(protocols.where("summary <> ''"), 6, F.lit("SUMMARY:"), F.col("summary"), F.lit("")))
    out = out.unionByName(listing("key_topics", "KEY TOPICS:", 10, dash))
    out = out.unionByName(listing("decisions", "DECISIONS:", 20, lambda x: F.concat(F.lit("  - "), x["text"], part(" (", x["responsible"], ")"))))
    out = out.unionByName(listing("tasks", "ACTION ITEMS:", 30, lambda x: F.concat(F.lit("  - "), x["text"], part(" [", x["assignee"], "]"), part(" - Due: ", x["deadline"], ""))))
    out = out.unionByName(listing("open_questions", "OPEN QUESTIONS:", 40, dash))
    spoken = aligned.select("meeting_id").distinct()
    out = out.unionByName(block(spoken, 80, F.lit(RULE), F.lit("TRANSCRIPT"), F.lit(RULE)))
    return out.unionByName(transcript_lines(aligned))


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Line tables to one folder per meeting.  A long meeting is split by range, files keep the order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("meeting_id", "value").write.partitionBy("meeting_id").text(path)


def markdown_lines(aligned: DataFrame) -> DataFrame:
    """Heading on speaker change, otherwise the time range in italics, then the text.

    Header lines carry ``ord`` 0; each kept segment yields a fixed number of lines below its own ``ord``.
    """
    rows = aligned.withColumns({"text": tx.clean_markup("text"), "who": F.coalesce(F.when(F.col("speaker_id") != "", F.col("speaker_id")), F.lit("?"))})
    kept = neighbours(rows.where("text <> ''"), by_position(), ["who"], prev="prev")
    span = F.concat(tx.h_mm_ss(F.col("start_ms")), F.lit(" – "), tx.h_mm_ss(F.col("end_ms")))
    new = F.col("prev").isNull() | (F.col("prev.who") != F.col("who"))
    head = F.array(F.lit(""), F.concat(F.lit("### "), F.col("who"), F.lit("  `["), span, F.lit("]`")))
    same = F.array(F.concat(F.lit("_(["), span, F.lit("])_")))
    body = F.concat(F.when(new, head).otherwise(same), F.array(F.lit(""), F.col("text"), F.lit("")))
    lines = kept.select("meeting_id", F.col("ord").cast("bigint").alias("ord"), F.posexplode(body).alias("line", "value"))
    per = rows.groupBy("meeting_id").agg(F.max_by("end_ms", "ord").alias("e"), F.count("*").alias("n"), F.count_distinct("who").alias("k"))
    top = F.array(
        F.concat(F.lit("# Transcript — "), F.col("meeting_id").cast("string")),
        F.lit(""),
        F.concat(F.lit("**Duration**: "), tx.h_mm_ss(F.col("e")), F.format_string(" (%.1f min)", F.col("e") / 60000)),
        F.concat(F.lit("**Segments**: "), F.col("n").cast("string"), F.lit("  •  **Speakers**: "), F.col("k").cast("string")),
        F.lit(""),
        F.lit("---"),
        F.lit(""),
    )
    return per.select("meeting_id", F.lit(0).cast("bigint").alias("ord"), F.posexplode(top).alias("line", "value")).unionByName(lines)


def tagged_payload(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``{"meeting_type": …, "payload": …}`` as one JSON text per meeting."""
    keep = [c for c in payloads.columns if c not in (payload, "meeting_type")]
    return payloads.select(*keep, F.to_json(F.struct("meeting_type", F.col(payload).alias("payload"))).alias("value"))


def write_archive(rows: DataFrame, path: str) -> None:
    """Results grouped by month and meeting folder."""
    rows.write.partitionBy("month", "folder").mode("append").json(path)
