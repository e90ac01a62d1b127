"""Extracted items and corrections: unions, fuzzy deduplication, sectioned replies, batch validation."""

from __future__ import annotations

import bisect
import math
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import json as js
from parlance.functions import text as tx
from parlance.operators.components import components
from parlance.operators.ordered import by_position, dense_index
from parlance.session import cut

MIN_OVERLAP = 0.70
SAME_TEXT, NEAR_TEXT, NEAR_EVIDENCE, NEAR_SECONDS = 0.86, 0.72, 0.78, 180

# Section headings of a structured reply.
SECTIONS = {
    "summary": ["KRATKOYE SODERZHANIYE", "KRATKOE SODERZHANIE", "КРАТКОЕ СОДЕРЖАНИЕ", "BRIEF SUMMARY", "SUMMARY"],
    "topics": ["KLYUCHEVYE TEMY OBSUZHDENIYA", "KLYUCHEVYE TEMY", "КЛЮЧЕВЫЕ ТЕМЫ ОБСУЖДЕНИЯ", "КЛЮЧЕВЫЕ ТЕМЫ", "KEY DISCUSSION POINTS", "TOPICS", "ТЕМЫ"],
    "decisions": ["RESHENIYA", "РЕШЕНИЯ", "DECISIONS"],
    "tasks": ["PORUCHENIYA", "ПОРУЧЕНИЯ", "ЗАДАЧИ", "ACTION ITEMS", "TASKS"],
    "questions": ["OTKRYTYE VOPROSY", "ОТКРЫТЫЕ ВОПРОСЫ", "OPEN QUESTIONS", "QUESTIONS", "ВОПРОСЫ"],
}
SECTION_NOISE = ["**В разделе ", "*Примечани", "Примечание:", 'Упоминание "', "Note:", "*Note", "**Note", "(not in transcript", "(нет в транскрипт"]
EMPTY_WORDS = ["net", "none", "net.", "none.", "нет", "нет."]


def unified_items(replies: DataFrame) -> DataFrame:
    """One row per item of the administrative payload of each reply."""
    p = js.administrative_payload("reply", "context")
    return replies.select("meeting_id", p.alias("p")).select("meeting_id", F.posexplode("p.items").alias("pos", "i")).select("meeting_id", "pos", "i.*")


def topic_union(topics: DataFrame) -> DataFrame:
    """Items of all topics as flat rows in topic order; decisions, tasks, then questions inside a topic."""
    obj = js.recover_object("reply")
    kinds = [("decisions", "decision"), ("tasks", "task"), ("open_questions", "open_question")]
    out = None
    for rank, (name, kind) in enumerate(kinds):
        part = topics.select("meeting_id", "topic_no", F.lit(rank).alias("bucket"), F.posexplode(js.topic_items(obj, name, kind)).alias("pos", "i"))
        out = part if out is None else out.unionByName(part)
    return out.select("meeting_id", "topic_no", "bucket", "pos", "i.*")


def topic_names(topics: DataFrame) -> DataFrame:
    return topics.where(F.trim("name") != "").select("meeting_id", "topic_no", "name")


def first_seen_union(stages: DataFrame) -> DataFrame:
    """Distinct stage names in the order of the first run and position they appear at."""
    return stages.groupBy("stage").agg(F.min(F.struct("run", "ord")).alias("first")).select("stage", F.col("first.run").alias("run"), F.col("first.ord").alias("ord"))


def item_order() -> list[Column]:
    """O2: by timestamp, untimed items last by text."""
    sec = tx.timestamp_seconds("timestamp")
    return [F.coalesce(sec, F.lit(10**9)), F.when(sec.isNull(), F.col("text")).otherwise("")]


# ---- sectioned replies ------------------------------------------------------------------------
def sectioned_lines(replies: DataFrame) -> DataFrame:
    """Items of a sectioned reply; a window per reply carries the last heading down its own lines."""
    heading = {h: s for s, hs in SECTIONS.items() for h in hs}
    lookup = F.create_map(*[F.lit(x) for kv in heading.items() for x in kv])
    lines = replies.select("reply_id", F.posexplode(F.split("reply", "\n")).alias("pos", "raw")).withColumn("line", tx.strip("raw")).where("line <> ''")
    head = F.upper(tx.strip(F.regexp_replace(F.replace(F.regexp_replace("line", r"(?U)^#{1,6}\s*", ""), F.lit("**"), F.lit("")), ":+$", "")))
    lines = lines.withColumn("head", F.try_element_at(lookup, head))
    w = Window.partitionBy("reply_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    body = lines.withColumn("section", F.last("head", ignorenulls=True).over(w)).where("head is null and section is not null")
    summary = (F.col("section") == "summary") & ~F.lower("line").isin("net", "none", "net.", "none.")
    bullet = (F.col("section") != "summary") & (F.col("line").rlike(r"(?U)^[-*]|^\d+[.)]\s"))
    item = tx.strip(F.regexp_replace("line", r"(?U)^[-*]\s*|^\d+[.)]\s*", ""))
    noise = F.lower(item).isin(*EMPTY_WORDS) | item.isin(*tx.NOISE_ITEMS)
    for p in SECTION_NOISE:
        noise = noise | item.startswith(p)
    text = F.when(F.col("section") == "summary", F.ltrim(F.ltrim("line", F.lit("- ")), F.lit("* "))).otherwise(item)
    kept = body.where(summary | (bullet & ~noise)).withColumn("item", text)
    parts = F.transform(F.split("item", r"\|"), tx.strip)
    optional = lambda i: F.when(F.lower(F.get(parts, F.lit(i))).isin("net", "none", "-", ""), None).otherwise(F.get(parts, F.lit(i)))
    task = F.col("section") == "tasks"
    return kept.select(
        "reply_id",
        "pos",
        "section",
        F.when(task, F.get(parts, F.lit(0))).otherwise(F.col("item")).alias("text"),
        F.when(task, optional(1)).alias("assignee"),
        F.when(task, optional(2)).alias("deadline"),
    )


# ---- corrections ------------------------------------------------------------------------------
def correction_turns(batched: DataFrame) -> DataFrame:
    """Rows offered for correction: dense turn id, speaker label, stripped text, position in the batch."""
    who = F.coalesce(F.when(F.col("speaker_name") != "", F.col("speaker_name")), F.when(F.col("speaker_id") != "", F.col("speaker_id")), F.lit(""))
    idx = dense_index(batched, by_position(), "turn_id")
    pos = F.row_number().over(Window.partitionBy("meeting_id", "batch").orderBy("ord")) - 1
    return idx.select("meeting_id", "ord", "batch", F.col("turn_id").cast("long").alias("turn_id"), who.alias("speaker"), tx.strip(F.coalesce("text", F.lit(""))).alias("text")).withColumn("pos", pos)


def batch_payloads(turns: DataFrame) -> DataFrame:
    """One JSON array per batch; a batch is bounded by its character budget."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "turn_id", "speaker", "text")))
    return turns.groupBy("meeting_id", "batch").agg(F.to_json(F.transform(rows, lambda r: F.struct(r["turn_id"].alias("turn_id"), r["speaker"].alias("speaker"), r["text"].alias("text")))).alias("payload"))


def enrich(batches: DataFrame, fn) -> DataFrame:
    """run ``fn(payloads: list[str]) -> list[str | None]`` over Arrow batches of batch payloads."""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(raw=fn(pdf["payload"].tolist()))[["meeting_id", "batch", "raw"]]

    kinds = dict(batches.dtypes)
    return batches.mapInPandas(run, f"meeting_id {kinds['meeting_id']}, batch {kinds['batch']}, raw string")


def validated_corrections(turns: DataFrame, replies: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """A batch is taken only when length, ids, speakers and non-empty texts agree; turns that drift revert.

    ``status`` is failed (no JSON), rejected (invariant broken), reverted, corrected or kept.
    """
    key = ["meeting_id", "batch"]
    parsed = replies.select(*key, js.recover_array("raw").alias("arr"))
    state = parsed.select(*key, F.col("arr").isNull().alias("unparsed"))
    v = F.try_variant_get(F.try_parse_json("arr"), "$", "array<variant>")
    got = parsed.select(*key, F.posexplode(v).alias("pos", "e")).select(
        *key,
        "pos",
        F.try_variant_get("e", "$.turn_id", "bigint").alias("c_id"),
        js.field(F.col("e"), "speaker").alias("c_speaker"),
        tx.strip(F.coalesce(js.field(F.col("e"), "text"), F.lit(""))).alias("c_text"),
        F.lit(True).alias("present"),
    )
    both = turns.join(got, [*key, "pos"], "full")
    good = F.col("present").isNotNull() & F.col("turn_id").isNotNull() & (F.col("c_id") == F.col("turn_id")) & (F.col("c_speaker") == F.col("speaker")) & (F.col("c_text") != "")
    verdict = both.groupBy(*key).agg(F.every(F.coalesce(good, F.lit(False))).alias("valid"))
    out = turns.join(verdict, key, "left").join(state, key, "left").join(got.select(*key, "pos", "c_text"), [*key, "pos"], "left")
    failed = F.coalesce("unparsed", F.lit(True))
    drift = tx.token_overlap("text", "c_text") < min_overlap
    status = (
        F.when(failed, "failed")
        .when(~F.col("valid"), "rejected")
        .when(drift, "reverted")
        .when(F.col("c_text") != F.col("text"), "corrected")
        .otherwise("kept")
    )
    return out.withColumn("status", status).select(
        *key, "pos", "ord", "turn_id", "speaker", "text", F.when(status.isin("corrected", "kept"), F.col("c_text")).otherwise(F.col("text")).alias("new_text"), "status"
    )


def splice_corrections(aligned: DataFrame, corrections: DataFrame) -> DataFrame:
    """Accepted texts back onto the segments; everything else unchanged."""
    new = corrections.where(F.col("status").isin("corrected", "kept", "reverted")).select("meeting_id", "ord", "new_text")
    return aligned.join(new, ["meeting_id", "ord"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def correction_statistics(corrections: DataFrame) -> DataFrame:
    """Turns and batches corrected, rejected and failed; characters before and after."""
    per_batch = corrections.groupBy("meeting_id", "batch").agg(
        F.first("status").alias("s"),
        F.count("*").alias("turns"),
        F.count_if(F.col("status") == "corrected").alias("corrected"),
        F.sum(F.length("text")).alias("chars_before"),
        F.sum(F.length("new_text")).alias("chars_after"),
    )
    return per_batch.groupBy("meeting_id").agg(
        F.sum("turns").alias("total_turns"),
        F.sum("corrected").alias("corrected_turns"),
        F.count_if(F.col("s") == "rejected").alias("rejected_batches"),
        F.sum(F.when(F.col("s") == "rejected", F.col("turns")).otherwise(0)).alias("rejected_turns"),
        F.count_if(F.col("s") == "failed").alias("failed_batches"),
        F.sum("chars_before").alias("chars_before"),
        F.sum("chars_after").alias("chars_after"),
    )


# ---- fuzzy union ------------------------------------------------------------------------------
# Where an item of each kind is listed.
BUCKETS = {"decision": "decisions", "task": "tasks", "open_question": "open_questions", "risk": "risks"}
CELL = 512  # Texts of a class of lengths that meet others as one cell.
BATCH = 1 << 12  # Texts, with their copies for several cells, that a task holds at once.


def similarity(a: str, b: str) -> float:
    """Share of matched characters (the first text is the later item's)."""
    return SequenceMatcher(None, a, b).ratio()


def _ratios(a: pd.Series, b: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(similarity(x, y) if p else 0.0, similarity(y, x) if q else 0.0) for x, y, p, q in zip(a, b, first, second)], columns=["ab", "ba"])


def common_length(places: dict[str, int], n: int, other: str, least: float) -> int:
    """Length of the longest common subsequence of ``other`` and a text of ``n`` characters, given by the places of each character as bits; 0 once it cannot reach ``least``."""
    full = (1 << n) - 1
    free = full
    for k in range(0, len(other), 16):
        for c in other[k : k + 16]:
            met = free & places.get(c, 0)
            free = ((free + met) | (free - met)) & full
        # Every character to come adds one at most.
        if n - free.bit_count() + max(0, len(other) - k - 16) < least:
            return 0
    return n - free.bit_count()


def _places(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def may_be_similar(rows: pd.DataFrame, floor: float) -> pd.DataFrame:
    """Pairs of the texts that were sent to the same two cells, without those that share too few characters, or too few in order."""
    texts, asks, side = rows["v"].tolist(), rows["asks"].to_numpy(bool), rows["side"].to_numpy()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    kinds, spelled = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    held = np.bincount(np.repeat(np.arange(len(texts)), size) * len(kinds) + spelled, minlength=len(texts) * len(kinds)).reshape(len(texts), -1).astype(np.int32)
    met: list[tuple[int, int]] = []
    for at in rows.groupby(["meeting_id", "zone", "lo", "p", "hi", "q"], sort=False).indices.values():
        left, right = at[side[at] != 1], at[side[at] != 0]
        used = np.flatnonzero(held[left].any(axis=0))
        own = held[np.ix_(right, used)]
        step = max(1, (1 << 21) // max(1, own.size))
        for k in range(0, len(left), step):
            part = left[k : k + step]
            shared = np.minimum(held[np.ix_(part, used)][:, None, :], own[None, :, :]).sum(axis=2)
            near = 2 * shared >= floor * (size[part][:, None] + size[right]) - 1e-9
            near &= (asks[part][:, None] | asks[right]) & ((side[part][:, None] != 2) | (part[:, None] < right))
            for i, js_ in zip(part.tolist(), near, strict=True):
                others = right[js_].tolist()
                if others:
                    places, n = _places(texts[i]), len(texts[i])
                    met += [(i, j) for j in others if common_length(places, n, texts[j], floor * (n + len(texts[j])) / 2 - 1e-9)]
    i, j = np.array(met, np.int64).reshape(-1, 2).T
    swap = np.fromiter((texts[x] > texts[y] for x, y in met), bool, len(met))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    v = rows["v"].to_numpy()
    return pd.DataFrame({"meeting_id": rows["meeting_id"].to_numpy()[i], "a": v[i], "b": v[j], "a_asks": asks[i], "b_asks": asks[j]})


def similar_pairs(values: DataFrame, floor: float) -> DataFrame:
    """``meeting_id``, ``a``, ``b`` (different texts, ``a`` first), ``ab``, ``ba``: pairs whose similarity reaches ``floor`` in one direction.

    ``values`` has ``meeting_id``, ``zone``, ``v`` and ``asks``: texts meet inside a zone, and a direction counts if its first text asks.  What two texts match is in order in both, so no similarity
    exceeds twice their longest common subsequence over all characters, nor twice their shared characters.  Texts travel, not pairs: those of a zone are dealt to cells by length (similar texts lie in
    the same class of lengths or in neighbouring ones) and, beyond ``CELL`` texts, by hash; each text goes to every cell it may meet, and pairs leave a task only if both bounds allow them.
    """
    width = math.log((2 - floor) / floor * (1 + 1e-6))
    kinds = values.where("v <> ''").groupBy("meeting_id", "v").agg(F.max("asks").alias("asks"))
    texts = cut(values.select("meeting_id", "zone", "v").distinct().join(kinds, ["meeting_id", "v"]).withColumn("c", F.floor(F.log(F.length("v")) / width).cast("int")))
    classes = texts.groupBy("meeting_id", "zone", "c").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"), F.count(F.lit(1)).alias("k"))
    zones = cut(classes.groupBy("meeting_id", "zone").agg(F.sum("k").alias("k"), F.map_from_entries(F.collect_list(F.struct("c", "parts"))).alias("parts")))
    few = F.col("k") <= CELL
    placed = texts.join(zones, ["meeting_id", "zone"]).withColumns({"c": F.when(few, 0).otherwise(F.col("c")), "parts": F.when(few, F.create_map(F.lit(0), F.lit(1))).otherwise(F.col("parts"))})
    parts = lambda c: F.coalesce(F.try_element_at("parts", c), F.lit(0))
    c, p = F.col("c"), F.col("part")
    each = lambda c, cell: F.transform(F.slice(F.sequence(F.lit(0), parts(c)), 1, parts(c)), cell)
    cell = lambda lo, p, hi, q, side: F.struct(lo.alias("lo"), p.alias("p"), hi.alias("hi"), q.alias("q"), side.cast("int").alias("side"))
    inside = each(c, lambda q: cell(c, F.least(p, q), c, F.greatest(p, q), F.when(p == q, 2).when(p < q, 0).otherwise(1)))
    longer, shorter = each(c + 1, lambda q: cell(c, p, c + 1, q, F.lit(0))), each(c - 1, lambda q: cell(c - 1, q, c, p, F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("v"), parts(c)).cast("int"))
    sent = placed.select("meeting_id", "zone", "v", "asks", F.inline(F.concat(inside, longer, shorter)))
    # Small zones share a batch: most meetings have a handful of texts.  Few bytes but much work a row: spread over all cores, whatever their size.
    tasks = 4 * values.sparkSession.sparkContext.defaultParallelism
    batches = max(tasks, 1 + sent.select("side").count() // BATCH)
    sent = sent.withColumn("batch", F.pmod(F.xxhash64("meeting_id", "zone", "lo", "p", "hi", "q"), F.lit(batches)))
    kind = values.schema["meeting_id"].dataType.simpleString()
    sent = sent.repartition(max(tasks, batches // 16), "batch")
    close = sent.groupBy("batch").applyInPandas(lambda rows: may_be_similar(rows, floor), f"meeting_id {kind}, a string, b string, a_asks boolean, b_asks boolean").distinct()
    close = close.repartition(tasks, "a", "b")
    close = close.withColumn("r", F.pandas_udf(_ratios, "struct<ab:double,ba:double>")("a", "b", "a_asks", "b_asks"))
    return close.select("meeting_id", "a", "b", "r.ab", "r.ba").where((F.col("ab") >= floor) | (F.col("ba") >= floor))


def _zones(items: DataFrame, v: str) -> DataFrame:
    """Texts with the stretches of time they may meet others in: neighbouring ones share a stretch."""
    zone = F.floor(F.col("s") / NEAR_SECONDS)
    return items.where(F.col("s").isNotNull() & (F.col(v) != "")).select("meeting_id", F.explode(F.array(zone, zone + 1)).alias("zone"), F.col(v).alias("v"), F.col("candidate").alias("asks"))


def accept(items: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Candidates of whole components that repeat neither an existing nor an earlier accepted item, in order; components do not decide about each other."""
    near: dict[tuple, list[tuple[tuple, float]]] = {}
    for p in pairs.itertuples(index=False):
        a, b = (p.meeting_id, p.side, p.a), (p.meeting_id, p.side, p.b)
        near.setdefault(a, []).append((b, p.ab))
        near.setdefault(b, []).append((a, p.ba))
    times: dict[tuple, list[int]] = {}
    kept = []

    def close(v: tuple, s) -> bool:
        at = times.get(v, [])
        k = bisect.bisect_left(at, s - NEAR_SECONDS)
        return k < len(at) and at[k] <= s + NEAR_SECONDS

    for r in items.sort_values("seq").itertuples(index=False):
        s = None if pd.isna(r.s) else int(r.s)
        t, e = (r.meeting_id, "t", r.t), (r.meeting_id, "e", r.e)
        if r.candidate:
            repeated = t in times or (r.e and e in times)
            repeated = repeated or any(ratio >= SAME_TEXT and v in times or ratio >= NEAR_TEXT and s is not None and close(v, s) for v, ratio in near.get(t, []))
            if repeated or (r.e and s is not None and any(ratio >= NEAR_EVIDENCE and close(v, s) for v, ratio in near.get(e, []))):
                continue
            kept.append((r.meeting_id, int(r.seq)))
        for v in (t, e):
            if v[2]:
                at = times.setdefault(v, [])
                if s is not None:
                    bisect.insort(at, s)
    return pd.DataFrame(kept, columns=["meeting_id", "seq"])


def fuzzy_union(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """U4: existing items plus the candidates that repeat neither an existing nor an earlier accepted one, with the ``bucket`` of their kind.

    Items that could decide about each other (equal or similar texts or evidence) form components; each is settled by one walk in order.
    """
    cols = ["meeting_id", "ord", "kind", "text", "evidence", "timestamp"]
    both = existing.select(*cols, F.lit(False).alias("candidate")).unionByName(candidates.select(*cols, F.lit(True).alias("candidate")))
    # Existing items come first: order by (candidate, ord) through one integer.
    width = both.groupBy("meeting_id").agg((F.max("ord") + 1).alias("w"))
    both = both.join(width, "meeting_id").withColumn("seq", F.col("ord") + F.when(F.col("candidate"), F.col("w")).otherwise(0)).drop("w")
    forms = {"t": tx.item_normalise("text"), "e": tx.item_normalise("evidence"), "s": tx.timestamp_seconds("timestamp")}
    both = cut(both.withColumns(forms))
    # Rows that agree in text, evidence and time stand or fall together behind the first of them, so copies are
    # reduced to that one before anything is compared.
    firsts = both.where("t <> ''").groupBy("meeting_id", "t", "e", "s").agg(F.min(F.struct("seq", "candidate")).alias("f"))
    items = cut(firsts.select("meeting_id", "t", F.coalesce("e", F.lit("")).alias("e"), "s", F.col("f.seq").alias("seq"), F.col("f.candidate").alias("candidate")))
    anywhere = items.select("meeting_id", F.lit(0).cast("long").alias("zone"), F.col("t").alias("v"), F.col("candidate").alias("asks"))
    found = [(similar_pairs(anywhere, SAME_TEXT), "t"), (similar_pairs(_zones(items, "t"), NEAR_TEXT), "t"), (similar_pairs(_zones(items, "e"), NEAR_EVIDENCE), "e")]
    pairs = cut(reduce(DataFrame.unionByName, [p.withColumn("side", F.lit(side)) for p, side in found]).distinct())
    # Vertices are texts and evidence; an item links its two, a pair links its own.
    vertex = lambda side, v: F.xxhash64("meeting_id", side, v)
    links = items.where("e <> ''").select(vertex(F.lit("t"), "t").alias("u"), vertex(F.lit("e"), "e").alias("v"))
    links = links.unionByName(pairs.select(vertex(F.col("side"), "a").alias("u"), vertex(F.col("side"), "b").alias("v")))
    root = components(links)
    own = lambda df, v: df.withColumn("id", v).join(root, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("id", "component")
    # Most components are a single item: many share a batch, none is divided.
    batches = max(4 * items.sparkSession.sparkContext.defaultParallelism, 1 + items.count() // BATCH)
    batch = F.pmod(F.xxhash64("meeting_id", "group"), F.lit(batches)).alias("batch")
    grouped = own(items, vertex(F.lit("t"), "t")).withColumn("batch", batch).groupBy("batch")
    beside = own(pairs, vertex(F.col("side"), "a")).withColumn("batch", batch).groupBy("batch")
    kind = items.schema["meeting_id"].dataType.simpleString()
    kept = grouped.cogroup(beside).applyInPandas(accept, f"meeting_id {kind}, seq long")
    accepted = both.where("candidate").join(kept, ["meeting_id", "seq"], "left_semi")
    bucket = reduce(lambda w, b: w.when(F.col("kind") == b[0], b[1]), BUCKETS.items(), F.when(F.lit(False), ""))
    return both.where("not candidate").unionByName(accepted).select(*cols, "candidate", "seq", bucket.alias("bucket"))


def bucketed(union: DataFrame) -> DataFrame:
    """The items of each bucket of a meeting with their place in it: existing ones first, accepted ones behind them."""
    listed = union.where("bucket is not null")
    return dense_index(listed, by_position(("meeting_id", "bucket"), "seq"), "place")
