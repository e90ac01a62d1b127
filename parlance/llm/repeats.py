"""Passages that repeat across documents, by hash grouping of keys at minimiser positions.

A suffix is kept where its next ``KEY`` words have the least hash among ``WINDOW`` neighbouring positions, so content alone selects positions and every
passage of ``WINDOW + KEY - 1 = 50`` words holds one whose key lies inside it.  No suffix is sorted and no neighbours
are compared: keys are grouped by their digest, and those of at least two documents are seeds.  All windows of 50 words that hold a seed's key
are grouped by digest again, and those of two documents are repeats.  Overlapping windows make one span.

Groups are counted by partial aggregation, so a passage that a third of all documents hold is never gathered in one task.

Defined results: rows without an id, nulls, empty texts and texts of fewer than 50 words have no spans; A-Z equals a-z; words are told apart by 64-bit digests; repeated rows
of one id are one document; the owner of a repeated window is the least id that holds it; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.jaccard import texts_of
from parlance.llm.words import HALF_CHUNK, Words, chunks, find_words, mix, runs_hash, tidy
from parlance.session import cut

KEY = 19
WINDOW = 32
LENGTH = KEY + WINDOW - 1


def minimisers(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Selected word positions (indices into ``w``) and the digests of their keys.

    The least of a second hash in each stretch of ``WINDOW`` positions of one row is selected, the first among equals; a row of fewer words than a passage has none.
    """
    h, at = runs_hash(w, KEY)
    if not len(h):
        return at, h
    rank = mix(h + np.uint64(0x5EED))
    doc = w.doc[at]
    n = len(h) - WINDOW + 1
    chosen = np.zeros(len(h), bool)
    if n > 0:
        least, arg = rank[:n].copy(), np.arange(n)
        for j in range(1, WINDOW):
            lower = rank[j : j + n] < least
            least = np.where(lower, rank[j : j + n], least)
            arg[lower] = np.flatnonzero(lower) + j
        chosen[arg[doc[:n] == doc[WINDOW - 1 :]]] = True
    return at[chosen], h[chosen]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, limit=HALF_CHUNK):
            w = find_words(part.column("text"))
            at, h = minimisers(w)
            ids = part.column("id").to_numpy()
            yield pa.record_batch({"key": pa.array(h.view(np.int64)), "id": pa.array(ids[w.doc[at]]), "at": pa.array((at - w.first[w.doc[at]]).astype(np.int32))})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all windows of ``LENGTH`` words that hold a seed's key."""
    for batch in batches:
        for part in chunks(batch, limit=HALF_CHUNK):
            w = find_words(part.column("text"))
            h, at = runs_hash(w, LENGTH)
            ids = part.column("id").to_numpy()
            doc = w.doc[at]
            pos = at - w.first[doc]
            wanted = np.zeros(len(w.hash) + 1, np.int64)
            for i, seeds in enumerate(part.column("seeds").to_pylist()):
                s = np.asarray(seeds, np.int64)
                # Windows starting from LENGTH - KEY words before a seed up to the seed hold its whole key.
                np.add.at(wanted, w.first[i] + np.maximum(s - (LENGTH - KEY), 0), 1)
                np.add.at(wanted, w.first[i] + s + 1, -1)
            keep = np.cumsum(wanted)[at] > 0
            yield pa.record_batch({"digest": pa.array(h[keep].view(np.int64)), "id": pa.array(ids[doc[keep]]), "start": pa.array(pos[keep].astype(np.int32))})


def repeated_spans(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``ids``, ``start_word``, ``end_word`` (exclusive), ``owner`` (least document that holds a window of it), ``own`` (this document is the owner of
    all its windows) and ``holders`` (occurrences of its commonest window)."""
    docs = docs.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    seeds = docs.mapInArrow(tidy(_seeds), "key long, id long, at int")
    common = cut(seeds.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"))
    met = cut(seeds.join(common, "key").groupBy("id").agg(F.collect_set("at").alias("seeds")))  # at most one entry per word of the document
    # Shuffled, not broadcast: else two Python nodes share a stage, and each task holds two workers.
    texts = texts_of(docs, met.select("id")).join(met.hint("merge"), "id")
    windows = cut(texts.select("id", "text", "seeds").mapInArrow(tidy(_windows), "digest long, id long, start int"))
    runs = windows.groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("documents"))
    runs = cut(runs.where("owner < hi").drop("hi"))
    marked = windows.join(runs, "digest").select("id", "start", "owner", (F.col("owner") == F.col("id")).alias("own"), "documents")
    # One document's windows: at most one per word of it.
    order = Window.partitionBy("id").orderBy("start")
    new = (F.col("start") > F.lag("start").over(order) + LENGTH) | (F.col("own") != F.lag("own").over(order))
    islands = marked.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    return islands.groupBy(F.col("id").alias(ids), "island").agg(
        F.min("start").cast("long").alias("start_word"),
        (F.max("start") + LENGTH).cast("long").alias("end_word"),
        F.min("owner").alias("owner"),
        F.first("own").alias("own"),
        F.max("documents").alias("holders"),
    ).drop("island")


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, limit=HALF_CHUNK):
            w = find_words(part.column("text"))
            data = w.data.tobytes()
            out = []
            bounds = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(part.column("text")), 0).to_numpy())])
            for i, spans in enumerate(part.column("spans").to_pylist()):
                kept, at = [], int(bounds[i])
                for s in sorted(spans, key=lambda s: s["start_word"]):
                    a, b = int(w.start[w.first[i] + s["start_word"]]), int(w.end[w.first[i] + s["end_word"] - 1])
                    if a > at:
                        kept.append(data[at:a])
                    at = max(at, b)
                kept.append(data[at : int(bounds[i + 1])])
                out.append(b"".join(kept).decode("utf-8"))
            yield pa.record_batch({"id": part.column("id"), "_cut_text_": pa.array(out, pa.string())})


def drop_repeats(docs: DataFrame, spans: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose repeated spans are cut out except at their owner; a document left without words goes, all others keep their rows and columns."""
    borrowed = cut(spans.where("not own").groupBy(F.col(ids).alias("id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans")))
    touched = texts_of(docs.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text")), borrowed.select("id")).join(borrowed.hint("merge"), "id")
    fresh = cut(touched.select("id", "text", "spans").mapInArrow(tidy(_cut_text), "id long, _cut_text_ string").dropDuplicates(["id"]))
    new = max(docs.columns, key=len) + "_cut"  # no column's name
    fresh = fresh.select(F.col("id").alias(ids), F.col("_cut_text_").alias(new))
    out = docs.join(fresh, ids, "left")
    empty = F.col(new).isNotNull() & ~F.col(new).rlike(r"[^\x20\x09-\x0D]")
    return out.where(~F.coalesce(empty, F.lit(False))).withColumn(text, F.coalesce(new, text)).select(docs.columns)
