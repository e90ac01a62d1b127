"""Exact Jaccard join of documents on word shingles in metric space, and the components of its links.

Distances are ``1 - |x & y| / |x | y|``.  Equal sets are one document first.  Then regions are cut in three levels, each exact:

* Level 1, singleton pivots.  A pivot is a set of one shingle; documents lie at distance 1 from it unless they hold it.  Under one total
  order of shingles a document's own regions are its first shingles, and the triangle inequality for the symmetric difference bounds
  how far it must be replicated: skipping i of its shingles costs i, so ``n // 4 + 1`` regions reach every document within 0.25.  The order puts
  shingles last that many documents of a sample hold (one in ``HINT_SHARE``); it decides cost only, never results.
* Pairs of a region of at most ``DENSE`` documents are counted over all their regions; counts and sizes bound the overlap from above, which leaves
  little more than true links to be compared by their texts.
* Level 2, document pivots.  A denser region takes its most typical document as pivot; distances to it are computed.  Documents within 0.25
  are linked through it.  Only those outside are compared further, and only with documents whose distance to the pivot differs by 0.25 at most.
* Level 3.  These comparisons run on a grid of bounded blocks of the region, and stop for documents already in one component.

Defined results: texts without words and nulls have no shingles and no links; texts of fewer words than a shingle are one shingle; rows that share
an id share a component, rows without an id have no links; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.words import HALF_CHUNK, chunks, commonest, find_words, mix, runs_hash, tidy
from parlance.operators.components import components
from parlance.session import cut

SHINGLE = 5
DENSE = 64
HINT_SHARE = 8  # One document in so many is in the sample that orders shingles.
HINT_TOKENS = 1 << 18  # Bound of the list of frequent shingles it yields.
SIDE = 512  # Documents on either side of a block of comparisons.
FREQUENT = np.int64(1) << np.int64(62)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = find_words(texts)
    h, at = runs_hash(w, k)
    doc = w.doc[at]
    where = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = [np.unique(h[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)]
    for i in np.flatnonzero((np.diff(w.first) < k) & (np.diff(w.first) > 0)):
        own = w.hash[w.first[i] : w.first[i + 1]]
        out[i] = mix(np.array([(own * mix(np.arange(len(own), dtype=np.uint64) + np.uint64(77 * len(own)))).sum(dtype=np.uint64)]))
    return out


def _sample_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, limit=HALF_CHUNK):
            sets = [s >> np.uint64(2) for s in shingle_sets(part.column("text"))]
            if sets:
                yield pa.record_batch({"key": np.concatenate(sets).view(np.int64)})


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that at least three documents of the sample hold, the commonest ``HINT_TOKENS``."""
    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(HINT_SHARE)) == 0).select("text")
    counts = cut(sample.mapInArrow(tidy(_sample_shingles), "key long").groupBy("key").count().where("count >= 3"))
    rows = commonest(counts, "count", HINT_TOKENS)[0].select("key").toArrow()
    return np.sort(rows["key"].to_numpy())


def _heads(frequent: np.ndarray):
    """Size, digest and regions of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=HALF_CHUNK):
                sizes, digests, ends, regions = [], [], [0], []
                for s in shingle_sets(part.column("text")):
                    keys = (s >> np.uint64(2)).view(np.int64)
                    if len(keys) and len(frequent):
                        spot = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
                        hit = frequent[spot] == keys
                        if hit.any():
                            keys = np.concatenate([keys[~hit], keys[hit] | FREQUENT])
                    first = keys[: len(keys) // 4 + 1]
                    sizes.append(len(keys))
                    digests.append((_digest(s, 1), _digest(s, 2)))
                    regions.append(first)
                    ends.append(ends[-1] + len(first))
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "n": pa.array(sizes, pa.int64()),
                        "d0": pa.array([d[0] for d in digests], pa.int64()),
                        "d1": pa.array([d[1] for d in digests], pa.int64()),
                        "regions": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(regions) if regions else [], pa.int64())),
                    }
                )

    return run


def _digest(s: np.ndarray, salt: int) -> int:
    return int(mix(s + np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0


BITS = 1 << 22


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id`` and ``text`` of some documents.  A bitmap of ``BITS`` bits thins out the texts before they are joined exactly."""
    spot = F.pmod(F.xxhash64("id"), F.lit(BITS)) + 1  # bitmaps count from 1
    maps = ids.select(spot.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    bits = np.zeros(BITS, bool)
    for r in maps:
        at = (r["k"] - 1) * 32768
        bits[at : at + 32768] = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")
    packed = np.packbits(bits, bitorder="little")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("b").to_numpy() - 1
            yield batch.select(["id", "text"]).filter(pa.array((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    rows = docs.select("id", "text", spot.alias("b")).mapInArrow(tidy(thin), "id long, text string")
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of intersection and union of two texts per row."""
    for batch in batches:
        for part in chunks(batch, "tx", HALF_CHUNK):
            xs, ys = shingle_sets(part.column("tx")), shingle_sets(part.column("ty"))
            both = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(xs, ys, strict=True)]
            either = [len(a) + len(b) - c for a, b, c in zip(xs, ys, both, strict=True)]
            yield pa.record_batch({"x": part.column("x"), "y": part.column("y"), "both": pa.array(both, pa.int64()), "either": pa.array(either, pa.int64())})


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``x``, ``y``, ``both``, ``either`` of pairs, from their texts."""
    tx, ty = texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), texts.select(F.col("id").alias("y"), F.col("text").alias("ty"))
    return pairs.select("x", "y").join(tx, "x").join(ty, "y").select("x", "y", "tx", "ty").mapInArrow(tidy(_compare), "x long, y long, both long, either long")


LINKED = "100 * both >= 75 * either"


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the outer documents and the members of one block, at most one per outer document and component."""
    outer, inner = rows[rows["outer"]].reset_index(drop=True), rows[~rows["outer"]].reset_index(drop=True)
    found: list[tuple[int, int]] = []
    if len(outer) and len(inner):
        sets = shingle_sets(pa.array(inner["text"], pa.string()))
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        ids, comps, dist = inner["id"].to_numpy(), inner["component"].to_numpy(), inner["d"].to_numpy()
        for i, s in enumerate(shingle_sets(pa.array(outer["text"], pa.string()))):
            mine, comp, d = outer["id"].iloc[i], outer["component"].iloc[i], outer["d"].iloc[i]
            lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
            spans = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            link = (7 * both >= 3 * (sizes + len(s))) & (comps != comp) & (ids != mine) & (np.abs(dist - d) <= 0.25 + 1e-9)
            _, once = np.unique(comps[link], return_index=True)
            found += [(int(mine), int(j)) for j in ids[link][once]]
    return pd.DataFrame(found, columns=["u", "v"]).astype("int64")


def jaccard_components(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``ids``, ``n_shingles`` and ``component_id`` (least id reachable over links of Jaccard similarity 0.75 or more) of every row."""
    docs = docs.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text"))
    heads = cut(docs.mapInArrow(tidy(_heads(frequent_shingles(docs))), "id long, n long, d0 long, d1 long, regions array<long>"))
    filled = heads.where("n > 0")
    groups = cut(filled.groupBy("d0", "d1", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    copies = cut(filled.select("id", "d0", "d1", "n").join(groups, ["d0", "d1", "n"]).where("id <> rep").select("id", "rep").distinct())
    single = filled.join(copies, "id", "left_anti").select("id", "n", "regions")
    regions = single.select("id", F.explode("regions").alias("region"))
    sizes = cut(regions.groupBy("region").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = cut(regions.join(sizes, "region"))
    dense = shared.groupBy("id").agg(F.sum((F.col("df") > DENSE).cast("long")).alias("hot"))
    facts = single.select("id", "n", F.size("regions").cast("long").alias("a"), F.element_at("regions", -1).alias("last")).join(dense, "id")
    facts = cut(facts)

    cold = cut(shared.where(F.col("df") <= DENSE).select("region", "id").join(facts, "id"))
    x, y = cold.alias("x"), cold.alias("y")
    near_size = (F.col("x.n") * 4 >= F.col("y.n") * 3) & (F.col("y.n") * 4 >= F.col("x.n") * 3)
    met = x.join(y, (F.col("x.region") == F.col("y.region")) & (F.col("x.id") < F.col("y.id")) & near_size)
    pairs = met.groupBy(F.col("x.id").alias("x"), F.col("y.id").alias("y")).agg(
        F.count(F.lit(1)).alias("c"), *[F.first(f"{s}.{v}").alias(f"{s}_{v}") for s in "xy" for v in ("n", "a", "last", "hot")]
    )
    # Up to where the first of the two ends its regions, every common shingle is counted or in a dense region; beyond, at most its rest is common.
    rest = F.when(F.col("x_last") <= F.col("y_last"), F.col("x_n") - F.col("x_a")).otherwise(F.col("y_n") - F.col("y_a"))
    most = F.col("c") + F.least("x_hot", "y_hot") + rest
    pairs = cut(pairs.where(most * 7 >= (F.col("x_n") + F.col("y_n")) * 3).select("x", "y"))

    hot = shared.where(F.col("df") > DENSE).select("region", "id").join(facts.where("hot > 0"), "id")
    typical = F.max_by("id", F.struct(F.col("hot") / F.col("a"), -F.col("id")))
    pivots = cut(hot.groupBy("region").agg(typical.alias("pivot")))
    members = cut(hot.select("region", "id").join(pivots, "region").select("pivot", "id").distinct())
    needed = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).unionByName(members.select("id"))
    texts = cut(texts_of(docs, needed))

    # Every document with its least neighbour first; most other pairs then lie in one component and need no comparison.
    star = pairs.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")
    spokes = members.where("pivot <> id").select(F.col("pivot").alias("x"), F.col("id").alias("y"))
    first = cut(compare(star.unionByName(spokes).distinct(), texts))
    links = cut(first.where(LINKED).select(F.col("x").alias("u"), F.col("y").alias("v")))
    known = cut(components(links))

    of = lambda side: known.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    apart = F.coalesce("cx", "x") != F.coalesce("cy", "y")
    left = pairs.join(star, ["x", "y"], "left_anti").join(of("x"), "x", "left").join(of("y"), "y", "left").where(apart)
    more = compare(left.select("x", "y"), texts).where(LINKED).select(F.col("x").alias("u"), F.col("y").alias("v"))
    links = links.unionByName(more).unionByName(_outer_links(members, first, known, texts))
    found = components(links)

    comp = found.select("id", "component")
    moved = copies.select(F.col("id").alias("copy"), F.col("rep").alias("id")).join(comp, "id", "left").select(F.col("copy").alias("id"), F.coalesce("component", "id").alias("component"))
    every = cut(comp.unionByName(moved).groupBy("id").agg(F.min("component").alias("component")))
    return heads.join(every, "id", "left").select(F.col("id").alias(ids), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _outer_links(members: DataFrame, first: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of documents of a dense region that its pivot's links have not yet joined to the pivot.

    All others are one component with the pivot, so only pairs with one of these can still join anything.
    """
    away = first.select(F.col("x").alias("pivot"), F.col("y").alias("id"), (1 - F.col("both") / F.col("either")).alias("d"))
    placed = members.join(away, ["pivot", "id"], "left").join(known, "id", "left")
    own = F.col("id") == F.col("pivot")
    placed = cut(placed.select("pivot", "id", F.when(own, 0.0).otherwise(F.col("d")).alias("d"), F.coalesce("component", "id").alias("component")))
    centre = placed.where(own).select("pivot", F.col("component").alias("centre"))
    placed = cut(placed.join(centre, "pivot").withColumn("inside", F.col("component") == F.col("centre")).drop("centre"))
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("rows"), F.ceil(F.sum((~F.col("inside")).cast("int")) / SIDE).alias("cols"))
    sizes = cut(sizes.where("cols > 0"))
    laid = placed.join(sizes, "pivot")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1).cast("array<long>"))
    inner = laid.select("pivot", F.pmod(F.xxhash64("id"), "rows").alias("r"), everywhere("cols").alias("c"), "id", "d", "component", F.lit(False).alias("outer"))
    outer = laid.where("not inside").select("pivot", everywhere("rows").alias("r"), F.pmod(F.xxhash64("id", F.lit(3)), "cols").alias("c"), "id", "d", "component", F.lit(True).alias("outer"))
    rows = inner.unionByName(outer).join(texts, "id")
    return rows.groupBy("pivot", "r", "c").applyInPandas(_block_links, "u long, v long")
