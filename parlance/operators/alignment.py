"""Alignment of long token sequences: longest common run first, then the same left and right of it.

``matching_blocks`` does this for two sequences in memory.  Runs of at least ``k`` tokens are sequences of equal ``k``-grams on one diagonal, so for falling ``k`` all runs of
that length are found by joining grams inside the ranges still open, the longest are taken until none is left, and what lies between them goes on to shorter grams.  Between single common tokens
the rule is a walk: the first token that occurs on the other side goes to its earliest place there.

``aligned_positions`` does it for token rows of recordings of any length.  In large recordings, grams of ``ANCHOR`` tokens are computed in blocks of rows and joined, their runs are islands
on a diagonal, and one task a recording walks the runs (at most one for every token, a small part of them in practice).  The ranges between the runs taken are rows; tokens are sent
to their range, and every range is aligned by itself.  No token list of a large recording is ever held as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordered import by_position, islands
from parlance.session import cut

SMALL = 1 << 12  # Below this product of lengths, counting along diagonals is faster than joining grams.
MANY = 1 << 25  # Equal grams of one level; beyond, a range is searched row by row instead.
GRAMS = (64, 32, 16, 8, 4, 2)
ANCHOR = 32
WHOLE = 1 << 16  # Tokens of a recording that are aligned as one range.
REPEATED = 1 << 10  # A recording that repeats a gram of ANCHOR tokens so often (pairs of places) is aligned as one range.
BLOCK = 4096

Range = tuple[int, int, int, int]


def codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the tokens of both sequences."""
    seen: dict = {}
    enc = lambda xs: np.fromiter((seen.setdefault(x, len(seen)) for x in xs), dtype=np.int64, count=len(xs))
    return enc(a), enc(b)


def longest_run(x: np.ndarray, y: np.ndarray, r: Range) -> tuple[int, int, int]:
    """The longest common run in a range (earliest in ``x``, then in ``y``), row by row; size 0 if nothing is common."""
    alo, ahi, blo, bhi = r
    part = y[blo:bhi]
    run = np.zeros(len(part) + 1, dtype=np.int64)
    size = at_a = at_b = 0
    for i in range(alo, ahi):
        nxt = np.zeros_like(run)
        nxt[1:] = np.where(part == x[i], run[:-1] + 1, 0)
        run = nxt
        j = int(run.argmax())
        if run[j] > size:
            size, at_a, at_b = int(run[j]), i - int(run[j]) + 1, blo + j - int(run[j])
    return at_a, at_b, size


def by_rows(x: np.ndarray, y: np.ndarray, r: Range) -> list[tuple[int, int, int]]:
    todo, out = [r], []
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo < ahi and blo < bhi:
            a, b, n = longest_run(x, y, (alo, ahi, blo, bhi))
            if n:
                out.append((a, b, n))
                todo += [(alo, a, blo, b), (a + n, ahi, b + n, bhi)]
    return out


def take_longest(runs: np.ndarray, r: Range, k: int) -> tuple[list[tuple[int, int, int]], list[Range]]:
    """Blocks taken from the runs (rows of begin, begin, size) of a range while one of ``k`` tokens is left, and the ranges between them."""
    todo, out, open_ = [(runs, r)], [], []
    while todo:
        runs, (alo, ahi, blo, bhi) = todo.pop()
        # What of each run lies inside.
        a, b, n = runs[:, 0], runs[:, 1], runs[:, 2]
        skip = np.maximum(np.maximum(alo - a, blo - b), 0)
        size = np.minimum(np.minimum(a + n, ahi) - a, np.minimum(b + n, bhi) - b) - skip
        keep = size >= k
        if not keep.any():
            if alo < ahi and blo < bhi:
                open_.append((alo, ahi, blo, bhi))
            continue
        a, b, n = (a + skip)[keep], (b + skip)[keep], size[keep]
        best = np.lexsort((b, a, -n))[0]
        i, j, m = int(a[best]), int(b[best]), int(n[best])
        out.append((i, j, m))
        left = np.column_stack([a, b, n])
        todo += [(left[(a < i) & (b < j)], (alo, i, blo, j)), (left[(a + n > i + m) & (b + n > j + m)], (i + m, ahi, j + m, bhi))]
    return out, open_


def diagonal_runs(a: np.ndarray, b: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (begin, begin, size) of equal ``k``-grams at places ``a`` and ``b``, and the owner of each."""
    order = np.lexsort((a, b - a, owner))
    a, b, owner = a[order], b[order], owner[order]
    new = np.ones(len(a), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (b[1:] - a[1:] != b[:-1] - a[:-1]) | (a[1:] != a[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(a))) + k - 1
    return np.column_stack([a[first], b[first], size]), owner[first]


def matching_blocks(a, b) -> list[tuple[int, int, int]]:
    """Longest common block first (earliest in ``a``, then in ``b``), then the same left and right of it."""
    if a == b:
        return [(0, 0, len(a))] if a else []
    return blocks_of_codes(*codes(a, b))


def blocks_of_codes(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    n, m = len(x), len(y)
    if n * m <= SMALL:
        return sorted(by_rows(x, y, (0, n, 0, m)))
    # Numbers of all grams of 2, 4, 8... tokens: a gram is a pair of its halves.
    names = {1: (x, y)}
    for k in reversed(GRAMS):
        p, q = names[k // 2]
        if min(n, m) < k:
            break
        h = k // 2
        pairs = np.concatenate([p[:-h], q[:-h]]) * np.int64(n + m + 1) + np.concatenate([p[h:], q[h:]])
        own = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        names[k] = own[: len(p) - h], own[len(p) - h :]
    out: list[tuple[int, int, int]] = []
    open_: list[Range] = [(0, n, 0, m)]
    for k in GRAMS:
        if k not in names or not open_:
            continue
        p, q = names[k]
        # The range each gram lies in, if it lies in one.
        in_a, in_b = np.full(len(p), -1), np.full(len(q), -1)
        for i, (alo, ahi, blo, bhi) in enumerate(open_):
            in_a[alo : max(alo, ahi - k + 1)] = i
            in_b[blo : max(blo, bhi - k + 1)] = i
        ia, ib = np.flatnonzero(in_a >= 0), np.flatnonzero(in_b >= 0)
        width = np.int64(n + m + 1)
        ka, kb = in_a[ia] * width + p[ia], in_b[ib] * width + q[ib]
        order = np.argsort(kb, kind="stable")
        kb, ib = kb[order], ib[order]
        low, high = np.searchsorted(kb, ka, "left"), np.searchsorted(kb, ka, "right")
        count = high - low
        # Ranges with too many equal grams are searched row by row, in memory that does not grow with them.
        heavy = np.bincount(in_a[ia], weights=count, minlength=len(open_)) > MANY
        for i in np.flatnonzero(heavy):
            out += by_rows(x, y, open_[i])
        count = np.where(heavy[in_a[ia]], 0, count)
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        runs, owner = diagonal_runs(np.repeat(ia, count), ib[at], np.repeat(in_a[ia], count), k)
        ends = np.searchsorted(owner, np.arange(len(open_) + 1))
        still: list[Range] = []
        for i, r in enumerate(open_):
            if not heavy[i]:
                blocks, rest = take_longest(runs[ends[i] : ends[i + 1]], r, k)
                out += blocks
                still += rest
        open_ = still
    for r in open_:
        out += single_tokens(x, y, r)
    return sorted(out)


def single_tokens(x: np.ndarray, y: np.ndarray, r: Range) -> list[tuple[int, int, int]]:
    """Blocks of a range in which no two tokens in a row are common: each token in turn goes to its earliest place that is still free."""
    alo, ahi, blo, bhi = r
    order = np.argsort(y[blo:bhi], kind="stable")
    kinds = y[blo:bhi][order]
    low = np.searchsorted(kinds, x[alo:ahi], "left")
    high = np.searchsorted(kinds, x[alo:ahi], "right")
    out, free = [], 0
    for i in np.flatnonzero(high > low).tolist():
        places = order[low[i] : high[i]]
        k = int(np.searchsorted(places, free))
        if k < len(places):
            free = int(places[k])
            out.append((alo + i, blo + free, 1))
            free += 1
    return out


# ---- recordings of any length -----------------------------------------------------------------
def _grams(tokens: DataFrame) -> DataFrame:
    """``recording_id``, ``pos`` and a hash of the ``ANCHOR`` tokens from there on, in blocks of rows that overlap by a gram."""
    own, first = F.floor(F.col("pos") / BLOCK).cast("long"), F.col("pos") % BLOCK < ANCHOR - 1
    both = tokens.select("recording_id", "pos", F.xxhash64("tok").alias("h"), F.explode(F.when(first & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))).alias("block"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        h = rows["h"].to_numpy().view(np.uint64)
        n = len(h) - ANCHOR + 1
        out = np.zeros(max(n, 0), np.uint64)
        factor = np.uint64(1)
        for j in range(ANCHOR):
            factor = factor * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2)
            if n > 0:
                out += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29))) * (factor | np.uint64(1))
        return pd.DataFrame({"recording_id": rows["recording_id"].iloc[: len(out)], "pos": rows["pos"].iloc[: len(out)], "g": out.view(np.int64)})

    kind = tokens.schema["recording_id"].dataType.simpleString()
    return both.groupBy("recording_id", "block").applyInPandas(run, f"recording_id {kind}, pos long, g long")


def _ranges(gold: DataFrame, hyp: DataFrame, sizes: DataFrame) -> DataFrame:
    """``recording_id``, ``a``, ``b``, ``n``, ``m``: the ranges of every recording that are aligned by themselves, runs already taken among them (``taken``)."""
    kind = gold.schema["recording_id"].dataType.simpleString()
    large = sizes.where(F.col("n") + F.col("m") > WHOLE).select("recording_id")
    g, h = (cut(_grams(t.join(large, "recording_id"))) for t in (gold, hyp))
    shared = g.groupBy("recording_id", "g").agg(F.count(F.lit(1)).alias("x")).join(h.groupBy("recording_id", "g").agg(F.count(F.lit(1)).alias("y")), ["recording_id", "g"])
    dense = shared.where(F.col("x") * F.col("y") > REPEATED).select("recording_id").distinct()
    keys = cut(shared.join(dense, "recording_id", "left_anti").select("recording_id", "g"))
    met = g.join(keys, ["recording_id", "g"]).join(h.withColumnRenamed("pos", "q"), ["recording_id", "g"]).select("recording_id", (F.col("q") - F.col("pos")).alias("d"), "pos")
    marked = islands(met, by_position(("recording_id", "d"), "pos"), ["pos"], lambda prev, cur: cur("pos") != prev("pos") + 1, "begin")
    runs = marked.groupBy("recording_id", "d", "begin").agg((F.count(F.lit(1)) + ANCHOR - 1).alias("size"))
    # A row for recordings without runs, so that every recording has ranges.
    rows = runs.select("recording_id", F.col("begin").alias("a"), (F.col("begin") + F.col("d")).alias("b"), "size").join(sizes, "recording_id", "right")

    def walk(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        n, m = int(runs["n"].iloc[0]), int(runs["m"].iloc[0])
        own = runs.dropna(subset=["a"])[["a", "b", "size"]].to_numpy(np.int64)
        blocks, rest = take_longest(own, (0, n, 0, m), ANCHOR)
        found = [(a, b, s, s, True) for a, b, s in blocks] + [(alo, blo, ahi - alo, bhi - blo, False) for alo, ahi, blo, bhi in rest]
        out = pd.DataFrame(found, columns=["a", "b", "n", "m", "taken"])
        out.insert(0, "recording_id", key[0])
        return out

    return cut(rows.groupBy("recording_id").applyInPandas(walk, f"recording_id {kind}, a long, b long, n long, m long, taken boolean"))


def _placed(tokens: DataFrame, ranges: DataFrame, begin: str, size: str, side: int) -> DataFrame:
    """Tokens with the range they lie in; ranges meet tokens by block of positions."""
    spans = ranges.where("not taken").withColumn("block", F.explode(F.sequence(F.floor(F.col(begin) / BLOCK), F.floor((F.col(begin) + F.col(size) - 1) / BLOCK))))
    spans = spans.select("recording_id", F.col("block").cast("long").alias("block"), F.col(begin).alias("lo"), (F.col(begin) + F.col(size)).alias("hi"), "a", "b")
    met = tokens.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).join(spans, ["recording_id", "block"]).where("pos >= lo and pos < hi")
    return met.select("recording_id", "a", "b", F.lit(side).alias("side"), "pos", "tok")


def aligned_positions(gold: DataFrame, hyp: DataFrame) -> DataFrame:
    """``recording_id``, ``gold_pos``, ``hyp_pos`` of matched tokens, from rows ``recording_id``, ``pos`` (from 0, without gaps) and ``tok``."""
    kind = gold.schema["recording_id"].dataType.simpleString()
    gold, hyp = cut(gold.select("recording_id", F.col("pos").cast("long").alias("pos"), "tok")), cut(hyp.select("recording_id", F.col("pos").cast("long").alias("pos"), "tok"))
    sizes = cut(gold.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")).join(hyp.groupBy("recording_id").agg(F.count(F.lit(1)).alias("m")), "recording_id"))
    if sizes.where(F.col("n") + F.col("m") > WHOLE).head(1):
        ranges = _ranges(gold, hyp, sizes)
        taken = ranges.where("taken").select("recording_id", F.col("a").alias("gold_pos"), F.col("b").alias("hyp_pos"), F.col("n").alias("size"))
        rows = _placed(gold, ranges, "a", "n", 0).unionByName(_placed(hyp, ranges, "b", "m", 1))
    else:
        taken = None
        whole = lambda t, side: t.join(sizes.select("recording_id"), "recording_id").select("recording_id", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(side).alias("side"), "pos", "tok")
        rows = whole(gold, 0).unionByName(whole(hyp, 1))

    def align(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows["side"] == s].sort_values("pos") for s in (0, 1))
        blocks = blocks_of_codes(*codes(left["tok"].tolist(), right["tok"].tolist()))
        out = pd.DataFrame([(int(key[1]) + a, int(key[2]) + b, n) for a, b, n in blocks], columns=["gold_pos", "hyp_pos", "size"])
        out.insert(0, "recording_id", key[0])
        return out

    found = rows.groupBy("recording_id", "a", "b").applyInPandas(align, f"recording_id {kind}, gold_pos long, hyp_pos long, size long")
    every = found if taken is None else found.unionByName(taken)
    return every.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1))).select("recording_id", (F.col("gold_pos") + F.col("k")).alias("gold_pos"), (F.col("hyp_pos") + F.col("k")).alias("hyp_pos"))
