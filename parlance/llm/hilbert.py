"""Shards along a Hilbert curve over metadata, with SQL functions only.

Each dimension is cut at its own quantiles into ``2**bits`` steps, documents are ordered by the curve index of their cell, and the order is
cut into runs.  Near cells share a shard, so a file's minima and maxima prune on every dimension at once.

Defined results: nulls of a dimension take the lowest step, null texts count as empty, equal ids follow each other in any order (their
rows differ in nothing that decides), an empty table gives an empty table, and other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import cut

BLOCKS = 4096  # Rows are ranked in about this many blocks, at most twice as many, so no block holds more than 1/4096 of all rows.


def curve_index(axes: list[str], bits: int) -> Column:
    """Index of a cell on the Hilbert curve.

    Bits are visited from the top; per axis the lower bits of the first axis are flipped, or swapped with that axis.  A Gray code over the
    axes then orders the corners, and the bits of all axes are dealt out in turn.  Folds bind each state once, so the expression stays small.
    """
    n, tops = len(axes), [1 << b for b in range(bits - 1, 0, -1)]
    if not tops:
        tops = [1]
    ints = ", ".join(f"CAST({a} AS INT)" for a in axes)
    steps = ", ".join(f"named_struct('top', {t}, 'i', {i})" for t in tops for i in range(n))
    turned = f"""aggregate(array({steps}), array({ints}), (a, s) -> transform(a, (v, k) -> CASE
        WHEN (a[s.i] & s.top) != 0 THEN IF(k = 0, v ^ (s.top - 1), v)
        WHEN k = 0 OR k = s.i THEN v ^ ((a[0] ^ a[s.i]) & (s.top - 1)) ELSE v END))"""
    gray = f"aggregate(slice(sequence(0, {n - 1}), 2, {n}), {turned}, (a, i) -> transform(a, (v, k) -> IF(k = i, v ^ a[i - 1], v)))"
    masked = f"""aggregate(array({", ".join(map(str, tops))}), named_struct('g', {gray}, 'm', 0), (t, top) ->
        named_struct('g', t.g, 'm', IF((t.g[{n - 1}] & top) != 0, t.m ^ (top - 1), t.m)), t -> transform(t.g, v -> v ^ t.m))"""
    order = ", ".join(f"named_struct('b', {b}, 'i', {i})" for b in range(bits - 1, -1, -1) for i in range(n))
    return F.expr(f"""aggregate(array({order}), named_struct('x', CAST(0 AS BIGINT), 'g', {masked}),
        (t, s) -> named_struct('x', t.x * 2 + (shiftright(t.g[s.i], s.b) & 1), 'g', t.g), t -> t.x)""")


def string_cuts(df: DataFrame, value: Column, parts: int) -> list[str]:
    """Values that cut the rows, in the order of whole values (UTF-8), into ``parts`` runs of about one size; at most ``parts - 1`` strings."""
    kinds = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    # Running counts over values in order: within ranges of values, and over the ranges.
    kinds = cut(kinds.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    ranges = kinds.groupBy("p").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("p", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v")) + F.col("before")
    step = F.expr(f"((upto - 1) * {parts}L) div total")
    last = kinds.join(ranges, "p").withColumn("upto", upto).groupBy(step.alias("step")).agg(F.max("v").alias("v")).where(F.col("step") < parts - 1)
    return sorted((r["v"] for r in last.collect()), key=lambda v: v.encode("utf-8"))


def quantile_steps(df: DataFrame, dims: Mapping[str, Column], bits: int) -> dict[str, Column]:
    """The step of each dimension, from its quantiles over all rows (at most ``2**bits - 1`` values each reach the driver)."""
    parts = 1 << bits
    words = {f.name for f in df.select(*[c.alias(n) for n, c in dims.items()]).schema if f.dataType.typeName() == "string"}
    asked = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    numbers = [F.percentile_approx(c, asked, F.lit(10_000)).alias(n) for n, c in dims.items() if n not in words]
    row = df.agg(*numbers).first() if numbers else {}
    steps = {}
    for n, c in dims.items():
        cuts = string_cuts(df, c, parts) if n in words else row[n] or []
        steps[n] = F.coalesce(sum(((c > v).cast("int") for v in cuts), F.lit(0)), F.lit(0))
    return steps


def hilbert_shards(
    df: DataFrame, ids: str, dims: Mapping[str, Column], shards: int = 8, bits: int = 4, carry: Mapping[str, Column] | None = None, near: Column | None = None
) -> DataFrame:
    """``ids``, the carried columns, ``cell`` (curve index), ``shard`` and ``slot``: shards whose row counts differ by one at most, slots gapless from 0.

    Within a cell, rows with equal ``near`` lie in one run of about 1/BLOCKS of all rows, or of their own number where that is more; a shard's end may fall into it.
    """
    steps = quantile_steps(df, dims, bits)
    tie = F.xxhash64(near if near is not None else F.col(ids))
    carried = [f"c_{n}" for n in carry or {}]
    axes = [f"d{i}" for i in range(len(steps))]
    rows = cut(df.select(F.col(ids).alias("id"), tie.alias("tie"), *[s.alias(a) for a, s in zip(axes, steps.values(), strict=True)], *[c.alias(f"c_{n}") for n, c in (carry or {}).items()]))
    counts = rows.groupBy(*axes).agg(F.count(F.lit(1)).alias("cell_rows"))
    by_cell = counts.withColumn("cell", curve_index(axes, bits))
    # At most 2**(bits * dimensions) rows: one window orders them.
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    cells = by_cell.select(
        *axes,
        "cell",
        (F.sum("cell_rows").over(upto) - F.col("cell_rows")).alias("cell_from"),
        F.sum("cell_rows").over(every).alias("total"),
        F.ceil(F.col("cell_rows") * BLOCKS / F.sum("cell_rows").over(every)).alias("parts"),
    )
    # Parts of a cell are ranges of ties; one that holds much more than its share, as of a text with many copies, is split by id.
    part = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * F.col("parts")), F.col("parts") - 1)
    placed = rows.join(F.broadcast(cells), axes).withColumn("part", part)
    sizes = placed.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) * BLOCKS / F.max("total") / 2).alias("splits"))
    placed = placed.join(F.broadcast(sizes), ["cell", "part"]).withColumn("split", F.pmod(F.xxhash64("id", F.lit(7)), F.col("splits")))
    blocks = placed.groupBy("cell", "part", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cell").orderBy("part", "split").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select("cell", "part", "split", (F.sum("n").over(before) - F.col("n")).alias("block_from"))
    ranked = placed.withColumn("at", F.row_number().over(Window.partitionBy("cell", "part", "split").orderBy("tie", "id", *carried)) - 1)
    rank = (F.col("cell_from") + F.col("block_from") + F.col("at")).cast("long")
    ranked = ranked.join(F.broadcast(blocks), ["cell", "part", "split"]).withColumn("rank", rank)
    shard = F.expr(f"(rank * {shards}L) div total")
    ranked = ranked.withColumn("shard", shard)
    start = F.expr(f"(shard * total + {shards - 1}L) div {shards}L")
    return ranked.select(
        F.col("id").alias(ids), *[F.col(f"c_{n}").alias(n) for n in carry or {}], "cell", F.col("shard").cast("int").alias("shard"), (F.col("rank") - start).cast("long").alias("slot")
    )


def write_shards(df: DataFrame, placed: DataFrame, ids: str, path: str) -> None:
    """The rows of ``df`` in one folder per shard, ordered by slot within each file."""
    keyed = df.join(placed.select(ids, "shard", "slot"), ids)
    keyed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
