"""Ordered-sequence primitives that never put a whole key into one task.

A window partitioned by ``meeting_id`` alone hands a meeting to a single task; when one meeting holds a
third of the table that task is the job.  Each primitive here works on two levels instead:

1. rows are split into *blocks*, a monotone bucket of the order column, and the window runs per
   ``(keys, block)``;
2. one summary row per block (partial aggregation does this map-side) is ordered per key, which
   yields what each block inherits from the blocks before or after it, and is joined back on
   ``(keys, block)``.

The only per-key ordered work is over block summaries, smaller than the rows by the block size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 4096
BLOCK_MS = 600_000


@dataclass(frozen=True)
class Timeline:
    """How rows are ordered: ``keys``, the total order ``order`` and a bucket monotone in that order."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: int

    @property
    def position(self) -> Column:
        return F.struct(*self.order) if len(self.order) > 1 else F.col(self.order[0])

    def blocked(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_block", F.floor(F.col(self.order[0]) / F.lit(self.width)))

    @property
    def block_keys(self) -> list[str]:
        return [*self.keys, "_block"]

    def inside(self):
        return Window.partitionBy(*self.block_keys).orderBy(*self.order)

    def across(self):
        return Window.partitionBy(*self.keys).orderBy("_block")

    def inside_reversed(self):
        return Window.partitionBy(*self.block_keys).orderBy(*[F.desc(c) for c in self.order])

    def across_reversed(self):
        return Window.partitionBy(*self.keys).orderBy(F.desc("_block"))

    def inherit(self, df: DataFrame, summary: Sequence[Column], carried: Sequence[Column]) -> DataFrame:
        """Join what each block inherits: ``summary`` per block, ``carried`` over the ordered summaries."""
        blocks = df.groupBy(*self.block_keys).agg(*summary).select(*self.block_keys, *carried)
        return df.join(blocks, self.block_keys, "inner")


def by_position(keys: Sequence[str] = ("meeting_id",), order: str = "ord", rows: int = ROWS_PER_BLOCK) -> Timeline:
    return Timeline(tuple(keys), (order,), rows)


def by_time(keys: Sequence[str] = ("meeting_id",), order: Sequence[str] = ("start_ms", "d_ord"), width_ms: int = BLOCK_MS) -> Timeline:
    return Timeline(tuple(keys), tuple(order), width_ms)


def running_totals(df: DataFrame, tl: Timeline, totals: dict[str, Column]) -> DataFrame:
    """Inclusive running sums in timeline order."""
    names = list(totals)
    b = tl.blocked(df.withColumns({f"_v_{n}": c for n, c in totals.items()}))
    before = tl.across().rowsBetween(Window.unboundedPreceding, -1)
    joined = tl.inherit(
        b,
        [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names],
        [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in names],
    )
    upto = tl.inside().rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({n: F.col(f"_base_{n}") + F.sum(f"_v_{n}").over(upto) for n in names})
    return out.drop("_block", *[f"_v_{n}" for n in names], *[f"_base_{n}" for n in names])


def dense_index(df: DataFrame, tl: Timeline, name: str = "idx", start: int = 0) -> DataFrame:
    """row_number over the timeline, beginning at ``start``."""
    return running_totals(df, tl, {name: F.lit(1)}).withColumn(name, F.col(name) - 1 + F.lit(start))


def neighbours(df: DataFrame, tl: Timeline, cols: Sequence[str], prev: str | None = "prev", following: str | None = None) -> DataFrame:
    """Attach the adjacent row's ``cols`` as a struct (``lag``/``lead`` by one), null at the ends."""
    b = tl.blocked(df)
    row, pos = F.struct(*cols), tl.position
    summary, carried = [], []
    if prev:
        summary.append(F.max_by(row, pos).alias("_last"))
        carried.append(F.lag("_last").over(tl.across()).alias("_before"))
    if following:
        summary.append(F.min_by(row, pos).alias("_first"))
        carried.append(F.lead("_first").over(tl.across()).alias("_after"))
    out = tl.inherit(b, summary, carried)
    if prev:
        out = out.withColumn(prev, F.coalesce(F.lag(row).over(tl.inside()), F.col("_before")))
    if following:
        out = out.withColumn(following, F.coalesce(F.lead(row).over(tl.inside()), F.col("_after")))
    return out.drop("_block", "_before", "_after")


def fill(df: DataFrame, tl: Timeline, forward: dict[str, Column] | None = None, backward: dict[str, Column] | None = None) -> DataFrame:
    """Nearest non-null value at or before (``forward``) and at or after (``backward``) each row.

    Backward values run over the reversed order: a frame that ends at the last row is recomputed for every row, one
    that begins at the first row only grows.
    """
    forward, backward = forward or {}, backward or {}
    b = tl.blocked(df.withColumns({f"_v_{n}": c for n, c in {**forward, **backward}.items()}))
    pos = tl.position
    before = tl.across().rowsBetween(Window.unboundedPreceding, -1)
    after = tl.across_reversed().rowsBetween(Window.unboundedPreceding, -1)
    present = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), pos)
    summary = [F.max_by(f"_v_{n}", present(n)).alias(f"_s_{n}") for n in forward]
    summary += [F.min_by(f"_v_{n}", present(n)).alias(f"_s_{n}") for n in backward]
    carried = [F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in forward]
    carried += [F.last(f"_s_{n}", ignorenulls=True).over(after).alias(f"_c_{n}") for n in backward]
    out = tl.inherit(b, summary, carried)
    upto = tl.inside().rowsBetween(Window.unboundedPreceding, 0)
    onward = tl.inside_reversed().rowsBetween(Window.unboundedPreceding, 0)
    cols = {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(upto), F.col(f"_c_{n}")) for n in forward}
    cols |= {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(onward), F.col(f"_c_{n}")) for n in backward}
    out = out.withColumns(cols)
    names = [*forward, *backward]
    return out.drop("_block", *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


Lookup = Callable[[str], Column]


def islands(
    df: DataFrame,
    tl: Timeline,
    cols: Sequence[str],
    starts: Callable[[Lookup, Lookup], Column],
    name: str = "island",
    prev: str | None = None,
    opening: str | None = None,
    following: str | None = None,
) -> DataFrame:
    """Gaps-and-islands: ``name`` is the position of the row that opened the island.

    ``prev``, ``following`` and ``opening`` optionally keep the ``cols`` of the row before, of the row after and of
    the island's first row.

    ``starts(prev, cur)`` decides from two adjacent rows whether the second opens an island.  Inside a
    block it is a ``lag``; for a block's first row it is decided on the block summaries, so flags and
    ids cost one summary and one join together.
    """
    b = tl.blocked(df)
    row, pos = F.struct(*cols), tl.position
    head = F.struct(pos.alias("pos"), row.alias("row"))
    cur = lambda c: F.col(c)
    b = b.withColumn("_prev", F.lag(row).over(tl.inside()))
    if following:
        b = b.withColumn("_next", F.lead(row).over(tl.inside()))
    b = b.withColumn("_opens", F.when(F.col("_prev").isNotNull(), starts(lambda c: F.col(f"_prev.{c}"), cur)))
    b = b.withColumn("_own", F.last(F.when(F.col("_opens"), head), ignorenulls=True).over(tl.inside().rowsBetween(Window.unboundedPreceding, 0)))
    ordered = tl.across()
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        b.groupBy(*tl.block_keys)
        .agg(
            F.min_by(row, pos).alias("_first"),
            F.max_by(row, pos).alias("_last"),
            F.min_by(head, pos).alias("_first_head"),
            F.max_by(head, F.when(F.col("_opens"), pos)).alias("_last_open"),
        )
        .withColumn("_before", F.lag("_last").over(ordered))
        .withColumn(
            "_first_opens",
            F.when(F.col("_before").isNull(), F.lit(True)).otherwise(
                F.coalesce(starts(lambda c: F.col(f"_before.{c}"), lambda c: F.col(f"_first.{c}")), F.lit(False))
            ),
        )
        .withColumn("_head", F.when(F.col("_first_opens"), F.col("_first_head")))
        .withColumn("_carry", F.last(F.coalesce("_last_open", "_head"), ignorenulls=True).over(before))
        .withColumn("_after", F.lead("_first").over(ordered) if following else F.lit(None))
        .select(*tl.block_keys, "_before", "_after", F.coalesce("_head", "_carry").alias("_inherited"))
    )
    out = b.join(blocks, tl.block_keys, "inner").withColumn("_own", F.coalesce("_own", "_inherited"))
    out = out.withColumn(name, F.col("_own.pos"))
    if opening:
        out = out.withColumn(opening, F.col("_own.row"))
    if prev:
        out = out.withColumn(prev, F.coalesce("_prev", "_before"))
    if following:
        out = out.withColumn(following, F.coalesce("_next", "_after"))
    return out.drop("_block", "_prev", "_next", "_opens", "_own", "_before", "_after", "_inherited")


def joined_text(text: Column, *order: str, sep: str = " ") -> Column:
    """``sep``-joined text of a group in order (the group's result is this one string)."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return F.array_join(F.transform(ordered, lambda s: s["_t"]), sep)


def affine_in_blocks(df: DataFrame, keys: Sequence[str], order: str, keep: Column, add: Column, parts: dict[str, Column], whole: dict[str, Column]) -> DataFrame:
    """Fold ``c <- keep * c + add`` over each group in order, without collecting a group.

    Affine steps compose, so rows compose inside ``(keys, block)`` and block results compose per group.  ``parts``
    are further block aggregates, ``whole`` combines them (they may read ``_block`` for order).
    """
    step = lambda acc, x: F.struct((acc["a"] * x["a"]).alias("a"), (acc["b"] * x["a"] + x["b"]).alias("b"))
    unit = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), keep.alias("a"), add.alias("b"))))
    blocks = (
        df.withColumn("_block", F.floor(F.col(order) / ROWS_PER_BLOCK))
        .groupBy(*keys, "_block")
        .agg(F.aggregate(rows, unit, step).alias("_ab"), *[c.alias(n) for n, c in parts.items()])
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_ab"))), lambda x: x["_ab"])
    return blocks.groupBy(*keys).agg(F.aggregate(ordered, unit, step)["b"].alias("folded"), *[c.alias(n) for n, c in whole.items()])
