"""Greedy run packing: groups whose end depends on where the group began.

Rows of a key are ordered; a group opened at some row absorbs following rows while
``absorb(opening, last, row)`` holds.  Which rows open groups is a chain through the whole key, so a window cannot
express it and one task per key would not scale.  The chain is solved in three Spark steps:

1. *survey* per ``(key, block)``: for each row that could be the block's first opening, where does the chain
   standing at the block's end begin?  Only the rows up to the first forced opening are kept, so a block of many
   rows shrinks to a handful;
2. *walk* per key over those summaries, which tells every block the group that is open when it starts;
3. *settle* per ``(key, block)``: mark the openings given the inherited group.

Each step streams sorted Arrow batches, holding one block at a time.  ``absorb`` must be monotone: a later opening
absorbs at least as far.  All rules here are, because they bound a span measured from the opening row.  The one
exception, rows that never absorb when they open a group although an earlier group would run past them, is named
by ``empty``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.operators.ordered import Timeline

Absorb = Callable[[tuple, tuple, tuple], bool]
ROWS_PER_SURVEY = 65_536
ROWS_PER_BATCH = 20_000


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal leading key columns, of batches sorted by them."""
    current, rows = None, []
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns]):
            if r[:n_keys] != current:
                if rows:
                    yield current, rows
                current, rows = r[:n_keys], []
            rows.append(r[n_keys:])
    if rows:
        yield current, rows


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    buffer: list[tuple] = []
    for r in rows:
        buffer.append(r)
        if len(buffer) >= ROWS_PER_BATCH:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _next_openings(rows: list[tuple], absorb: Absorb) -> list[int]:
    """For each row, the first later row its group does not absorb (``len(rows)`` if none in this block)."""
    n, reach, out = len(rows), 1, []
    for i in range(n):
        if i + 1 < n and not absorb(rows[i], rows[i], rows[i + 1]):
            out.append(i + 1)
            continue
        reach = max(reach, i + 1)
        while reach < n and absorb(rows[i], rows[reach - 1], rows[reach]):
            reach += 1
        out.append(reach)
    return out


def greedy_groups(
    df: DataFrame, tl: Timeline, cols: Sequence[str], absorb: Absorb, name: str = "group", empty: Callable[[tuple], bool] | None = None
) -> DataFrame:
    """Attach ``name``: the order value of the row that opened each row's group.

    ``tl`` must order by one integer column; ``absorb`` sees tuples of ``cols``.
    """
    keys, (pos,) = list(tl.keys), tl.order
    kinds = dict(df.dtypes)
    k, w = len(keys), 1 + len(cols)
    # Every row travels as (position, *cols); f0 is the position.
    narrow = tl.blocked(df.select(*keys, pos, *[c for c in cols if c != pos]))
    narrow = narrow.select(*keys, "_block", narrow[pos].alias("f0"), *[narrow[c].alias(f"f{i}") for i, c in enumerate(cols, 1)])
    types = [kinds[pos], *[kinds[c] for c in cols]]
    ddl_key = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    ddl_rows = lambda *ps: ", ".join(f"{p}{i} {t}" for p in ps for i, t in enumerate(types))
    joins = lambda o, l, r: absorb(o[1:], l[1:], r[1:])
    block_keys = [*keys, "_block"]
    sorted_rows = narrow.repartition(*block_keys).sortWithinPartitions(*block_keys, "f0")
    arrow = _arrow_schema(narrow)

    def survey(batches):
        def rows_out():
            for key, rows in _runs(batches, k + 1):
                nxt = _next_openings(rows, joins)
                final = list(range(len(rows)))
                for i in range(len(rows) - 1, -1, -1):
                    if nxt[i] < len(rows):
                        final[i] = final[nxt[i]]
                sure = 0
                while empty and sure < len(rows) - 1 and empty(rows[sure][1:]):
                    sure += 1
                for i in range(min(nxt[sure] + 1, len(rows))):
                    yield (*key, i, *rows[i], *rows[final[i]], *rows[-1])

        yield from _emit(rows_out(), survey_schema)

    def fields(prefix):
        return [pa.field(f"{prefix}{i}", arrow.field(f"f{i}").type) for i in range(w)]

    key_fields = [arrow.field(c) for c in block_keys]
    survey_schema = pa.schema([*key_fields, pa.field("at", pa.int64()), *fields("f"), *fields("e"), *fields("l")])
    heads = sorted_rows.mapInArrow(survey, f"{ddl_key}, _block bigint, at bigint, {ddl_rows('f', 'e', 'l')}")

    def walk(batches):
        def rows_out():
            for key, rows in _runs(batches, k):
                opened = last = None
                i = 0
                while i < len(rows):
                    block = rows[i][0]
                    yield (*key, block, *(opened or (None,) * w), *(last or (None,) * w))
                    prev, closed = last, opened is None
                    # Rows of one block: (block, at, row, chain at the block's end, last row).
                    while i < len(rows) and rows[i][0] == block:
                        row, end, tail = rows[i][2 : 2 + w], rows[i][2 + w : 2 + 2 * w], rows[i][2 + 2 * w :]
                        if not closed and not joins(opened, prev, row):
                            closed, opened = True, end
                        elif opened is None:
                            closed, opened = True, end
                        prev = row
                        i += 1
                    last = tail

        yield from _emit(rows_out(), walk_schema)

    walk_schema = pa.schema([*key_fields, *fields("o"), *fields("p")])
    chained = heads.repartition(*keys).sortWithinPartitions(*keys, "_block", "at")
    inherited = chained.mapInArrow(walk, f"{ddl_key}, _block bigint, {ddl_rows('o', 'p')}")

    def settle(batches):
        def rows_out():
            for key, rows in _runs(batches, k + 1):
                opened, prev = (rows[0][w : 2 * w], rows[0][2 * w :]) if rows[0][w] is not None else (None, None)
                own = [r[:w] for r in rows]
                nxt = _next_openings(own, joins)
                at = 0
                while opened is not None and at < len(own) and joins(opened, prev, own[at]):
                    yield (*key[:-1], own[at][0], opened[0])
                    prev, at = own[at], at + 1
                while at < len(own):
                    for i in range(at, nxt[at]):
                        yield (*key[:-1], own[i][0], own[at][0])
                    at = nxt[at]

        yield from _emit(rows_out(), settle_schema)

    settle_schema = pa.schema([*key_fields[:-1], pa.field(pos, arrow.field("f0").type), pa.field(name, arrow.field("f0").type)])
    carried = narrow.join(inherited, block_keys, "left").repartition(*block_keys).sortWithinPartitions(*block_keys, "f0")
    ids = carried.mapInArrow(settle, f"{ddl_key}, `{pos}` {kinds[pos]}, `{name}` {kinds[pos]}")
    return df.join(ids, [*keys, pos], "inner")


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def surveyed(keys: Sequence[str] = ("meeting_id",), order: str = "ord", rows: int = ROWS_PER_SURVEY) -> Timeline:
    return Timeline(tuple(keys), (order,), rows)
