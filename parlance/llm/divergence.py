"""Divergence of sources by in-mapper stripes.

Each task folds whole documents into stripes: per language and term the number of documents that hold it and its count in every source.  Its memory is bounded: stripes
beyond ``SPILL`` entries are merged, and written out if that does not halve them.  Stripes of one language and term are merged by key.  Terms in enough documents of a language are kept, and each merged stripe gives its
divergences at once: how far every source that uses the term is from its language, and what the term adds to the distance of every two sources.

The share of a term with count ``c`` in a group with ``n`` kept tokens, where the language keeps ``v`` terms, is ``p = 1 + floor(SCALE * (c + 2) / (n + 2 * v))``; two shares differ by
``f(p, q) = floor((p - q)**2 / (p + q))``.  A distance is a sum over all kept terms, most of which neither source uses.  With ``z`` for the share of an absent term,

    sum f(p, q) = v f(z, z') + sum over p's terms [f(p, z') - f(z, z')] + sum over q's terms [f(z, q) - f(z, z')] + sum over common terms [f(p, q) - f(p, z') - f(z, q) + f(z, z')]

so a stripe gives work for the sources it holds only, and the second and third sum take how many terms a source has with each count.  All arithmetic is on whole numbers.

Terms are runs of the letters A to Z in either case and of characters outside ASCII; A to Z are lower-cased.  Null texts, languages and sources are empty; empty and null texts still make their
group occur; repeated rows are documents each; other columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.words import chunks, text_buffers
from parlance.session import cut

LEAST_DOCS = 10
BEST = 10
SCALE = 1_000_000_000
SPILL = 1 << 20  # Stripe entries (language, term, source) a task holds.

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def find_terms(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of some texts, dictionary-encoded, and the row of each."""
    data, offsets = text_buffers(column)
    n = len(data)
    if not n:
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(0, np.int64)
    solid = _LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    ends = np.concatenate([[0], np.cumsum(end - start)])
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_LOWER[data[solid]])))
    return terms.dictionary_encode(), np.searchsorted(offsets, start, side="right") - 1


STRIPES = "lang string, term string, sources array<string>, counts array<long>"


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[edge], np.add.reduceat(c[order], edge) if len(edge) else c


class Stripes:
    """The stripes of one task: counts by (term, language, source), merged when they grow.  Source 0 counts documents."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.sources: dict[str | None, int] = {None: 0}
        self.words: list[pa.Array] = []  # one vocabulary of each part
        self.cells: list[np.ndarray] = []  # its rows of term (in that vocabulary), language, source
        self.counts: list[np.ndarray] = []
        self.size = 0

    def codes(self, column: pa.Array, known: dict) -> np.ndarray:
        names = column.dictionary_encode()
        return np.array([known.setdefault(x, len(known)) for x in names.dictionary.to_pylist()], np.int64)[np.asarray(names.indices)]

    def add(self, batch: pa.RecordBatch) -> None:
        terms, row = find_terms(batch.column("text"))
        if not len(row):
            return
        code, n = np.asarray(terms.indices).astype(np.int64), len(terms.dictionary)
        pairs, times = np.unique(row * n + code, return_counts=True)
        row, code = pairs // n, pairs % n
        lang, source = self.codes(batch.column("lang"), self.langs)[row], self.codes(batch.column("source"), self.sources)[row]
        wide, deep = len(self.sources), len(self.langs)
        at = (code * deep + lang) * wide
        k, c = _summed([at + source, at], [times, np.ones(len(at), np.int64)])
        self.words.append(terms.dictionary)
        self.cells.append(np.stack([k // wide // deep, k // wide % deep, k % wide]))
        self.counts.append(c)
        self.size += len(k)

    def merge(self) -> None:
        if len(self.words) > 1:
            every = pa.chunked_array(self.words).combine_chunks().dictionary_encode()
            code = np.asarray(every.indices).astype(np.int64)
            first = np.cumsum([0, *[len(w) for w in self.words]])
            wide, deep = len(self.sources), len(self.langs)
            k, c = _summed([(code[f + x[0]] * deep + x[1]) * wide + x[2] for f, x in zip(first, self.cells, strict=False)], self.counts)
            self.words, self.cells, self.counts = [every.dictionary], [np.stack([k // wide // deep, k // wide % deep, k % wide])], [c]
        self.size = sum(map(len, self.counts))

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The stripes, one row per language and term; none stay."""
        self.merge()
        if self.counts:
            (words,), ((term, lang, source),), (count,) = self.words, self.cells, self.counts
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]))
            bounds = pa.array(np.append(first, len(term)).astype(np.int32))
            names = pa.array(list(self.sources), pa.string()).take(pa.array(source))
            langs = pa.array(list(self.langs), pa.string()).take(pa.array(lang[first]))
            lists = [pa.ListArray.from_arrays(bounds, v) for v in (names, pa.array(count))]
            out = pa.record_batch([langs, words.take(pa.array(term[first])).cast(pa.string()), *lists], names=["lang", "term", "sources", "counts"])
            self.words, self.cells, self.counts, self.size = [], [], [], 0
            for at in range(0, out.num_rows, 1 << 15):
                yield out.slice(at, 1 << 15)


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Stripes()
    for batch in batches:
        for part in chunks(batch, limit=1 << 22):
            held.add(part)
            if held.size > SPILL:
                held.merge()
                if held.size > SPILL // 2:
                    yield from held.spill()
    yield from held.spill()


def stripes(docs: DataFrame) -> DataFrame:
    """Merged stripes of (lang, source, text) rows: ``lang``, ``term``, ``docs`` and the ``stripe`` of (source, count), one row per language and term."""
    parts = docs.mapInArrow(_stripes, STRIPES)
    # Stripes travel whole; of a term that all tasks know each brings one row.  Counts are then summed by source where they lie.
    cells = parts.repartition("lang", "term").select("lang", "term", F.inline(F.arrays_zip("sources", "counts")).alias("source", "count"))
    whole = cells.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"))
    own = F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "count")))
    return whole.groupBy("lang", "term").agg(F.max(F.when(F.col("source").isNull(), F.col("count"))).alias("docs"), own.alias("stripe"))


def share(count: Column, norm: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / norm)``, exact for any long."""
    return F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), norm.cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """``floor((p - q)**2 / (p + q))``."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


PAIRS = "lang string, source string, item string, value long"


class Pairs:
    """Sums over stripes by pair of sources, merged when they grow."""

    def __init__(self):
        self.known: dict[tuple[str, str], int] = {}
        self.names: list[tuple[str, str]] = []
        self.keys: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.size = 0

    def group(self, lang: str, source: str) -> int:
        at = self.known.setdefault((lang, source), len(self.names))
        if at == len(self.names):
            self.names.append((lang, source))
        return at

    def add(self, group: np.ndarray, p: np.ndarray, z: np.ndarray) -> None:
        """Stripes with the same number of sources: a row each."""
        for i in range(group.shape[1] - 1):
            j = slice(i + 1, None)
            pi, zi = p[:, i : i + 1], z[:, i : i + 1]
            value = _apart(pi, p[:, j]) - _apart(pi, z[:, j]) - _apart(zi, p[:, j]) + _apart(zi, z[:, j])
            low, high = np.minimum(group[:, i : i + 1], group[:, j]), np.maximum(group[:, i : i + 1], group[:, j])
            self.keys.append((low << 32 | high).reshape(-1))
            self.sums.append(value.reshape(-1))
            self.size += value.size
            if self.size > SPILL * 4:
                self.merge()

    def merge(self) -> None:
        if self.keys:
            keys, sums = np.concatenate(self.keys), np.concatenate(self.sums)
            order = np.argsort(keys, kind="stable")
            keys, sums = keys[order], sums[order]
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.sums = [keys[edge]], [np.add.reduceat(sums, edge)]
            self.size = len(edge)

    def spill(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        if self.size:
            keys, sums = self.keys[0], self.sums[0]
            one, two = [self.names[i] for i in (keys >> 32).tolist()], [self.names[i] for i in (keys & 0xFFFFFFFF).tolist()]
            both = [*zip(one, two, strict=True), *zip(two, one, strict=True)]
            columns = [[a[0] for a, _ in both], [a[1] for a, _ in both], [b[1] for _, b in both]]
            yield pa.record_batch([*(pa.array(c, pa.string()) for c in columns), pa.array(np.concatenate([sums, sums]))], names=["lang", "source", "item", "value"])
        self.__init__()


def _common_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources share add to their distance, from stripes of (source, p, z)."""
    held = Pairs()
    for batch in batches:
        stripe = batch.column("stripe")
        size = np.asarray(pa.compute.list_value_length(stripe)).astype(np.int64)
        flat = stripe.flatten()
        p, z = np.asarray(flat.field("p")), np.asarray(flat.field("z"))
        langs = np.repeat(np.arange(batch.num_rows), size)
        names = pa.table({"lang": batch.column("lang").take(pa.array(langs)), "source": flat.field("source")})
        lang, source = names["lang"].combine_chunks().dictionary_encode(), names["source"].combine_chunks().dictionary_encode()
        cells, which = np.unique(np.asarray(lang.indices).astype(np.int64) << 32 | np.asarray(source.indices).astype(np.int64), return_inverse=True)
        of_lang, of_source = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        group = np.array([held.group(of_lang[c >> 32], of_source[c & 0xFFFFFFFF]) for c in cells.tolist()], np.int64)[which] if len(cells) else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        for k in np.unique(size[size > 1]).tolist():
            rows = first[size == k]
            step = max(1, (1 << 18) // k)
            for at in range(0, len(rows), step):
                spot = rows[at : at + step, None] + np.arange(k)
                held.add(group[spot], p[spot], z[spot])
        if held.size > SPILL:
            held.merge()
            if held.size > SPILL // 2:
                yield from held.spill()
    yield from held.spill()


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, best: int = BEST) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``: distances to every other source of the language (``pair``), and the ``best`` terms a source uses most beyond its language (``term``)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.col(text).alias("text"))
    kept = cut(stripes(rows).where(F.col("docs") >= least_docs))
    norms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.aggregate("stripe", F.lit(0).cast("long"), lambda t, s: t + s["count"])).alias("lang_tokens"))
    cells = kept.select("lang", "term", F.inline("stripe"))
    tokens = cells.groupBy("lang", "source").agg(F.sum("count").alias("tokens"))
    groups = rows.select("lang", "source").distinct().join(tokens, ["lang", "source"], "left").join(norms, "lang", "left")
    norm, terms = F.coalesce("tokens", F.lit(0)) + 2 * F.coalesce("terms", F.lit(0)), F.coalesce("terms", F.lit(0))
    groups = cut(groups.select("lang", "source", terms.alias("terms"), norm.alias("norm"), (F.col("lang_tokens") + 2 * terms).alias("lang_norm"), F.when(terms > 0, share(F.lit(0).cast("long"), norm)).alias("z")))

    # Every stripe with the shares of its sources and of its language.
    total = F.aggregate("stripe", F.lit(0).cast("long"), lambda t, s: t + s["count"])
    used = kept.select("lang", "term", total.alias("total"), F.inline("stripe")).join(groups.select("lang", "source", "norm", "lang_norm", "z"), ["lang", "source"])
    used = used.select("lang", "term", "source", "count", share(F.col("count"), F.col("norm")).alias("p"), share(F.col("total"), F.col("lang_norm")).alias("q"), "z")
    beyond = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    by_term = beyond.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)

    other = groups.where("terms > 0").select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    alone = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z")), "lang").where("source <> item")
    base = alone.select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("terms") * apart(F.col("z"), F.col("other_z"))).otherwise(0).alias("value"))
    # Terms of one source against the share of an absent one, by how many have each count.
    steps = used.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("n")).join(other, "lang").where("source <> item")
    lone = steps.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (apart(F.col("p"), F.col("other_z")) - apart(F.col("z"), F.col("other_z")))).alias("value"))
    lone = cut(lone)
    lone = lone.unionByName(lone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    merged = used.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("stripe")).select("lang", "stripe")
    common = merged.mapInArrow(_common_terms, PAIRS)
    pairs = base.unionByName(lone).unionByName(common).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return by_pair.unionByName(by_term)
