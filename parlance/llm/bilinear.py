"""Log-bilinear language model over a growing vocabulary, trained by noise-contrastive estimation in numpy.

The commonest ``ROOTS * sqrt(distinct words)`` words have an input and an output vector each, so the model grows with what is counted, while what every task holds grows with the
root of it.  Words lie in classes of neighbours by frequency; other words fall into ``RARE`` classes by their last two bytes, and the end of a text is a class.  A context's vector is the sum of the
vectors of the two words before, each turned by the matrix of its place; its products with the vectors of the classes, plus biases, are their scores, and likewise for the words of one class.
Every training token is learnt from: tasks go over their texts from the same beginning, telling each class from drawn ones and each word from drawn ones of its class, and
send back what they learnt; a row is the mean of the tasks' rows, weighted by how often each met it.  Batched matrix products give normalised log-probabilities, of
the class among all and of the word among those of its class.  A rare word has its share of its class, smoothed by half a count with one place for unknown words, so a text's
probability is normalised over all words.

Defined results: a null or empty text is its end alone; without training texts classes are equally likely; repeated rows are scored once each; an empty table
gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.words import VALUES, Words, chunks, commonest, find_words
from parlance.session import cut

ROOTS = 4  # Words with vectors, by the root of all distinct words.
RARE = 24
HELD = 1 << 18  # Bound of the words whose counts every task holds; the counts of others are joined.
DIM, BATCH, NOISE, OWN, RATE = 16, 4096, 24, 3, 0.1
ROWS = 1024  # Parameter rows that travel as one.


def suffix_class(w: Words) -> np.ndarray:
    last = VALUES[w.data[w.end - 1]] if len(w.end) else np.zeros(0, np.uint64)
    before = np.where(w.end - w.start > 1, VALUES[w.data[w.end - 2]] if len(w.end) else last, np.uint64(0))
    return ((last * np.uint64(3) + before) >> np.uint64(33)).astype(np.int64) % RARE


def _sums(keys: list[np.ndarray], *values: list[np.ndarray]):
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    kinds, first, which = np.unique(k, return_index=True, return_inverse=True)
    return kinds, first, [np.bincount(which, weights=np.concatenate(v), minlength=len(kinds)).astype(np.int64) if len(k) else np.zeros(0, np.int64) for v in values]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, kinds, counts = [], [], []
        for part in chunks(batch):
            w = find_words(part.column("text"))
            h, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            words.append(h)
            kinds.append(suffix_class(w)[first])
            counts.append(n)
        h, first, (n,) = _sums(words, counts)
        kind = np.concatenate(kinds)[first] if kinds else np.zeros(0, np.int64)
        yield pa.record_batch({"word": pa.array(h.view(np.int64)), "kind": pa.array(kind.astype(np.int32)), "n": pa.array(n)})


@dataclass
class Shape:
    """Words with vectors, ordered by frequency, and how they and all else are numbered: words, rare classes, the end; in contexts the start takes the end's place."""

    words: np.ndarray  # hashes, by rank
    order: np.ndarray  # ranks by hash
    size: int  # words of a class

    @classmethod
    def of(cls, words: np.ndarray) -> Shape:
        return cls(words, np.argsort(words), max(1, math.isqrt(len(words))))

    @property
    def n(self) -> int:
        return len(self.words)

    @property
    def word_classes(self) -> int:
        return -(-self.n // self.size)

    @property
    def classes(self) -> int:
        return self.word_classes + RARE + 1

    @property
    def end(self) -> int:
        return self.n + RARE

    # Rows of the parameters: context vectors, class vectors, word vectors (with a bias behind each), the matrices of the two places.
    @property
    def starts(self) -> tuple[int, int, int, int, int]:
        q = self.end + 1
        return q, q + self.classes, q + self.classes + self.n, q + self.classes + self.n + DIM, q + self.classes + self.n + 2 * DIM

    def class_of(self, token: np.ndarray) -> np.ndarray:
        return np.where(token < self.n, token // self.size, self.word_classes + token - self.n)

    def tokens(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Number of every token, ends included, and the index of each row's first token (one more entry at the end)."""
        kind = self.n + suffix_class(w)
        if self.n:
            spot = self.order[np.minimum(np.searchsorted(self.words, w.hash, sorter=self.order), self.n - 1)]
            kind = np.where(self.words[spot] == w.hash, spot, kind)
        return np.insert(kind, w.first[1:], self.end), w.first + np.arange(len(w.first))


def contexts(token: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two before each."""
    one, two = np.full(len(token), start), np.full(len(token), start)
    one[1:], two[2:] = token[:-1], token[:-2]
    first = bounds[:-1][np.diff(bounds) > 0]
    one[first], two[first] = start, start
    two[bounds[:-1][np.diff(bounds) > 1] + 1] = start
    return one, two


def beginning(shape: Shape, counts: np.ndarray) -> np.ndarray:
    """Parameters before training: small vectors, places that keep them, biases of the counted frequencies (words, rare classes, the end)."""
    rng = np.random.default_rng(5)
    q, r, w, p, last = shape.starts
    x = np.zeros((last, DIM + 1), np.float32)
    x[:w, :DIM] = rng.normal(0, 0.1, (w, DIM))
    x[w:p, :DIM], x[p:last, :DIM] = np.eye(DIM), 0.5 * np.eye(DIM)
    by_class = np.bincount(shape.class_of(np.arange(shape.end + 1)), weights=counts + 0.5, minlength=shape.classes)
    x[q:r, DIM] = np.log(by_class / by_class.sum())
    x[r:w, DIM] = np.log((counts[: shape.n] + 0.5) / by_class[shape.class_of(np.arange(shape.n))])
    return x


def _grouped(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places, the sums of their rows and how often each occurs."""
    kinds, which, times = np.unique(at, return_inverse=True, return_counts=True)
    columns = np.ascontiguousarray(rows.T, np.float64)
    return kinds, np.stack([np.bincount(which, weights=c, minlength=len(kinds)) for c in columns], axis=1).astype(np.float32), times


class Learner:
    """One task's training."""

    def __init__(self, shape: Shape, x: np.ndarray, counts: np.ndarray, seed: int):
        self.shape, self.x, self.memory = shape, x.copy(), np.ones((len(x), DIM + 1), np.float32)
        self.met = np.zeros(len(x))
        self.rng = np.random.default_rng(seed)
        by_class = np.bincount(shape.class_of(np.arange(shape.end + 1)), weights=counts + 0.5, minlength=shape.classes)
        self.log_class = np.log(NOISE * by_class / by_class.sum()).astype(np.float32)
        self.class_upto = np.cumsum(by_class / by_class.sum())
        self.log_word = np.log(OWN * (counts[: shape.n] + 0.5) / by_class[shape.class_of(np.arange(shape.n))]).astype(np.float32)
        self.word_upto = np.concatenate([[0.0], np.cumsum(counts[: shape.n] + 0.5)])

    def step(self, at: np.ndarray, grad: np.ndarray, times: np.ndarray | int = 1) -> None:
        self.memory[at] += grad * grad
        self.x[at] += RATE * grad / np.sqrt(self.memory[at])
        self.met[at] += times

    def learn(self, one: np.ndarray, two: np.ndarray, token: np.ndarray) -> None:
        s, x = self.shape, self.x
        q, r, w, p, last = s.starts
        near, far = x[w:p, :DIM], x[p:last, :DIM]
        rows = lambda at: np.take(x, at, axis=0)
        q1, q2 = rows(one)[:, :DIM], rows(two)[:, :DIM]
        h = q1 @ near + q2 @ far
        with_one = np.column_stack([h, np.ones(len(h), np.float32)])
        own = s.class_of(token)
        # Classes: each from NOISE drawn ones that the batch shares.
        drawn = np.minimum(np.searchsorted(self.class_upto, self.rng.random(NOISE)), s.classes - 1)
        mine, theirs = rows(q + own), rows(q + drawn)
        true = np.einsum("bd,bd->b", with_one, mine) - self.log_class[own]
        false = with_one @ theirs.T - self.log_class[drawn]
        g, gf = 1 / (1 + np.exp(true)), -1 / (1 + np.exp(-false))
        gh = g[:, None] * mine[:, :DIM] + gf @ theirs[:, :DIM]
        steps = [(np.concatenate([q + own, q + drawn]), np.concatenate([g[:, None] * with_one, gf.T @ with_one]))]
        # Words: each from OWN drawn ones of its class.
        at = np.flatnonzero(token < s.n)
        if len(at):
            t, low = token[at], own[at] * s.size
            begin, finish = self.word_upto[low], self.word_upto[np.minimum(low + s.size, s.n)]
            others = np.searchsorted(self.word_upto, begin[:, None] + self.rng.random((len(at), OWN)) * (finish - begin)[:, None], side="right") - 1
            others = np.minimum(others, s.n - 1)
            context, mine, theirs = np.take(with_one, at, axis=0), rows(r + t), rows(r + others)
            g = 1 / (1 + np.exp(np.einsum("bd,bd->b", context, mine) - self.log_word[t]))
            gf = -1 / (1 + np.exp(-(np.einsum("bd,bkd->bk", context, theirs) - self.log_word[others])))
            gh[at] += g[:, None] * mine[:, :DIM] + np.einsum("bk,bkd->bd", gf, theirs[:, :, :DIM])
            steps.append((np.concatenate([r + t, (r + others).reshape(-1)]), np.concatenate([g[:, None] * context, (gf[:, :, None] * context[:, None, :]).reshape(-1, DIM + 1)])))
        context = np.concatenate([gh @ near.T, gh @ far.T])
        steps.append((np.concatenate([one, two]), np.column_stack([context, np.zeros(len(context), np.float32)])))
        places = np.zeros((2 * DIM, DIM + 1))
        places[:, :DIM] = np.concatenate([q1.T @ gh, q2.T @ gh])
        self.step(*_grouped(np.concatenate([to for to, _ in steps]), np.concatenate([grads for _, grads in steps])))
        self.step(np.arange(w, last), places, len(token))


PARTS = "block long, rows binary, met binary"


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, x, counts = shared.value
        learner = Learner(shape, x, counts, TaskContext.get().partitionId())
        for batch in batches:
            for part in chunks(batch):
                token, bounds = shape.tokens(find_words(part.column("text")))
                one, two = contexts(token, bounds, shape.end)
                mixed = learner.rng.permutation(len(token))
                for at in range(0, len(token), BATCH):
                    pick = mixed[at : at + BATCH]
                    learner.learn(one[pick], two[pick], token[pick])
        for block in range(0, len(x), ROWS):
            met = learner.met[block : block + ROWS]
            if met.any():
                rows = (learner.x[block : block + ROWS] - x[block : block + ROWS]) * met[:, None]
                yield pa.record_batch({"block": pa.array([block]), "rows": pa.array([rows.tobytes()], pa.binary()), "met": pa.array([met.tobytes()], pa.binary())})

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts of each block of rows."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = [np.frombuffer(x) for x in parts]
            held[block] = [a + b for a, b in zip(held[block], own, strict=True)] if block in held else own
    for block, (rows, met) in held.items():
        yield pa.record_batch({"block": pa.array([block]), "rows": pa.array([rows.tobytes()], pa.binary()), "met": pa.array([met.tobytes()], pa.binary())})


def train(texts: DataFrame, shape: Shape, counts: np.ndarray) -> np.ndarray:
    """Parameters after one pass over all texts."""
    x = beginning(shape, counts)
    shared = texts.sparkSession.sparkContext.broadcast((shape, x, counts))  # grows with the root of the distinct words
    sums = texts.mapInArrow(_train(shared), PARTS).repartition("block").mapInArrow(_add_up, PARTS)
    for r in sums.toLocalIterator():
        met = np.frombuffer(r["met"])
        x[r["block"] : r["block"] + ROWS] += np.frombuffer(r["rows"]).reshape(len(met), DIM + 1) / np.maximum(met, 1)[:, None]
    shared.destroy()
    return x


def log_probabilities(shape: Shape, x: np.ndarray, one: np.ndarray, two: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Log10 probability of each token after its context; of a rare one, that of its class."""
    q, r, w, p, last = shape.starts
    out = np.zeros(len(token))
    if not len(token):
        return out
    h = np.take(x, one, axis=0)[:, :DIM] @ x[w:p, :DIM] + np.take(x, two, axis=0)[:, :DIM] @ x[p:last, :DIM]
    own = shape.class_of(token)

    def chosen(h: np.ndarray, rows: np.ndarray, pick: np.ndarray) -> np.ndarray:
        z = h @ rows[:, :DIM].T
        z += rows[:, DIM]
        # One shift for all rows, unless some lie too far from it for their exponentials.
        top = z.max(axis=1, keepdims=True) if z.max() - z.min() > 60 else z.max()
        z -= top
        own = z[np.arange(len(z)), pick]
        return own - np.log(np.exp(z, out=z).sum(axis=1))

    for at in range(0, len(token), BATCH):
        s = slice(at, at + BATCH)
        out[s] = chosen(h[s], x[q:r], own[s])
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(shape.word_classes + 1))
    for c in range(shape.word_classes):
        low = c * shape.size
        rows = x[r + low : r + min(low + shape.size, shape.n)]
        for at in range(edges[c], edges[c + 1], BATCH):
            pick = order[at : min(at + BATCH, edges[c + 1])]
            out[pick] += chosen(h[pick], rows, token[pick] - low)
    return out / math.log(10)


@dataclass
class LanguageModel:
    tokens: int  # training tokens, ends included
    kinds: int  # distinct ones
    ends: int
    shape: Shape
    params: np.ndarray
    class_tokens: np.ndarray  # tokens and distinct words of each rare class
    class_kinds: np.ndarray
    held: np.ndarray  # words whose counts all tasks hold, sorted, and these
    held_counts: np.ndarray
    counts: DataFrame  # word, n of all others

    @property
    def norm(self) -> float:
        return self.tokens + 0.5 * (self.kinds + 1)


def fit(docs: DataFrame, text: str = "text") -> LanguageModel:
    texts = docs.select(F.col(text).alias("text"))
    ends = texts.count()
    counts = cut(texts.mapInArrow(_count_words, "word long, kind int, n long").groupBy("word").agg(F.first("kind").alias("kind"), F.sum("n").alias("n")))
    per = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas().set_index("kind")
    n, v = np.zeros(RARE), np.zeros(RARE)
    n[per.index], v[per.index] = per["n"], per["v"]
    tokens, kinds = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
    wanted = ROOTS * math.isqrt(int(v.sum()))
    held, limit = commonest(counts, "n", max(HELD, wanted))
    top = held.toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    words = top["word"].to_numpy(np.int64)
    shape = Shape.of(words[:wanted].view(np.uint64))
    for kind, count in zip(top["kind"][: shape.n], top["n"][: shape.n], strict=True):
        n[kind] -= count
        v[kind] -= 1
    params = train(texts, shape, np.concatenate([top["n"].to_numpy(np.float64)[: shape.n], n, [ends]]))
    order = np.argsort(words.view(np.uint64))
    rest = counts.where(F.col("n") <= limit)
    return LanguageModel(tokens, kinds, ends, shape, params, n, v, words.view(np.uint64)[order], top["n"].to_numpy(np.int64)[order], rest.select("word", "n"))


SUMMARY = "row long, id long, n_tokens long, known long, base double, model double, words array<long>, times array<long>"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds, ends, shape, params, class_tokens, class_kinds, held, held_counts = shared.value
        norm = tokens + 0.5 * (kinds + 1)
        class_norm = np.log10(class_tokens + 0.5 * (class_kinds + 1))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch):
                w = find_words(part.column("text"))
                docs = part.num_rows
                kind, bounds = shape.tokens(w)
                steps = log_probabilities(shape, params, *contexts(kind, bounds, shape.end), kind)
                model = np.add.reduceat(steps, bounds[:-1]) if docs else np.zeros(0)
                own = np.delete(kind, bounds[1:] - 1)
                spot = np.minimum(np.searchsorted(held, w.hash), max(len(held) - 1, 0))
                hit = held[spot] == w.hash if len(held) else np.zeros(len(w.hash), bool)
                c = np.where(hit, held_counts[spot], 0) if len(held) else np.zeros(len(w.hash))
                log_c = np.log10(c + 0.5)
                base = np.bincount(w.doc, weights=np.where(hit, log_c, 0.0), minlength=docs) + np.log10(ends + 0.5)
                base -= np.diff(bounds) * np.log10(norm)
                rare = own >= shape.n
                within = np.where(rare, np.where(hit, log_c, 0.0) - class_norm[np.where(rare, own - shape.n, 0)], 0.0)
                model = model + np.bincount(w.doc, weights=within, minlength=docs)
                known = np.bincount(w.doc, weights=hit, minlength=docs).astype(np.int64) + (ends > 0)
                # Words that are not held: their counts are joined, each distinct word of a text once.
                open_ = np.flatnonzero(~hit)
                order = open_[np.lexsort((w.hash[open_], w.doc[open_]))]
                h, d = w.hash[order], w.doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                times = np.diff(np.concatenate([first, [len(h)]]))
                ends_at = np.searchsorted(d[first], np.arange(docs + 1)).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(ends_at), v)
                yield pa.record_batch(
                    {
                        "row": pa.array(row + np.arange(docs)), "id": part.column("id"), "n_tokens": pa.array(np.diff(bounds)), "known": pa.array(known),
                        "base": pa.array(base), "model": pa.array(model), "words": lists(pa.array(h[first].view(np.int64))), "times": lists(pa.array(times)),
                    }
                )
                row += docs

    return run


def score(docs: DataFrame, lm: LanguageModel, ids: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """``ids``, ``n_tokens``, ``n_known``, ``base_score`` (of the smoothed unigram model) and ``score`` (log10 probability of the whole text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((lm.tokens, lm.kinds, lm.ends, lm.shape, lm.params, lm.class_tokens, lm.class_kinds, lm.held, lm.held_counts))
    rows = cut(docs.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_score(shared), SUMMARY))
    loose = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    # A word outside the held ones without a count is unknown: half a count, as for the words below.
    met = loose.join(lm.counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    add = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"))
    out = rows.select("row", "id", "n_tokens", "known", "base", "model").join(add, "row", "left")
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return out.select(
        F.col("id").alias(ids), "n_tokens", (F.col("known") + seen).cast("long").alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score")
    )
