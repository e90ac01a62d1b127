"""Language of whole texts: interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts become letters (lower case) and single spaces.  A model gives each character's probability after the four before it; the language with the
lowest cross-entropy per character wins, and a text whose cross-entropy lies further out than calibration texts of its length is rejected.

Models are fitted on a bounded sample: per language the ``SAMPLE_ROWS`` labelled rows with the least hash
of their id, of which every fifth calibrates.  Every text is scored whole.

Defined results: null texts and texts without letters are ``und`` with score 0 and are rejected; equal cross-entropies go to the first language by name; without
labelled rows all texts are ``und``; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.words import chunks, mix, tidy

ORDER = 5
SAMPLE_ROWS = 1000
CALIBRATE_EVERY = 5
DISCOUNT = 0.75
NONE = "und"
_FACTORS = mix(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)
_LETTERS: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _LETTERS:
        import unicodedata

        _LETTERS.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _LETTERS[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each led by ``ORDER - 1`` spaces, the places of scored characters, and the text of each scored place.

    Letters stay, every run of other characters is one space, and a text ends with one space.
    """
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in low], np.int64)
    code = np.frombuffer("".join(t + " " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), sizes)
    letter = is_letter()[code]
    first = np.zeros(len(code), bool)
    first[np.cumsum(sizes) - sizes] = True
    before = np.concatenate([[False], letter[:-1]]) & ~first
    keep = letter | before
    code, doc = np.where(letter, code, 32)[keep], doc[keep]
    n = np.bincount(doc, minlength=len(low))
    # Room for the leading spaces of each text that has letters.
    lead = (ORDER - 1) * (n > 0)
    upto = np.cumsum(n + lead)
    place = np.arange(len(code)) + np.cumsum(lead)[doc]
    out = np.full(int(upto[-1]) if len(upto) else 0, 32, np.uint32)
    out[place] = code
    return out, place, doc


def gram_hash(code: np.ndarray, place: np.ndarray, m: int) -> np.ndarray:
    """Hash of the ``m`` characters that end at each place."""
    h = np.zeros(len(place), np.uint64)
    for j in range(m):
        h += code[place - j].astype(np.uint64) * _FACTORS[j]
    return mix(h + np.uint64(m))


def _rows_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    m = rows.shape[1]
    for j in range(m):
        h += rows[:, m - 1 - j].astype(np.uint64) * _FACTORS[j]
    return mix(h + np.uint64(m))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """Probabilities and back-off weights by order, each beside its sorted hashes."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    weights: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    unknown: float = 1e-9

    def log2(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        p = np.full(len(place), self.unknown)
        for m, (keys, probs) in enumerate(self.grams, 1):
            if m > 1:
                at, hit = _find(self.weights[m - 1][0], gram_hash(code, place - 1, m - 1))
                p = p * np.where(hit, self.weights[m - 1][1][at], 1.0)
            at, hit = _find(keys, gram_hash(code, place, m))
            p = np.where(hit, probs[at], p)
        return np.log2(p)


def kneser_ney(rows: np.ndarray, counts: np.ndarray, d: float = DISCOUNT) -> Model:
    """An interpolated model from distinct character rows of length ``ORDER`` and their counts; lower orders count distinct left neighbours."""
    levels = [(rows, counts.astype(np.float64))]
    for m in range(ORDER - 1, 0, -1):
        kinds, n = np.unique(levels[0][0][:, 1:], axis=0, return_counts=True)
        levels.insert(0, (kinds, n.astype(np.float64)))
    out = Model()
    kinds, n = levels[0]
    total = n.sum()
    out.unknown = d * len(n) / total / (len(n) + 1)
    p = np.maximum(n - d, 0) / total + out.unknown
    h = _rows_hash(kinds)
    order = np.argsort(h)
    out.grams.append((h[order], p[order]))
    out.weights.append((np.zeros(0, np.uint64), np.zeros(0)))
    for kinds, n in levels[1:]:
        ctx, which, fan = np.unique(_rows_hash(kinds[:, :-1]), return_inverse=True, return_counts=True)
        total = np.bincount(which, weights=n)
        gamma = d * fan / total
        at, hit = _find(out.grams[-1][0], _rows_hash(kinds[:, 1:]))
        lower = np.where(hit, out.grams[-1][1][at], out.unknown)
        p = np.maximum(n - d, 0) / total[which] + gamma[which] * lower
        h = _rows_hash(kinds)
        order = np.argsort(h)
        out.grams.append((h[order], p[order]))
        out.weights.append((ctx, gamma))
    return out


SLOTS = 1 << 19
SCORED = 1 << 19  # Bytes of text counted or scored at once; each takes some 100 in arrays.


class Scorer:
    """Cross-entropies of texts under all models, with a direct-mapped memory of the grams met before."""

    def __init__(self, models: dict[str, Model]):
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        self.tag = np.zeros(SLOTS, np.uint64)
        self.value = np.zeros((SLOTS, len(self.names)), np.float32)

    def _fresh(self, code, place) -> np.ndarray:
        return np.stack([m.log2(code, place) for m in self.models], axis=1).astype(np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character by text and language, and the number of scored characters."""
        code, place, doc = characters(texts)
        h = gram_hash(code, place, ORDER)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        miss = np.flatnonzero(self.tag[slot] != h)
        extra = None
        if len(miss):
            kinds, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            fresh = self._fresh(code, place[miss[first]])
            extra = fresh[which]
            s = (kinds & np.uint64(SLOTS - 1)).astype(np.int64)
            bits = self.value[slot]
            bits[miss] = extra
            self.tag[s], self.value[s] = kinds, fresh
        else:
            bits = self.value[slot]
        n = np.bincount(doc, minlength=len(texts))
        total = np.zeros((len(texts), len(self.names)))
        filled = np.flatnonzero(n)
        if len(filled):
            starts = np.concatenate([[0], np.cumsum(n[filled])[:-1]])
            total[filled] = np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n


@dataclass
class Identifier:
    models: dict[str, Model]
    centre: dict[str, float]
    limit: dict[str, float]

    def judge(self, scorer: Scorer, texts: list[str | None]):
        """Language, score, cross-entropy and rejection of each text."""
        ce, n = scorer.entropies(texts)
        best = ce.argmin(axis=1) if len(texts) else np.zeros(0, int)
        low = ce[np.arange(len(texts)), best]
        share = 1 / np.exp2(np.clip((low[:, None] - ce) * np.minimum(n, 64)[:, None], -60, 0)).sum(axis=1)
        none = n == 0
        names = np.array(scorer.names, dtype=object)[best]
        centre, limit = np.array([self.centre[x] for x in scorer.names])[best], np.array([self.limit[x] for x in scorer.names])[best]
        far = deviation(low, n, centre) > limit
        names[none] = NONE
        return names, np.where(none, 0.0, share), np.where(none, 0.0, low), none | far


def deviation(ce: np.ndarray, n: np.ndarray, centre) -> np.ndarray:
    """Distance from a language's usual cross-entropy, less for short texts, whose cross-entropy varies more."""
    return (ce - centre) * np.sqrt(np.minimum(1.0, n / 200))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, limit=SCORED):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for lang in np.unique(langs.astype(str)):
                texts = [t for t, own in zip(part.column("text").to_pylist(), langs == lang, strict=True) if own]
                code, place, _ = characters(texts)
                if not len(place):
                    continue
                _, first, n = np.unique(gram_hash(code, place, ORDER), return_index=True, return_counts=True)
                # Five characters of 21 bits each in two numbers.
                c = [code[place[first] - ORDER + 1 + j].astype(np.int64) for j in range(ORDER)]
                yield pa.record_batch(
                    {"lang": pa.array([str(lang)] * len(first)), "head": pa.array(c[0] << 21 | c[1]), "tail": pa.array(c[2] << 42 | c[3] << 21 | c[4]), "n": pa.array(n.astype(np.int64))}
                )


def fit(labelled: DataFrame) -> Identifier:
    """Models from ``text`` and ``lang`` of labelled rows: at most ``SAMPLE_ROWS`` different texts a language, those of least hash."""
    known = labelled.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    # Only hashes are ranked, and of these only as many as may be chosen: about four times SAMPLE_ROWS a language, each text once.
    # One row a language, as many as there are models: every task gets them, so no language's rows meet in one task.
    kinds = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("kinds"))
    low = known.select("lang", "h").join(F.broadcast(kinds), "lang").where(F.col("h").cast("double") <= F.least(4.0 * SAMPLE_ROWS / F.col("kinds"), F.lit(1.0)) * 2.0**64 - 2.0**63)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = low.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS)
    sample = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h", "rank").agg(F.min("text").alias("text")).cache()
    try:
        counted = sample.where(F.col("rank") % CALIBRATE_EVERY != 0).select("lang", "text").mapInArrow(tidy(_gram_counts), "lang string, head long, tail long, n long")
        # Distinct grams of the bounded sample; as Arrow columns, since a Row each would take some ten times the memory.
        grams = counted.groupBy("lang", "head", "tail").agg(F.sum("n").alias("n")).toArrow()
        models = {}
        for lang in sorted(pa.compute.unique(grams["lang"]).to_pylist()):
            g = grams.filter(pa.compute.equal(grams["lang"], lang))
            head, tail, low = g["head"].to_numpy(), g["tail"].to_numpy(), (1 << 21) - 1
            rows = np.stack([head >> 21, head & low, tail >> 42, tail >> 21 & low, tail & low], axis=1).astype(np.uint32)
            models[lang] = kneser_ney(rows, g["n"].to_numpy())
        del grams
        held = sample.where(F.col("rank") % CALIBRATE_EVERY == 0).select("lang", "text").toArrow()
    finally:
        sample.unpersist()
    centre, limit = {}, {}
    scorer = Scorer(models)
    for i, lang in enumerate(scorer.names):
        own = held.filter(pa.compute.equal(held["lang"], lang)).select(["text"]).to_batches()
        judged = [scorer.entropies(part.column("text").to_pylist()) for batch in own for part in chunks(batch, limit=SCORED)]
        ce, n = (np.concatenate(x) for x in zip(*judged, strict=True)) if judged else scorer.entropies([])
        ce, n = ce[n > 0, i], n[n > 0]
        centre[lang] = float(np.median(ce)) if len(ce) else 0.0
        limit[lang] = 2.0 * float(deviation(ce, n, centre[lang]).max()) + 0.5 if len(ce) else np.inf
    return Identifier(models, centre, limit)


def identify(docs: DataFrame, found: Identifier, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``ids``, ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected`` of every document, from its text alone."""
    schema = "id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    rows = docs.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text"))
    if not found.models:
        return rows.select(F.col("id").alias(ids), F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(found)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value.models)
        for batch in batches:
            for part in chunks(batch, limit=SCORED):
                names, score, ce, out = shared.value.judge(scorer, part.column("text").to_pylist())
                yield pa.record_batch({"id": part.column("id"), "lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(score), "cross_entropy": pa.array(ce), "rejected": pa.array(out)})

    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", ids)
