"""Packing of token pieces into windows, from non-negative least squares over shallow length combinations.

Documents are cut into whole windows and one rest each; rests are counted by length class, a histogram of fixed size.  All combinations of up to ``DEPTH``
classes that fill a window are columns of a matrix whose non-negative least-squares solution against the histogram gives repeat counts.  They
are rounded down; what is left of the histogram is packed greedily, best fit first, still as counts.  Pieces then take places by their rank
within their class, so neither texts nor pieces ever meet on the driver or in one task.

Defined results: a null or empty text is the end token alone; repeated rows are packed once each; an empty table gives an empty table; ranks among equal
pieces follow id and start.
"""

from __future__ import annotations

import hashlib
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.words import chunks, prefix_sums, span_hash, split_words, tidy
from parlance.session import cut

WINDOW = 2048
STEP = 16  # Width of a length class; a window has WINDOW / STEP units.
DEPTH = 3
END_ID = 1
REMEMBERED = 1 << 20  # Words that a worker may remember when it begins a chunk; beyond them it forgets all.
BLOCK = 2_000  # Words of letters that are encoded at a time.
ENCODED = 1 << 18  # Bytes of text encoded at once.

LETTERS, PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PUNCTUATION[list(string.punctuation.encode())] = True

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Token ids of words, each distinct word encoded once while a worker remembers it.

    Valid for tokenizers that drop white space, split letters from punctuation, leave the letters a-z as they are, and end the last id of each such piece
    with ``</w>``: the ids of a text are those of its words in turn, and those of letters with punctuation behind them are the ids of the two.  Words of
    letters alone are encoded many at a time and told apart by these ends, or one by one if the ends don't match the words.

    Remembered words are found by their hashes (see ``words``), in an open table: ``slot`` holds the word's number, or -1 where nothing is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # Words of a-z need no normalising and no patterns: the same model, parted at blanks.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.key, self.slot = np.zeros(1 << 12, np.uint64), np.full(1 << 12, -1, np.int32)
        self.flat, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.letters = np.zeros(0, bool)

    def _learn(self, letters: list[bytes], others: list[bytes]) -> None:
        """Append the ids of words of lower-case letters and of any others."""
        flat, counts = [], []
        for at in range(0, len(letters), BLOCK):
            part = letters[at : at + BLOCK]
            joined = b" ".join(part)
            coder = self.plain if joined.isascii() else self.tokenizer
            ids = np.array(coder.encode_batch_fast([joined.decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(part):
                flat.append(ids)
                counts.append(np.diff(np.concatenate([[-1], ends])))
                continue
            # Some word is split into pieces with ends of their own: each word by itself.
            for e in self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in part], add_special_tokens=False):
                flat.append(np.array(e.ids, np.uint32))
                counts.append(np.array([len(e.ids)]))
        for e in self.tokenizer.encode_batch_fast([o.decode("utf-8") for o in others], add_special_tokens=False) if others else []:
            flat.append(np.array(e.ids, np.uint32))
            counts.append(np.array([len(e.ids)]))
        new = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(new) - new])
        self.flat, self.count = np.concatenate([self.flat, *flat]), np.concatenate([self.count, new])
        self.letters = np.concatenate([self.letters, np.arange(len(new)) < len(letters)])

    def _seek(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of remembered words, -1 for others."""
        mask = len(self.slot) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        number = self.slot[at]
        left = np.flatnonzero((number >= 0) & (self.key[at] != hashes))
        while len(left):
            at[left] = (at[left] + 1) & mask
            spot = at[left]
            number[left] = self.slot[spot]
            left = left[(self.slot[spot] >= 0) & (self.key[spot] != hashes[left])]
        return number

    def _note(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Enter different hashes that the table lacks."""
        if 2 * len(self.count) > len(self.slot):
            used = self.slot >= 0
            hashes, numbers = np.concatenate([self.key[used], hashes]), np.concatenate([self.slot[used], numbers])
            size = 1 << int(4 * len(self.count) - 1).bit_length()
            self.key, self.slot = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        mask = len(self.slot) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.slot[at[left]] < 0]
            self.slot[at[free]] = numbers[free]  # of several at one place one stays, the others go on
            won = self.slot[at[left]] == numbers[left]
            self.key[at[left[won]]] = hashes[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & mask

    def of(self, raw: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words at these places; those not remembered are learnt."""
        number = self._seek(hashes)
        gone = np.flatnonzero(number < 0)
        if not len(gone):
            return number
        _, seen = np.unique(hashes[gone], return_index=True)
        new = gone[seen]
        plain, marked, others = [], [], []  # words of a-z, of other letters too, and the rest, with their places in new
        for i, (a, b) in enumerate(zip(start[new].tolist(), end[new].tolist(), strict=True)):
            word = raw[a:b].lower()
            if word.isalpha():
                plain.append((i, word))
            elif not word.isascii() and unicodedata.normalize("NFC", word.decode("utf-8").lower()).isalpha():
                marked.append((i, word))
            else:
                others.append((i, raw[a:b]))
        known = len(self.count)
        self._learn([w for _, w in plain], [])
        self._learn([w for _, w in marked], [w for _, w in others])
        order = np.array([i for i, _ in (*plain, *marked, *others)], np.int64)
        self._note(hashes[new][order], np.arange(known, len(self.count), dtype=np.int32))
        number[gone] = self._seek(hashes[gone])
        return number


_WORKER: dict[str, WordIds] = {}


def split_tails(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the end of its letters, if only ASCII punctuation follows them; else its end.  Bytes from 128 on count as letters here."""
    middle = end.copy()
    at = np.flatnonzero(PUNCTUATION[data[end - 1]])
    if len(at):
        stops = np.append(np.flatnonzero(~LETTERS[data]), len(data))
        stop = stops[np.searchsorted(stops, start[at])]
        solid = np.append(np.flatnonzero(~PUNCTUATION[data]), len(data))
        fit = (stop > start[at]) & (solid[np.searchsorted(solid, stop)] >= end[at])
        middle[at[fit]] = stop[fit]
    return middle


def places(data: bytes, part: bytes) -> Iterator[int]:
    at = data.find(part)
    while at >= 0:
        yield at
        at = data.find(part, at + 1)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in turn, each row ended by ``END_ID``, and the first place of each row (one more at the end)."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    coder = _WORKER[path]
    if len(coder.count) > REMEMBERED:
        coder.forget()
    data, start, end, first = split_words(texts)
    # Upper case is folded by the tokenizer itself, so words that differ only in the case of A-Z share ids and hashes.
    total, raw = prefix_sums(data), data.tobytes()
    middle = split_tails(data, start, end)
    hashes = span_hash(total, start, middle)
    # But added tokens are found before that, as they are spelt: words that hold one in any other case get hashes of their own.
    low = raw.lower()
    for i in np.unique(np.searchsorted(start, [at for token in coder.added for at in places(low, token)], "right") - 1).tolist():
        word = raw[start[i] : end[i]]
        if word != low[start[i] : end[i]]:
            hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    number = coder.of(raw, start, middle, hashes)
    whole = np.flatnonzero((middle < end) & ~coder.letters[number])  # not letters after all, so what follows may belong to it
    if len(whole):
        middle[whole] = end[whole]
        number[whole] = coder.of(raw, start[whole], end[whole], span_hash(total, start[whole], end[whole]))
    tails = np.flatnonzero(middle < end)
    spans = np.insert(number, tails + 1, coder.of(raw, middle[tails], end[tails], span_hash(total, middle[tails], end[tails])))
    n = coder.count[spans]
    upto = np.concatenate([[0], np.cumsum(n)])
    ids = coder.flat[np.repeat(coder.first[spans] - upto[:-1], n) + np.arange(upto[-1])]
    bounds = upto[first + np.searchsorted(tails, first)]
    out = np.insert(ids, bounds[1:], END_ID).astype(np.uint32)
    return out, bounds + np.arange(len(bounds))


def _pieces(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=ENCODED):
                ids, bounds = token_ids(part.column("text"), path)
                ids = ids.astype("<u4")
                rows = [(i, a, min(window, int(hi - lo) - a), int(lo), int(hi - lo)) for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) for a in range(0, int(hi - lo), window)]
                doc = part.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
                crc = [zlib.crc32(ids[lo + a : lo + a + n].tobytes()) for _, a, n, lo, _ in rows]
                long = lambda v: pa.array(v, pa.int64())
                yield pa.record_batch({"doc_id": doc, "start": long([r[1] for r in rows]), "length": long([r[2] for r in rows]), "ids_crc32": long(crc), "doc_tokens": long([r[4] for r in rows])})

    return run


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All falling tuples of 1 to ``depth`` positive class sizes that sum to ``units``."""
    found: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.append(head)
        elif len(head) < depth:
            for size in range(min(left, most), 0, -1):
                if size * (depth - len(head)) < left:
                    break
                grow((*head, size), left - size, size)

    grow((), units, units)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that lowers ``|a x - b|``: accelerated projected gradient steps."""
    step = 1.0 / (np.linalg.norm(a, 2) ** 2)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (a.T @ (a @ y - b)))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of class sizes (index: units) with repeat counts that use up the histogram exactly."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    combos = combinations(units, depth)
    a = np.zeros((units, len(combos)))
    for j, c in enumerate(combos):
        for size in c:
            a[size - 1, j] += 1
    scale = max(1.0, float(left.max(initial=0)))
    repeats = np.floor(nnls(a, left[1:] / scale) * scale + 1e-9).astype(np.int64)
    out = []
    for j in np.argsort(-repeats, kind="stable"):
        c = combos[j]
        sizes, need = np.unique(c, return_counts=True)
        times = int(min(repeats[j], (left[sizes] // need).min()))
        if times > 0:
            left[sizes] -= need * times
            out.append((c, times))
    # Best fit on counts: the longest piece left, then again and again the longest that still fits; a combination repeats as long as its counts last.
    while left.any():
        c, room, taken = [], units, np.zeros_like(left)
        while True:
            fits = np.flatnonzero(left[: room + 1] - taken[: room + 1] > 0)
            if not len(fits):
                break
            size = int(fits[-1])
            c.append(size)
            taken[size] += 1
            room -= size
        used = np.flatnonzero(taken)
        times = int((left[used] // taken[used]).min())
        left -= taken * times
        out.append((tuple(c), times))
    return out


def _place(units: int, chosen: list[tuple[tuple[int, ...], int]]):
    """For each class: rank limits, first sequence of the combination and place among its pieces of that class."""
    tables: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used = np.zeros(units + 1, np.int64)
    sequence = 0
    for c, times in chosen:
        sizes, need = np.unique(c, return_counts=True)
        for size, k in zip(sizes.tolist(), need.tolist(), strict=True):
            first = sorted(c, reverse=True).index(size)
            tables.setdefault(size, []).append((int(used[size]), sequence, k, first, times))
            used[size] += k * times
        sequence += times
    return {s: tuple(np.array(col) for col in zip(*rows, strict=True)) for s, rows in tables.items()}


def _assign(tables):
    def run(batches):
        for batch in batches:
            size, rank = batch["size"].to_numpy(), batch["rank"].to_numpy()
            seq, place = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                lo, base, k, first, _ = tables[int(s)]
                row = np.searchsorted(lo, rank[at], "right") - 1
                gone = rank[at] - lo[row]
                seq[at] = base[row] + gone // k[row]
                place[at] = first[row] + gone % k[row]
            yield batch.assign(sequence_id=seq, place=place).drop(columns=["size", "rank"])

    return run


def pieces_of(docs: DataFrame, path: str, ids: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Spans of token ids of every document: whole windows, then the rest."""
    return docs.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(tidy(_pieces(path, window)), PIECES)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    pieces = cut(pieces)
    units = window // STEP
    sized = pieces.withColumn("size", F.ceil(F.col("length") / STEP).cast("int"))
    total = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(units + 1, np.int64)
    for r in total.collect():  # at most WINDOW / STEP rows
        histogram[r["size"]] = r["n"]
    tables = _place(units, plan(histogram))
    # Ranks within a class: blocks of it by hash, then rows of a block; blocks follow the table's size, so no class fills one task.
    rows = int(histogram.sum())
    parts = {s: max(1, -(-int(n) * 4096 // max(rows, 1))) for s, n in enumerate(histogram)}
    width = F.element_at(F.array(*[F.lit(int(parts[s])) for s in range(units + 1)]), F.col("size") + 1)
    blocked = sized.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), width))
    blocks = blocked.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select("size", "part", (F.sum("n").over(upto) - F.col("n")).alias("before"))  # at most 2 * 4096 rows
    own = F.row_number().over(Window.partitionBy("size", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = blocked.withColumn("own", own).join(F.broadcast(blocks), ["size", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.select(*names, "size", "rank").mapInPandas(tidy(_assign(tables)), PIECES + ", sequence_id long, place long")
    order = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length")).drop("place")
