"""Secret scans: all rules in one deterministic automaton over bytes.

Rule patterns are parsed to nondeterministic automata, joined, made deterministic by subset construction over classes of bytes that no rule tells
apart, and minimised by partition refinement into one transition array.  Two arrays are built: the *finder*, which may begin anywhere and stays in one state
once any rule is met, and the *anchored* automaton, which begins at one byte and knows which rules accept there and which may still accept.

A text is read once by the finder.  Bytes that occur in no rule return it to its start from every state, so the stretches between them are independent:
all stretches of a megabyte of text advance together, one byte a step.  Only stretches in which a rule was met are read again, from each of
their bytes by the anchored automaton, for the exact ends: per rule the leftmost longest matches that do not overlap.  A match counts if the rule's
narrower pattern accepts the same bytes, so a match that is too short still uses up its bytes.

Patterns know literals, ``.``, classes, groups, ``|``, ``? * + {m} {m,} {m,n}`` and ``\\xHH``; they are ASCII and matches are longest, so a pattern must not rely on reluctant or
ordered choice.  Null and empty texts have no spans; repeated rows give a row each; other columns of the input are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.words import chunks, text_buffers

SPANS = "array<struct<kind:string,start:long,end:long>>"
FEW = 48  # Stretches left below this number are finished one by one.


@dataclass(frozen=True)
class Rule:
    """``pattern`` says what a match uses up; ``narrow``, if given, which matches count."""

    kind: str
    pattern: str
    narrow: str | None = None
    ignore_case: bool = False


def _assign(least: str) -> str:
    return r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""" + least


RULES = (
    Rule("assign", _assign("+"), _assign("{6,}"), ignore_case=True),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", "-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY( BLOCK)?-----"),
)


class _Nfa:
    """States with empty moves and moves on sets of bytes (bit masks)."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class _Parser:
    """Recursive descent over one pattern; every part is added to the automaton between two states."""

    def __init__(self, nfa: _Nfa, pattern: str, ignore_case: bool):
        if not pattern.isascii():
            raise ValueError(f"pattern is not ASCII: {pattern}")
        self.nfa, self.text, self.fold, self.at = nfa, pattern, ignore_case, 0

    def parse(self, start: int) -> int:
        end = self.choice(start)
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text}")
        return end

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"pattern ends early: {self.text}")
        self.at += 1
        return self.text[self.at - 1]

    def choice(self, start: int) -> int:
        end = self.nfa.state()
        self.nfa.empty[self.sequence(start)].append(end)
        while self.peek() == "|":
            self.take()
            self.nfa.empty[self.sequence(start)].append(end)
        return end

    def sequence(self, start: int) -> int:
        while self.peek() not in ("", "|", ")"):
            start = self.repeated(start)
        return start

    def repeated(self, start: int) -> int:
        begin = self.at
        inner = self.nfa.state()
        self.nfa.empty[start].append(inner)
        end = self.atom(inner)
        low, high = self.bounds()
        rest = self.at
        for n in range(2, max(low, high or 0, 1) + 1):
            if n > low:  # from here on a copy may be left out
                stop = end
                self.at = begin
                end = self.atom(stop)
                self.nfa.empty[stop].append(end)
            else:
                self.at = begin
                inner = self.nfa.state()
                self.nfa.empty[end].append(inner)
                end = self.atom(inner)
        self.at = rest
        out = self.nfa.state()
        self.nfa.empty[end].append(out)
        if high is None:
            self.nfa.empty[end].append(inner)
        if low == 0:
            self.nfa.empty[start].append(out)
        return out

    def bounds(self) -> tuple[int, int | None]:
        mark = self.peek()
        if mark and mark in "?*+":
            self.take()
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        if mark != "{":
            return 1, 1
        close = self.text.index("}", self.at)
        low, comma, high = self.text[self.at + 1 : close].partition(",")
        self.at = close + 1
        found = (int(low), (int(high) if high else None) if comma else int(low))
        if found[1] is not None and (found[1] < max(found[0], 1)):
            raise ValueError(f"empty repeat in {self.text}")
        return found

    def atom(self, start: int) -> int:
        c = self.take()
        if c == "(":
            end = self.choice(start)
            if self.take() != ")":
                raise ValueError(f"group is not closed in {self.text}")
            return end
        if c in "?*+{":
            raise ValueError(f"nothing to repeat in {self.text}")
        mask = self.members() if c == "[" else (1 << 256) - 1 - (1 << 10) if c == "." else 1 << (self.escape() if c == "\\" else ord(c))
        end = self.nfa.state()
        self.nfa.moves[start].append((self.folded(mask), end))
        return end

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c} in {self.text}")
        return ord(c)

    def member(self) -> int:
        c = self.take()
        return self.escape() if c == "\\" else ord(c)

    def members(self) -> int:
        mask, negated, first = 0, self.peek() == "^", True
        if negated:
            self.take()
        while first or self.peek() != "]":
            first = False
            low = high = self.member()
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                high = self.member()
            for b in range(low, high + 1):
                mask |= 1 << b
        self.take()
        if negated:
            return (1 << 256) - 1 - self.folded(mask)
        return mask

    def folded(self, mask: int) -> int:
        if self.fold:
            for b in range(65, 91):
                if mask >> b & 1 or mask >> (b + 32) & 1:
                    mask |= 1 << b | 1 << (b + 32)
        return mask


def byte_classes(masks: set[int]) -> np.ndarray:
    """Class of each byte: bytes of one class lie in the same sets."""
    names: dict[tuple[bool, ...], int] = {}
    order = sorted(masks)
    return np.array([names.setdefault(tuple(bool(m >> b & 1) for m in order), len(names)) for b in range(256)], np.uint8)


def _union(sets) -> int:
    out = 0
    for x in sets:
        out |= x
    return out


def determine(nfa: _Nfa, starts: list[int], ends: dict[int, int], classes: np.ndarray, loop: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transitions (state, class) and accepted bits of the subset automaton; state 0 is the start.

    ``loop`` lets a match begin at every byte and joins all accepting states in one that is never left.
    """
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(int(classes.max()) + 1)]
    # Sets of states as bits of one number: where each state leads by class, with all that follows without a byte.
    reach = [sum(1 << t for t in nfa.closure([s])) for s in range(len(nfa.empty))]
    steps = [[(c, into) for c, byte in enumerate(sample) if (into := _union(reach[t] for mask, t in moves if mask >> byte & 1))] for moves in nfa.moves]
    first = _union(reach[s] for s in starts)
    final = _union(1 << s for s in ends)
    done = -1  # stands for every set that accepts, where matches may begin anywhere
    known, todo, rows, accepts = {first: 0}, [first], [], []
    for now in todo:
        if now == done:
            rows.append([known[done]] * len(sample))
            accepts.append(1)
            continue
        accepts.append(_union(bits for s, bits in ends.items() if now >> s & 1))
        row = [first if loop else 0] * len(sample)
        s = now
        while s:
            low = s & -s
            for c, into in steps[low.bit_length() - 1]:
                row[c] |= into
            s ^= low
        for c, then in enumerate(row):
            if loop and then & final:
                then = done
            if then not in known:
                known[then] = len(known)
                todo.append(then)
            row[c] = known[then]
        rows.append(row)
    return np.array(rows, np.int32), np.array(accepts, np.int64)


def minimise(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least automaton of the same language: states split by what they accept, then by where they lead, until nothing splits; the start stays state 0."""
    label = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = label
        for c in range(table.shape[1]):
            finer = np.unique(finer * np.int64(len(table)) + label[table[:, c]], return_inverse=True)[1].reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    first = np.unique(label, return_index=True)[1]
    order = np.argsort(first, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return place[label[table[first[order]]]], accepts[first[order]]


def joined(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The least finder of the rules of two finders: pairs of states that can be reached together."""
    (a, met_a), (b, met_b) = one, two
    n = len(b)
    met = (met_a[:, None] | met_b[None, :]).reshape(-1).astype(bool)
    codes, rows, fresh = np.zeros(1, np.int64), [], np.zeros(1, np.int64)
    seen = np.zeros(len(a) * n, bool)
    seen[0] = True
    done = int(np.flatnonzero(met)[0]) if met.any() else -1
    while len(fresh):
        then = a[fresh // n].astype(np.int64) * n + b[fresh % n]
        then[met[then]] = done
        then[met[fresh]] = done
        rows.append(then)
        fresh = np.unique(then)
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        codes = np.concatenate([codes, fresh])
    place = np.zeros(len(seen), np.int32)
    place[codes] = np.arange(len(codes), dtype=np.int32)
    return minimise(place[np.concatenate(rows)], met[codes].astype(np.int64))


@dataclass(frozen=True)
class Automaton:
    """The transition arrays of a list of rules.  Bit ``i`` stands for rule ``i``'s pattern, bit ``i + n`` for its narrower one."""

    kinds: tuple[str, ...]
    classes: np.ndarray
    outside: np.ndarray  # bytes of no rule
    finder: np.ndarray
    met: int  # the finder's last state, -1 if no rule can ever be met
    anchored: np.ndarray
    accepts: np.ndarray
    live: np.ndarray  # rules that a state may still accept


@lru_cache(maxsize=8)
def build(rules: Sequence[Rule] = RULES) -> Automaton:
    nfa, n = _Nfa(), len(rules)
    wide, strict, ends = [], [], {}
    for i, rule in enumerate(rules):
        for bit, pattern in ((i, rule.pattern), (i + n, rule.narrow or rule.pattern)):
            start = nfa.state()
            end = _Parser(nfa, pattern, rule.ignore_case).parse(start)
            if end in nfa.closure([start]):
                raise ValueError(f"pattern matches nothing: {pattern}")
            ends[end] = 1 << bit
            wide.append(start)
            if bit >= n:
                strict.append((start, end))
    masks = {m for moves in nfa.moves for m, _ in moves}
    classes = byte_classes(masks)
    used = _union(masks)
    # Rule by rule: joining least automata keeps the sets of states small.
    finder, met = reduce(joined, (minimise(*determine(nfa, [start], {end: 1}, classes, loop=True)) for start, end in strict))
    anchored, accepts = minimise(*determine(nfa, wide, ends, classes, loop=False))
    live = accepts.copy()
    while True:
        more = live | np.bitwise_or.reduce(live[anchored], axis=1)
        if np.array_equal(more, live):
            break
        live = more
    live = (live | live >> n) & ((1 << n) - 1)
    stop = np.flatnonzero(met)
    return Automaton(tuple(r.kind for r in rules), classes, np.array([not used >> b & 1 for b in range(256)]), finder, int(stop[0]) if len(stop) else -1, anchored, accepts, live)


def met_stretches(a: Automaton, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, begin, end) of the stretches in which some rule is met, in order."""
    if not len(data) or a.met < 0:
        return []
    solid = ~a.outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    order = np.argsort(begin - end, kind="stable")
    begin, size = begin[order], (end - begin)[order]
    width = a.finder.shape[1]
    table, spelled = (a.finder * width).reshape(-1), a.classes[data]
    state = np.zeros(len(begin), np.int32)
    step = 0
    # Stretches advance together, the longest first; those that have ended drop off the tail.
    going = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")
    while step < len(going) and going[step] > FEW:
        k = int(going[step])
        state[:k] = table[state[:k] + spelled[begin[:k] + step]]
        step += 1
    if step < len(going):
        flat = table.tolist()
        for i in range(int(going[step])):
            s = int(state[i])
            for c in spelled[begin[i] + step : begin[i] + size[i]].tobytes():
                s = flat[s + c]
            state[i] = s
    hit = np.flatnonzero(state == a.met * width)
    hit = hit[np.argsort(begin[hit])]
    rows = np.searchsorted(offsets, begin[hit], side="right") - 1
    return list(zip(rows.tolist(), begin[hit].tolist(), (begin[hit] + size[hit]).tolist(), strict=True))


class Extractor:
    """Exact matches in one stretch, by the anchored automaton."""

    def __init__(self, a: Automaton):
        self.n, self.width = len(a.kinds), a.anchored.shape[1]
        self.classes = a.classes.tobytes()
        self.table, self.accepts, self.live = a.anchored.reshape(-1).tolist(), a.accepts.tolist(), a.live.tolist()

    def matches(self, stretch: bytes) -> list[tuple[int, int, int]]:
        """(rule, begin, end) of the matches that count."""
        n, width, table, accepts, live = self.n, self.width, self.table, self.accepts, self.live
        code = stretch.translate(self.classes)
        free, out, every = [0] * n, [], (1 << n) - 1
        for begin in range(len(code)):
            open_ = sum(1 << i for i in range(n) if free[i] <= begin) if max(free) > begin else every
            state, last = 0, {}
            for at in range(begin, len(code)):
                state = table[state * width + code[at]]
                if not live[state] & open_:
                    break
                bits = accepts[state]
                if bits:
                    for i in range(n):
                        if bits >> i & 1 and open_ >> i & 1:
                            last[i] = (at + 1, bits >> (i + n) & 1)
            for i, (end, counts) in last.items():
                free[i] = end
                if counts:
                    out.append((i, begin, end))
        return out


def find(a: Automaton, extractor: Extractor, column: pa.Array) -> list[tuple[int, int, int, int]]:
    """(row, rule, begin, end) of all matches of some texts, in code points, ordered by row, begin and rule."""
    data, offsets = text_buffers(column)
    out, held, upto = [], -1, None
    for row, begin, end in met_stretches(a, data, offsets):
        matches = extractor.matches(data[begin:end].tobytes())
        if not matches:
            continue
        if row != held:
            # Bytes that begin a code point, counted up to every byte of the row.
            held, upto = row, np.concatenate([[0], np.cumsum((data[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80)])
        shift = begin - int(offsets[row])
        out += [(row, rule, int(upto[shift + b]), int(upto[shift + e])) for rule, b, e in matches]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``ids`` and ``spans`` (kind, start, end in code points, end exclusive; by start, then by the order of the rules) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(build(tuple(rules)))  # grows with the rules alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        extractor = Extractor(a)
        kinds = np.array(a.kinds, dtype=object)
        for batch in batches:
            for part in chunks(batch):
                found = np.array(find(a, extractor, part.column("text")), np.int64).reshape(-1, 4)
                first = np.searchsorted(found[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(kinds[found[:, 1]].tolist(), pa.string()), pa.array(found[:, 2]), pa.array(found[:, 3])], names=["kind", "start", "end"])
                yield pa.record_batch({"id": part.column("id"), "spans": pa.ListArray.from_arrays(pa.array(first), spans)})

    rows = docs.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id long, spans {SPANS}").withColumnRenamed("id", ids)


def count_of(kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def listed(kinds: Sequence[str] | None = None) -> Column:
    """Spans (of some kinds) as ``kind:start:end``, joined by commas."""
    own = F.filter("spans", lambda s: s["kind"].isin(*kinds)) if kinds else F.col("spans")
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: Sequence[Rule] = RULES, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``ids`` and ``text`` of every row, each span (overlapping ones as one) replaced by ``[kind]`` of its first."""
    shared = docs.sparkSession.sparkContext.broadcast(build(tuple(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        extractor = Extractor(a)
        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text").to_pylist()
                cuts: dict[int, list[list]] = {}
                for row, rule, begin, end in find(a, extractor, part.column("text")):
                    own = cuts.setdefault(row, [])
                    if own and begin < own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    else:
                        own.append([begin, end, a.kinds[rule]])
                for row, own in cuts.items():
                    kept, at = [], 0
                    for begin, end, kind in own:
                        kept += [texts[row][at:begin], f"[{kind}]"]
                        at = end
                    texts[row] = "".join([*kept, texts[row][at:]])
                yield pa.record_batch({"id": part.column("id"), "text": pa.array(texts, pa.string())})

    rows = docs.select(F.col(ids).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", ids).withColumnRenamed("text", text)
