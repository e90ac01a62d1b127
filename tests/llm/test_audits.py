"""Whitening, source divergence and secret scans against plain loops, on odd rows and on empty tables."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import divergence, secrets, whitening

EIGENVALUES = {
    "spread": lambda n, rng: rng.random(n) + 0.1,
    "equal": lambda n, rng: np.ones(n),
    "falling": lambda n, rng: np.exp(-np.arange(n) * 0.5),
    "close": lambda n, rng: 1 + 1e-9 * rng.random(n),
    "few": lambda n, rng: np.concatenate([[9.0] * 3, np.zeros(n - 3)]),
    "one large": lambda n, rng: np.concatenate([[1e8], 1 + 1e-3 * rng.random(n - 1)]),
}


@pytest.mark.parametrize("kind", EIGENVALUES)
@pytest.mark.parametrize("n, k", [(40, 4), (40, 40), (3, 4)])
def test_eigenpairs(kind, n, k):
    rng = np.random.default_rng(7)
    u = np.linalg.qr(rng.standard_normal((n, n)))[0]
    v = (u * EIGENVALUES[kind](n, rng)) @ u.T
    v = (v + v.T) / 2
    e, x = whitening.eigenpairs(v, k)
    want = np.linalg.eigvalsh(v)[::-1]
    assert len(e) == min(k, (want > 1e-12 * want[0]).sum())
    assert np.allclose(e, want[: len(e)], rtol=1e-10, atol=1e-13 * want[0])
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12 and np.abs(v @ x - x * e).max() < 1e-11 * want[0]
    d, b = whitening.tridiagonal(v)
    assert [whitening.above(d, b, s) for s in (-1.0, want[0] * 2, (want[0] + want[-1]) / 2 + 1e-7)] == [n, 0, (want > (want[0] + want[-1]) / 2 + 1e-7).sum()]


def test_no_eigenvalue_is_missed():
    v = np.diag([5.0, 4.0, 3.0, 1.0])
    with pytest.raises(ArithmeticError):
        whitening.inside(v, 2.5, 5.5, 2)


VECTORS = "vec_id long, embedding array<double>, x array<long>, id string"


def test_whitening_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(5) * [3, 2, 1, 0.5, 0.1]).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[4][1]), (None, [-0.0] * 5)]
    bad = [(200, None), (201, []), (202, [1.0] * 4), (203, [float("nan")] * 5), (204, [1.0, None, 1.0, 1.0, 1.0]), (205, [float("inf")] * 5), (206, [1e300] * 5)]
    df = spark.createDataFrame([(i, v, None, "c") for i, v in rows + bad], VECTORS)
    vectors = whitening.whole_vectors(df, "vec_id", "embedding", 256)
    w = whitening.fit(vectors)
    x = np.array([np.floor(256 * np.array(v)).astype(int) for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    assert (w.n, w.sums) == (n, s.tolist())
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    assert np.allclose(w.values, e, rtol=1e-12) and np.isclose(w.trace, np.trace(centred.T @ centred / n)) and w.identity_error < 1e-10
    got = defaultdict(Counter)
    white = whitening.transform(vectors, w)
    assert white.count() == 4 * len(rows)
    for r in white.collect():
        got[r.id, r.component][r.deviation, round(abs(r.whitened), 6)] += 1
    want = defaultdict(Counter)
    for (i, _), v in zip(rows, x, strict=True):
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
        for c in range(4):
            want[i, c + 1][dev, round(abs(float((v - s / n) @ u[:, c] / np.sqrt(e[c]))), 6)] += 1
    assert got == want
    empty = whitening.whole_vectors(df.limit(0), "vec_id", "embedding", 256)
    assert whitening.transform(empty, whitening.fit(empty)).count() == 0
    same = whitening.whole_vectors(df.where("vec_id >= 100 and vec_id < 130"), "vec_id", "embedding", 256)
    assert whitening.fit(same).n == 1 and whitening.transform(same, whitening.fit(same)).count() == 0


def test_deviations_stay_exact():
    assert whitening.deviations(np.array([[3, -4]]), 10**12, [0, 1]) == [None]
    assert whitening.deviations(np.array([[1, 2]]), 2 * 10**9, [10**9, 0]) == [None]
    assert whitening.deviations(np.array([[1, 0]]), 2 * 10**9, [0, 1]) == [4 * 10**18 + 1]


def plain_divergences(rows, least, best):
    docs, count, held = [(t or "", lang or "", s or "") for t, lang, s in rows], defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        count[lang, source].update(terms)
        count[lang].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang, source in {(x, s) for _, x, s in docs}:
        kept = [t for t, n in held[lang].items() if n >= least]
        p = {g: {t: 1 + 10**9 * (count[g][t] + 2) // (sum(count[g][k] for k in kept) + 2 * len(kept)) for t in kept} for g in [lang, *[(x, s) for _, x, s in docs if x == lang]]}
        f = lambda a, b: int(Fraction((a - b) ** 2, a + b))
        me = p[lang, source]
        pairs = [(-sum(f(me[t], p[lang, s][t]) for t in kept), s.encode(), "pair") for s in {s for _, x, s in docs if x == lang} - {source}]
        terms = [(-f(me[t], p[lang][t]), t.encode(), "term") for t in kept if count[lang, source][t] and me[t] > p[lang][t]]
        for part in (sorted(pairs), sorted(terms)[:best]):
            out |= {(lang, source, kind, item.decode(), -v, i) for i, (v, item, kind) in enumerate(part, 1)}
    return out


@pytest.mark.parametrize("spill", [1 << 19, 4])
def test_divergences_equal_plain(spark, odd_docs, no_docs, spill, monkeypatch):
    rng = random.Random(spill)
    bag = ["alpha", "Beta", "ÉTÉ", "été", "日本", "x1y", "don't", "z"] + [f"r{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(bag, k=rng.randint(0, 40))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "", None, "ü"])) for _ in range(300)]
    rows += [(None, "en", "z"), ("alpha " * 3000, "en", "a"), ("only", "de", "a"), (None, None, "b")] + [rows[0]] * 20
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "term long, text string, lang string, source string")
    if spill == 4:  # the module itself is shipped by reference, so the small bound is set where the tasks run
        held = divergence.Stripes()
        batches = [b for b in df.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text").toArrow().to_batches(max_chunksize=40)]
        monkeypatch.setattr(divergence, "SPILL", 4)
        parts = [r for b in divergence._stripes(iter(batches)) for r in b.to_pylist()]
        total = Counter()
        for r in parts:
            for s, c in zip(r["sources"], r["counts"], strict=True):
                total[r["lang"], r["term"], s] += c
        for b in batches:
            held.add(b)
        whole = next(held.spill()).to_pylist()
        assert total == Counter({(r["lang"], r["term"], s): c for r in whole for s, c in zip(r["sources"], r["counts"], strict=True)}) and len(parts) > len(whole)
        return
    got = [tuple(r) for r in divergence.divergences(df, least_docs=10, best=5).collect()]
    want = plain_divergences(rows, 10, 5)
    assert len(got) == len(want) and set(got) == want
    odd = [tuple(r) for r in divergence.divergences(odd_docs, least_docs=2).collect()]
    assert set(odd) == plain_divergences([(r.text, r.lang, r.source) for r in odd_docs.collect()], 2, 10)
    assert divergence.divergences(no_docs).count() == 0


def test_shares_stay_exact(spark):
    c, n = 9 * 10**15, 9 * 10**17 + 7
    row = spark.range(1).select(divergence.share(F.lit(c).cast("long"), F.lit(n)).alias("p"), divergence.apart(F.lit(999_999_999).cast("long"), F.lit(3).cast("long")).alias("f")).first()
    assert row.p == 1 + 10**9 * (c + 2) // n and row.f == (999_999_996**2) // 1_000_000_002


LETTERS = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}
NAMES = "|".join("".join(LETTERS.get(c, c) for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
PLAIN = {
    "assign": (re.compile(rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(1)) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
    "github": (re.compile("gh[pousr]_[A-Za-z0-9]{36,}"), lambda m: True),
    "slack": (re.compile("xox[abprs]-[A-Za-z0-9-]{10,}"), lambda m: True),
    "private_key": (re.compile("-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"), lambda m: True),
}
PIECES = [
    "token", "secret", "Password", "passwd", "api_key", "apikey", "API_KEY", "'", '"', " ", "  ", "=", ":", "abc", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "ghp_", "xoxb-",
    "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", " BLOCK", "é", "日本", ",", "\n", "a" * 23, "f" * 24, "+/_.=-", "x", "Z9" * 20, "ſecret", "toKen",
]


def plain_spans(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, (pattern, fits)) in enumerate(PLAIN.items()) for m in pattern.finditer(text or "") if fits(m)]
    return [(kind, begin, end) for begin, _, kind, end in sorted(found)]


def test_secrets_equal_regexes(spark, odd_docs, no_docs):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [None, "", "a" * 100_000, "token" + " " * 50_000 + "=abcdefg", "AKIA" * 20_000, "é" * 9 + "secret=token : abcdef", "secret:abcde token:abcdef", texts[0]]
    df = spark.createDataFrame([(i if i % 50 else None, t, i, "spans") for i, t in enumerate(texts)], "doc_id long, text string, id long, spans string")
    got = Counter((r.doc_id, tuple(tuple(s) for s in r.spans)) for r in secrets.scan(df).collect())
    assert got == Counter((i if i % 50 else None, tuple(plain_spans(t))) for i, t in enumerate(texts))
    assert secrets.scan(odd_docs).count() == odd_docs.count() and secrets.scan(no_docs).count() == 0
    masked = secrets.redacted(spark.createDataFrame([(1, "é token=abcdef, x"), (2, None), (3, "password=" + "a1" * 12), (4, "clean")], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in masked.collect()} == {1: "é [assign], x", 2: None, 3: "[assign]", 4: "clean"}


def test_patterns_equal_regexes():
    rng = random.Random(3)
    for pattern in ["a|bc+", "(ab|a)(c|bcd)", "a{2,4}b?", "[^a-c]x*y", "a.c", "(a|b){3}", r"\x61[\]a-]+", "a{0,2}c", "(ab){2,}c?"]:
        a = secrets.build((secrets.Rule("r", pattern),))
        extractor = secrets.Extractor(a)
        for _ in range(300):
            text = "".join(rng.choice("abcdxy]-") for _ in range(rng.randint(0, 14)))
            want, at = [], 0
            while at < len(text):
                ends = [e for e in range(len(text), at, -1) if re.fullmatch(pattern, text[at:e])]
                if ends:
                    want.append((0, at, ends[0]))
                at = ends[0] if ends else at + 1
            assert extractor.matches(text.encode()) == want, (pattern, text)
    for wrong in ("a*", "(a", "*a", "a)", "é", r"\d"):
        with pytest.raises(ValueError):
            secrets.build((secrets.Rule("r", wrong),))
