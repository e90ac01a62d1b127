"""Language, repeats, leaks, scores, packing and the Jaccard join against plain loops, on odd rows and on empty tables."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain_text import prose, words

from parlance.llm import bilinear, jaccard, language, leaks, packing, repeats

SF = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def plain_components(texts):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    for d in sets:
        for e, both in Counter(e for s in sets[d] for e in holders[s]).items():
            if e > d and 100 * both >= 75 * (len(sets[d]) + len(sets[e]) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("dense", [64, 2])
def test_jaccard_equals_loops(docs, texts, monkeypatch, dense):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "SIDE", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == plain_components(texts)


def chain(n, step):
    """Texts whose neighbours link while far ones do not: each drops words at one end and adds some at the other."""
    w = prose(50, 400 + n * step).split()
    return {1000 + k: " ".join(w[k * step : k * step + 300]) for k in range(n)}


@pytest.mark.parametrize("dense", [64, 3])
def test_jaccard_chains_and_hubs(spark, monkeypatch, dense):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "SIDE", 8)
    texts = chain(30, 25)
    hub = prose(60, 240).split()
    for k in range(40):  # copies of one original with edits of their own
        own = list(hub)
        own[3 + 5 * (k % 40)] = f"edit{k}"
        own[120 + k % 90] = f"more{k}"
        texts[2000 + k] = " ".join(own)
    for k in range(30):  # one common passage in unlike texts
        texts[3000 + k] = prose(70, 45) + " " + prose(100 + k, 60)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == plain_components(texts)


def test_jaccard_odd_rows(odd_docs, no_docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    at = {d: (n, c) for d, n, c in got if d is not None}
    assert {d: at[d][1] for d in (0, 1, 2, 3)} == {0: 0, 1: 0, 2: 0, 3: 0}
    assert at[4] == (0, 4) and at[5] == (0, 5) and at[7] == (1, 7) and at[8] == (1, 7) and at[10][1] == 9
    assert jaccard.jaccard_components(no_docs).count() == 0


def plain_repeats(texts, size=50):
    held = defaultdict(set)
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - size + 1):
            held[tuple(w[i : i + size])].add(d)
    out = defaultdict(set)
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - size + 1):
            if len(held[tuple(w[i : i + size])]) > 1:
                out[d] |= set(range(i, i + size))
    return out


def covered(spans):
    out = defaultdict(set)
    for r in spans.collect():
        out[r.doc_id] |= set(range(r.start_word, r.end_word))
    return out


def test_repeats_equal_loops(docs, texts):
    spans = repeats.repeated_spans(docs)
    assert covered(spans) == plain_repeats(texts)
    left = {r.doc_id: r.text for r in repeats.drop_repeats(docs, spans).collect()}
    # Nothing repeats any more but what cuts have joined, every first holder keeps its text, and documents without repeats are untouched.
    spanned = covered(spans)
    assert all(left[d] == t for d, t in texts.items() if d not in spanned)
    borrowed = {r.doc_id for r in spans.where("not own").collect()}
    assert all(left[d] == texts[d] for d in spanned if d not in borrowed)


def test_repeats_odd_rows(odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    spans = repeats.repeated_spans(odd_docs)
    assert covered(spans) == plain_repeats(texts)
    kept = repeats.drop_repeats(odd_docs, spans)
    assert kept.columns == odd_docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {4, 5, 6, 13} <= ids and 1 not in ids and 0 in ids
    assert repeats.repeated_spans(no_docs).count() == 0


def test_language_held_out_and_odd_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3)"
    found = language.fit(docs.where(f"{fold} <> 1"))
    judged = language.identify(docs, found).join(docs.select("doc_id", "lang"), "doc_id").where(f"{fold} = 1").toPandas()
    assert (judged["lang_pred"] == judged["lang"]).mean() > 0.97 and judged["score"].between(0, 1).all() and judged["rejected"].mean() < 0.02
    odd = {r.doc_id: r for r in language.identify(odd_docs, found).collect()}
    assert all(odd[d].lang_pred == "und" and odd[d].rejected and odd[d].score == 0 for d in (4, 5, 6, 15)) and odd[7].lang_pred != "und"
    assert language.identify(no_docs, found).count() == 0
    none = language.fit(no_docs)
    assert {r.lang_pred for r in language.identify(odd_docs, none).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    code, place, _ = language.characters(["the cat sat on the mat and the dog sat on the log"])
    rows = np.stack([code[place - 4 + j] for j in range(5)], axis=1)
    kinds, n = np.unique(rows, axis=0, return_counts=True)
    model = language.kneser_ney(kinds, n)
    letters = np.unique(code)
    for history in ("at o", "zzzz", " the"):
        at = np.array([[*map(ord, history), c] for c in letters], np.uint32)
        total = sum(2 ** model.log2(row, np.array([4]))[0] for row in at)
        # One more share belongs to characters never seen.
        assert total < 1 + 1e-9 and total > 0.8


def test_leaks_find_passages_and_paraphrases(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = {r.item_id: words(r.text) for r in bench.collect()}
    held = {(r.doc_id, i) for r in docs.collect() for i, w in items.items() if " ".join(w) in " ".join(words(r.text))}
    item = max(items, key=lambda i: len(items[i]))
    changed = [f"other{j}" if j % 6 == 2 else x for j, x in enumerate(items[item])]
    extra = spark.createDataFrame([(10**6, prose(80, 150) + " " + " ".join(changed) + " " + prose(81, 99)), (10**6 + 1, prose(82, 300)), (None, None), (7, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs.unionByName(extra), bench).collect()}
    assert len(held & got) >= 0.9 * len(held) and (10**6, item) in got
    assert not {d for d, _ in got} - {d for d, _ in held} - {10**6}
    assert leaks.leaks(no_docs, bench).count() == 0
    assert leaks.leaks(odd_docs, bench.limit(0)).count() == 0
    assert leaks.leaks(odd_docs, bench).columns == ["doc_id", "item_id", "cosine", "share", "start_word", "end_word"]


def test_leaks_find_paraphrases_of_the_rarest_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    df = Counter(x for r in docs.collect() for x in set(words(r.text)))
    rows = []
    for r in bench.collect():
        w = words(r.text)
        body = range(len(w) - 6) if len(w) > 12 else range(len(w))
        swapped = set(sorted(body, key=lambda j: (df[w[j]], j))[: len(w) - math.ceil(leaks.COMMON * len(w))])
        text = " ".join(f"other{r.item_id}x{j}" if j in swapped else x for j, x in enumerate(w))
        rows.append((10**6 + r.item_id, prose(r.item_id, 30 + r.item_id % 40) + " " + text + " " + prose(300 + r.item_id, 70)))
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect()}
    missed = {d - 10**6 for d, _ in rows} - {i for d, i in got if d == 10**6 + i}
    assert not missed, sorted(missed)


def finder_of(spark, docs, bench):
    rows = docs.select(docs.doc_id.alias("id"), "text")
    weights = leaks.inverse_frequencies(rows)
    items = bench.orderBy("item_id").collect()
    basis = leaks.latent_space(rows.select("text").unionByName(bench.select("text")), weights)
    return leaks.Finder([r.item_id for r in items], [r.text for r in items], weights, basis)


def test_recall_of_the_cosine_stage(spark):
    """Alone, without the search for rare words: passages with every sixth word changed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    finder = finder_of(spark, docs, bench)
    none = np.zeros(0, np.int64)
    finder.rarest = lambda w, known: (none, none, none, none)
    found, asked = 0, 0
    for r in bench.collect():
        w = words(r.text)
        text = " ".join(f"other{j}" if j % 6 == 2 and j < len(w) - 6 else x for j, x in enumerate(w))
        found += any(i == r.item_id for _, i, *_ in finder.search(leaks.find_words(leaks.pa.array([prose(r.item_id, 45) + " " + text + " " + prose(300 + r.item_id, 70)]))))
        asked += 1
    assert found >= 0.97 * asked, (found, asked)


def test_leaks_do_not_depend_on_the_latent_space(spark):
    """A space in which nothing is near finds the same."""
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").where("item_id % 20 = 3")
    items = bench.collect()
    finder = leaks.Finder([r.item_id for r in items], [r.text for r in items], np.ones(leaks.BUCKETS), np.zeros((leaks.BUCKETS, 2)))
    for r in items:
        text = prose(r.item_id, 60) + " " + r.text + " " + prose(400 + r.item_id, 60)
        assert r.item_id in {i for _, i, *_ in finder.search(leaks.find_words(leaks.pa.array([text])))}


def test_leaks_equal_exhaustive_search():
    """Every stretch of every text against every item, with inserted, changed and moved words."""
    rng = np.random.default_rng(4)
    common = [f"c{i}" for i in range(30)]
    items = [" ".join(rng.choice(common) if rng.random() < 0.5 else f"r{k}x{j}" for j in range(n)) for k, n in enumerate((5, 9, 15, 24, 40, 70))]
    texts = []
    for t in items * 12:
        w = [f"z{rng.integers(10**6)}" if rng.random() < 0.25 else x for x in t.split()]
        for _ in range(len(w) // 4):
            w.insert(int(rng.integers(len(w) + 1)), str(rng.choice(common)))
        texts.append(" ".join([*rng.choice(common, 40).tolist(), *w, *rng.choice(common, 33).tolist()]))
    finder = leaks.Finder(list(range(len(items))), items, np.ones(leaks.BUCKETS), np.zeros((leaks.BUCKETS, 2)))
    found = {(d, i) for d, i, *_ in finder.search(leaks.find_words(leaks.pa.array(texts)))}
    expected = set()
    for d, t in enumerate(texts):
        h = leaks.find_words(leaks.pa.array([t])).hash
        for i, mine in enumerate(finder.words):
            need, span = math.ceil(leaks.COMMON * len(mine)), int(math.ceil(leaks.COMMON * len(mine)) / leaks.DENSITY + 1e-9)
            for s in range(len(h)):
                p = leaks.common_subsequence(mine.tolist(), h[s : s + span])
                if len(p) >= need and len(leaks.common_subsequence(mine[-leaks.ANSWER :].tolist(), h[s + p[0] : s + span])) >= leaks.ANSWER_COMMON * min(len(mine), leaks.ANSWER):
                    expected.add((d, i))
                    break
    assert expected <= found and len(expected) > 20, (len(expected), sorted(expected - found))


@pytest.mark.parametrize("held", [1 << 18, 200])
def test_scores_equal_loops(spark, docs, texts, monkeypatch, held):
    monkeypatch.setattr(bilinear, "HELD", held)
    lm = bilinear.fit(docs.where("doc_id % 5 <> 1"))
    tokens = {d: [*words(t), None] for d, t in texts.items()}
    c = Counter(x for d, w in tokens.items() if d % 5 != 1 for x in w)
    norm = sum(c.values()) + 0.5 * (len(c) + 1)
    assert (lm.tokens, lm.kinds) == (sum(c.values()), len(c))
    got = bilinear.score(docs, lm).collect()
    for r in got:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w))
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / norm) for x in w), rel_tol=1e-9)
    # Scores from the parameters, word by word.
    shape, x = lm.shape, lm.params.astype(float)
    q, r, w0, p, last = shape.starts
    d = bilinear.DIM
    kinds = bilinear.find_words(bilinear.pa.array([" ".join(k for k in c if k)]))
    number = dict(zip([k for k in c if k], shape.tokens(kinds)[0][:-1].tolist(), strict=True))
    suffix = lambda k: shape.n + int(bilinear.suffix_class(bilinear.find_words(bilinear.pa.array([k])))[0])
    rare_n, rare_v = Counter(), Counter()
    for k, n in c.items():
        if k and number[k] >= shape.n:
            rare_n[number[k]] += n
            rare_v[number[k]] += 1
    soft = lambda z: z - z.max() - math.log(np.exp(z - z.max()).sum())
    assert shape.n == bilinear.ROOTS * math.isqrt(len(c) - 1) if held > 1000 else shape.n <= bilinear.ROOTS * math.isqrt(len(c) - 1)
    better = []
    for r_ in got:
        one = two = shape.end
        total = 0.0
        for k in tokens[r_.doc_id]:
            t = shape.end if k is None else number[k] if k in number else suffix(k)
            h = x[one, :d] @ x[w0:p, :d] + x[two, :d] @ x[p:last, :d]
            own = int(shape.class_of(np.array([t]))[0])
            total += soft(x[q:r, :d] @ h + x[q:r, d])[own]
            if t < shape.n:
                low = own * shape.size
                rows = x[r + low : r + min(low + shape.size, shape.n)]
                total += soft(rows[:, :d] @ h + rows[:, d])[t - low]
            elif k is not None:
                total += math.log((c[k] + 0.5) / (rare_n[t] + 0.5 * (rare_v[t] + 1)))
            one, two = t, one
        assert math.isclose(r_.score, total / math.log(10), rel_tol=1e-3), r_.doc_id
        if r_.doc_id % 5 == 1:
            better.append(r_.score > r_.base_score)


def test_scores_of_odd_rows(odd_docs, no_docs, monkeypatch):
    lm = bilinear.fit(odd_docs)
    got = bilinear.score(odd_docs, lm).collect()
    assert len(got) == odd_docs.count() and all(r.n_tokens == 1 for r in got if r.doc_id in (4, 5, 6)) and all(math.isfinite(r.score) for r in got)
    assert bilinear.score(no_docs, lm).count() == 0
    none = bilinear.fit(no_docs)
    assert all(r.base_score == 0 or r.n_known == 0 for r in bilinear.score(odd_docs, none).collect())


def check_packing(rows, texts, window=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in texts.items()}
    seen, places = defaultdict(set), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        spot = set(range(r.start, r.start + r.length))
        assert not spot & seen[r.doc_id]
        seen[r.doc_id] |= spot
        places[r.sequence_id].append((r.offset, r.length))
    assert all(len(seen[d]) == len(ids[d]) for d in texts)
    assert sorted(places) == list(range(len(places)))
    for spots in places.values():
        at = 0
        for offset, n in sorted(spots):
            assert offset == at
            at += n
        assert at <= window
    return sum(map(len, ids.values())), len(places)


def test_packing_is_an_exact_round_trip(docs, texts):
    total, n = check_packing(packing.pack(packing.pieces_of(docs, TOKENIZER)).collect(), texts)
    assert n * 2048 < 1.05 * total


def test_packing_odd_rows(odd_docs, no_docs):
    tricky = {r.doc_id: r.text for r in odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    tricky[14] = "Ünï<|endoftext|>x don't re-do it's 'll e\u0301 \u00a0a\u2003b a- a-. a-b a-b. x. x.. X, .x, 5, ... , <|x <|startoftext|> İI"
    df = odd_docs.sparkSession.createDataFrame(list(tricky.items()), "doc_id long, text string")
    check_packing(packing.pack(packing.pieces_of(df, TOKENIZER)).collect(), tricky)
    assert packing.pack(packing.pieces_of(odd_docs, TOKENIZER)).where("doc_id = 2").selectExpr("sum(length)").first()[0] == 2 * (len(packing_ids(tricky[2])) + 1)
    assert packing.pack(packing.pieces_of(no_docs, TOKENIZER)).count() == 0


def packing_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_packing_letters_that_compose_to_letter_and_mark():
    letters = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and not unicodedata.normalize("NFC", chr(c).lower()).isalpha()]
    assert len(letters) >= 59
    text = "hello " + " ".join(f"स{x}क {x}, {x}" for x in letters) + " road ends"
    ids, _ = packing.token_ids(packing.pa.array([text]), TOKENIZER)
    assert ids[:-1].tolist() == packing_ids(text)
    # Blocks of words that don't end once each are encoded word by word.
    coder = packing.WordIds(TOKENIZER)
    coder._learn([f"स{x}क".encode() for x in letters] + [b"hello", b"road"], [])
    assert coder.count[-2:].tolist() == [len(packing_ids("hello")), len(packing_ids("road"))]
    assert coder.count.sum() == len(packing_ids(" ".join([*(f"स{x}क" for x in letters), "hello", "road"])))


def test_packing_encodes_letters_and_what_follows_them_once(monkeypatch):
    monkeypatch.setattr(packing, "_WORKER", {})
    cores = [f"{a}or{b}" for a in "bcdfgéñß" for b in "lmnpqr"]
    tails = ["", ".", "!!", "***", ".$$$", ",%%%", "'", "|>"]
    for case in (str.lower, str.upper):
        text = " ".join(case(c) + t for c in cores for t in tails)
        ids, _ = packing.token_ids(packing.pa.array([text]), TOKENIZER)
        assert ids[:-1].tolist() == packing_ids(text)
    # Each of the letters in both cases of those beyond a-z, and each tail: not their products.
    assert len(packing._WORKER[TOKENIZER].count) <= 2 * len(cores) + len(tails)


def test_packing_tells_words_with_control_bytes_apart(monkeypatch):
    monkeypatch.setattr(packing, "_WORKER", {})
    texts = ["5 \x005 a5. \x00a5. \x00a \x00 a", None, "—. a—. \u0338. é\u0338. ...", "", "<|endoftext|>. a<|endoftext|>| 's a's 's."]
    for bound in (1 << 20, 0):  # remembered; forgotten before each call
        monkeypatch.setattr(packing, "REMEMBERED", bound)
        for _ in range(2):
            ids, bounds = packing.token_ids(packing.pa.array(texts), TOKENIZER)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [packing_ids(t or "") + [1] for t in texts]


def test_packing_added_tokens_in_other_cases(monkeypatch):
    words = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "A<|endoftext|>", "a<|ENDOFTEXT|>", "a<|endoftext|>.", "X5", "x5", "<|startofTEXT|><|startoftext|>"]
    for order in (words, words[::-1]):
        monkeypatch.setattr(packing, "_WORKER", {})
        for texts in ([" ".join(order)], order):
            ids, bounds = packing.token_ids(packing.pa.array(texts), TOKENIZER)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [packing_ids(t) + [1] for t in texts]


def test_packing_word_table_at_size():
    coder, rng = packing.WordIds(TOKENIZER), np.random.default_rng(8)
    known = {}
    for _ in range(40):
        letters = rng.integers(97, 101, 6 * 500).astype(np.uint8)
        start = np.arange(0, len(letters), 6)
        # Few different low bits: the places that words ask for meet.
        hashes = np.array([int.from_bytes(letters[a : a + 6].tobytes(), "big") << 10 for a in start], np.uint64)
        number = coder.of(letters.tobytes(), start, start + 6, hashes)
        for h, n in zip(hashes.tolist(), number.tolist(), strict=True):
            assert known.setdefault(h, n) == n
    assert sorted(known.values()) == list(range(len(coder.count)))


def test_plan_uses_up_any_histogram():
    rng = np.random.default_rng(3)
    for _ in range(5):
        h = np.zeros(65, np.int64)
        h[1:] = rng.integers(0, 50, 64)
        used = np.zeros_like(h)
        for combo, times in packing.plan(h):
            assert sum(combo) <= 64 and times > 0
            for size in combo:
                used[size] += times
        assert (used == h).all()
