"""Queries that apply each corpus operator to its whole table, with the columns their contracts name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import balltree, bilinear, divergence, hilbert, jaccard, language, leaks, packing, repeats, secrets, urls, warc, whitening
from parlance.session import cut

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    dims = {"lang": F.col("lang"), "source": F.col("source"), "chars": F.col("n_chars").cast("double")}
    carry = {"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(F.encode(text, "UTF-8"))}
    placed = hilbert.hilbert_shards(docs, "doc_id", dims, shards=8, carry=carry, near=text)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


@query
def op3_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))
    finite = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    rows = table(spark, sf_dir, "embeddings").where(finite).select(F.col("vec_id").alias("id"), v.alias("v"))
    return balltree.top_k(rows, rows.where("id % 20 = 0"), 20, cut)


ORACLES["op3_ball_tree"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    verdict = urls.longest_rule(host, path, RULES, lambda r: r.verdict)
    model = urls.fit(pages.select("url", F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("label")))
    return urls.judge(pages, model, RULES, ["page_id"])


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


@query
def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(table(spark, sf_dir, "documents"), TOKENIZER)
    return packing.pack(pieces)


def fold(n: int):
    """The remainder that deals documents into folds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.fit(docs.where(fold(3) != 1))
    judged = language.identify(docs, found)
    return judged.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query
def op8_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.new_folder(spark)
    ranges = warc.write_index(warc.write_archives(pages, folder), folder)
    wanted = pages.select(warc.url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    records = warc.read_records(warc.lookup(wanted, folder, ranges), folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc_index"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id < latest THEN latest END AS refers_to FROM q"""


@query
def op7_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lm = bilinear.fit(docs.where(fold(5) != 1))
    scored = bilinear.score(docs, lm)
    return scored.select(
        "doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(lm.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query
def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    w = whitening.fit(vectors)
    # Values that all rows of a component share: at most four components.
    explained = F.create_map(*[F.lit(x) for i, e in enumerate(w.values.tolist(), 1) for x in (i, e / w.trace)]) if len(w.values) else F.create_map(F.lit(0), F.lit(0.0))
    white = whitening.transform(vectors, w)
    return white.select(
        F.col("id").alias("vec_id"), "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("component")].alias("explained"), F.lit(w.identity_error).alias("identity_error")
    )


@query
def op12_source_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


ORACLES["op12_source_stripes"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS n FROM kept GROUP BY lang),
g AS (SELECT q.lang, q.source, coalesce(l.v, 0) AS v, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) q
  LEFT JOIN l ON l.lang = q.lang LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL) t ON t.lang = q.lang AND t.source = q.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p,
    1 + (1000000000 * (k.total + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE count > 0 AND p > q),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10"""


@query
def op13_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["assign", "access", "hex"]
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of(k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed().alias("spans"))


def _secret_sql() -> str:
    """Matches and the pieces between them give the places; the patterns are those of the rules, with every letter of ``assign``'s names in both cases."""
    word = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join([word("password"), word("passwd"), word("secret"), word("token"), word("api") + "_?" + word("key")])
    use = f"""({names})[\"'']?\x20*[:=]\x20*[\"'']?"""
    kinds = [("assign", use + "[A-Za-z0-9+/_.=-]+", use + "[A-Za-z0-9+/_.=-]{6,}"), *[(r.kind, r.pattern, r.narrow or r.pattern) for r in secrets.RULES[1:]]]
    found = ", ".join(f"regexp_extract_all(t, '{p}') AS m{i}, regexp_split_to_array(t, '{p}') AS b{i}" for i, (_, p, _) in enumerate(kinds))
    lists = []
    for i, (kind, _, narrow) in enumerate(kinds):
        at = f"CAST(coalesce(list_sum(list_transform(b{i}[:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{i}[:k - 1], lambda x: length(x))), 0) AS BIGINT)"
        lists.append(f"list_transform(list_filter(generate_series(1, len(m{i})), lambda k: regexp_full_match(m{i}[k], '{narrow}')), lambda k: {{'s': {at}, 'o': {i}, 'kind': '{kind}', 'e': {at} + length(m{i}[k])}})")
    text = "array_to_string(list_transform(list_sort({}), lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"CAST(len(l{i}) AS BIGINT) AS n_{k}" for i, (k, _, _) in enumerate(kinds[:3]))
    every = "list_concat(" * (len(kinds) - 1) + "l0, " + "), ".join(f"l{i}" for i in range(1, len(kinds))) + ")"
    base = "list_concat(list_concat(l0, l1), l2)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {found} FROM d),
s AS (SELECT doc_id, {", ".join(f"{x} AS l{i}" for i, x in enumerate(lists))} FROM f)
SELECT doc_id, {counts}, sha256({text.format(base)}) AS base_sha256, {text.format(every)} AS spans FROM s"""


ORACLES["op13_secret_automaton"] = _secret_sql()
