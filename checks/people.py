"""Checked queries for speakers, profiles and vocabularies."""

from pyspark.sql import functions as F

from checks.adapters import PRELUDE
from checks.registry import check
from parlance.functions import text as tx
from parlance.operators import people as pp

AL = "aligned"
PRELUDE["centroid"] = ("", """
SELECT profile_id, list(m / nrm ORDER BY pos) AS centroid FROM (SELECT profile_id, pos, m, sqrt(sum(m * m) OVER (PARTITION BY profile_id)) AS nrm FROM (
 SELECT label AS profile_id, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2)) GROUP BY 1""")
PRELUDE["best"] = ("centroid", """
SELECT query_id, profile_id, sim FROM (SELECT e.vec_id AS query_id, c.profile_id, list_dot_product(e.embedding::DOUBLE[], c.centroid) AS sim,
 row_number() OVER (PARTITION BY e.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], c.centroid) DESC, c.profile_id) AS rk FROM embeddings e CROSS JOIN centroid c) WHERE rk = 1 AND sim >= 0.2""")


def samples(t):
    return t.table("embeddings").select("vec_id", F.col("label").alias("profile_id"), "embedding")


def best(t):
    q = t.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return pp.best_profile(q, pp.centroids(samples(t)), threshold=0.2)


@check("j11_profile_samples", "SELECT label AS profile_id, 'Person ' || label AS name, vec_id FROM embeddings")
def _(t):
    prof = samples(t).select("profile_id").distinct().withColumn("name", F.concat(F.lit("Person "), F.col("profile_id").cast("string")))
    return pp.profile_samples(prof, samples(t)).select("profile_id", "name", "vec_id")


@check("a24_profile_centroid", "SELECT profile_id, CAST(pos AS INT) AS pos, round(x, 5) AS x FROM (SELECT profile_id, unnest(centroid) AS x, generate_subscripts(centroid, 1) - 1 AS pos FROM centroid)", "centroid")
def _(t):
    return pp.centroids(samples(t)).select("profile_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 5))


@check("j12_best_profile", "SELECT query_id, profile_id, round(sim, 4) AS similarity FROM best", "best")
def _(t):
    return best(t).withColumn("similarity", F.round("similarity", 4))


@check("j13_apply_matches", """
SELECT meeting_id, ord, CASE WHEN hit AND meeting_type <> 'court_hearing' THEN 'Voice ' || speaker_id ELSE speaker_name END AS speaker_name,
 CASE WHEN hit AND meeting_type = 'court_hearing' THEN 'Voice ' || speaker_id ELSE suggested_speaker_name END AS suggested_speaker_name,
 CASE WHEN hit AND meeting_type = 'court_hearing' THEN round_even((meeting_id % 300) / 300.0::DOUBLE, 3) ELSE suggested_speaker_confidence END AS suggested_speaker_confidence
FROM (SELECT *, speaker_id = 'user' OR meeting_id % 2 = 0 AS hit FROM aligned)""", AL)
def _(t):
    m = t.aligned.where("speaker_id = 'user' or meeting_id % 2 = 0").select("meeting_id", "speaker_id").distinct()
    m = m.select("meeting_id", "speaker_id", F.concat(F.lit("Voice "), "speaker_id").alias("name"), (F.col("meeting_id") % 300 / F.lit(300.0)).alias("similarity"))
    return pp.apply_matches(t.aligned, m).select("meeting_id", "ord", "speaker_name", "suggested_speaker_name", "suggested_speaker_confidence")


@check("j14_match_counts", """
SELECT p.profile_id, CASE WHEN p.profile_id % 3 = 0 THEN 100 ELSE 0 END + coalesce(n, 0) AS match_count, greatest(CASE WHEN p.profile_id % 3 = 0 THEN 250 END, mx) AS last_used_at FROM (SELECT DISTINCT label AS profile_id FROM embeddings) p
LEFT JOIN (SELECT profile_id, count(*) AS n, max(query_id) AS mx FROM best GROUP BY 1) USING (profile_id)""", "best")
def _(t):
    third = F.col("profile_id") % 3 == 0
    prof = samples(t).select("profile_id").distinct().select("profile_id", F.when(third, F.lit(250).cast("bigint")).alias("last_used_at"), F.when(third, 100).otherwise(0).cast("bigint").alias("match_count"))
    return pp.update_match_counts(prof, best(t).withColumn("matched_at", F.col("query_id")))


PRELUDE["renames"] = ("aligned", "SELECT DISTINCT meeting_id, CASE meeting_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'Name assistant' ELSE 'nobody' END AS old_name, 'New ' || meeting_id AS new_name FROM aligned")


def renames(t):
    m = F.col("meeting_id")
    ids = t.table("conversations").select(F.col("conv_id").alias("meeting_id")).distinct()
    return ids.select(m, F.when(m % 3 == 0, "user").when(m % 3 == 1, "Name assistant").otherwise("nobody").alias("old_name"), F.concat(F.lit("New "), m.cast("string")).alias("new_name"))


@check("j15_rename_speakers", """
SELECT a.meeting_id, a.ord, a.speaker_id = r.old_name OR coalesce(a.speaker_name = r.old_name, false) AS renamed, CASE WHEN a.speaker_id = r.old_name OR a.speaker_name = r.old_name THEN r.new_name ELSE a.speaker_name END AS speaker_name
FROM aligned a JOIN renames r USING (meeting_id)""", "aligned renames")
def _(t):
    return pp.rename_speakers(t.aligned, renames(t)).select("meeting_id", "ord", "renamed", "speaker_name")


@check("j15_rename_counts", """
SELECT r.meeting_id, r.old_name, r.new_name, count(a.ord) AS n, count(a.ord) > 0 AS found FROM renames r LEFT JOIN aligned a ON a.meeting_id = r.meeting_id AND (a.speaker_id = r.old_name OR a.speaker_name = r.old_name) GROUP BY 1, 2, 3""", "aligned renames")
def _(t):
    return pp.rename_counts(t.aligned, renames(t))


PRELUDE["labels_in"] = ("segments", "SELECT meeting_id, ord, CASE ord % 4 WHEN 0 THEN 'SPEAKER_0' || ord % 3 WHEN 1 THEN 'speaker ' || ord % 7 WHEN 2 THEN 'see Speaker-' || ord % 5 || ' and SPEAKER_' || (ord % 20) ELSE ' Ann ' END AS raw FROM segments")


def labels_in(t):
    o = F.col("ord")
    s = lambda n: (o % n).cast("string")
    raw = (
        F.when(o % 4 == 0, F.concat(F.lit("SPEAKER_0"), s(3)))
        .when(o % 4 == 1, F.concat(F.lit("speaker "), s(7)))
        .when(o % 4 == 2, F.concat(F.lit("see Speaker-"), s(5), F.lit(" and SPEAKER_"), s(20)))
        .otherwise(" Ann ")
    )
    return t.segments.select("meeting_id", "ord", raw.alias("raw"))


@check("j17_resolve_labels", """
SELECT meeting_id, ord, CASE ord % 4 WHEN 0 THEN nm(ord % 3) WHEN 1 THEN nm(ord % 7) WHEN 2 THEN 'see ' || nm(ord % 5) || ' and ' || nm(ord % 20) ELSE 'Ann' END AS label FROM labels_in"""
       .replace("nm(ord % 3)", "CASE WHEN ord % 3 <= 1 THEN ['Ann A','Bob B'][ord % 3 + 1] ELSE 'Спикер #' || ord % 3 END")
       .replace("nm(ord % 7)", "CASE WHEN ord % 7 <= 1 THEN ['Ann A','Bob B'][ord % 7 + 1] ELSE 'Спикер #' || ord % 7 END")
       .replace("nm(ord % 5)", "CASE WHEN ord % 5 <= 1 THEN ['Ann A','Bob B'][ord % 5 + 1] ELSE 'Спикер #' || ord % 5 END")
       .replace("nm(ord % 20)", "CASE WHEN ord % 20 <= 1 THEN ['Ann A','Bob B'][ord % 20 + 1] ELSE 'Спикер #' || ord % 20 END"), "labels_in")
def _(t):
    m = pp.literal_map({"SPEAKER_00": "Ann A", "SPEAKER_01": "Bob B"})
    return labels_in(t).select("meeting_id", "ord", tx.resolve_label("raw", m).alias("label"))


@check("j18_validated_mapping", """
SELECT conv_id AS meeting_id, 'SPEAKER_0' || (turn % 10) AS speaker_key, 'Person ' || turn % 10 AS name FROM conversations WHERE turn % 4 <> 3""")
def _(t):
    c = t.table("conversations").withColumn("turn", F.col("turn") % 10)
    name = F.when(F.col("turn") % 4 == 3, F.lit("Stranger")).when(F.col("turn") % 2 == 0, F.concat(F.lit(" PERSON "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("person "), F.col("turn").cast("string")))
    pairs = c.select(F.col("conv_id").alias("meeting_id"), F.concat(F.lit("speaker_"), F.col("turn").cast("string")).alias("k"), name.alias("v"))
    body = pairs.groupBy("meeting_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    raw = F.when(F.col("meeting_id") % 2 == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("m").alias("mapping"))), F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), F.to_json("m"), F.lit(" done")))
    people = c.select(F.col("conv_id").alias("meeting_id"), F.concat(F.lit("Person "), F.col("turn").cast("string")).alias("attendee"), F.col("turn").alias("ord"))
    return pp.validated_mapping(body.select("meeting_id", raw.alias("raw")), people)


@check("j19_court_turns", """
SELECT meeting_id, ord, start_ms, trim(text) AS text, CASE WHEN speaker_name <> '' THEN speaker_name || ':' WHEN speaker_id = 'user' THEN 'Истец:' WHEN speaker_id = 'assistant' THEN 'Суд:' ELSE 'clerk:' END AS speaker FROM aligned""", AL)
def _(t):
    role = F.when(F.col("speaker_id") == "user", "Claimant").when(F.col("speaker_id") == "assistant", " judge: ").otherwise("clerk")
    roles = t.aligned.select("meeting_id", "speaker_id").distinct().withColumn("role", role)
    return pp.court_turns(t.aligned, roles)


DEPT_SQL = """
SELECT event_id, CASE k WHEN 0 THEN 'hr' WHEN 1 THEN 'finance' WHEN 2 THEN 'it' WHEN 3 THEN 'other' WHEN 4 THEN 'aho' WHEN 5 THEN 'other' ELSE 'pr_marketing' END AS slug FROM (SELECT event_id, event_id % 7 AS k FROM events)"""


@check("j20_department", DEPT_SQL)
def _(t):
    names = ["Отдел кадров компании", " FINANCE department", "ит-отдел", "", "Хозяйственный отдел", "Склад", "Marketing team"]
    raw = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 7 + 1).cast("int"))
    return t.table("events").select("event_id", pp.department_slug(raw).alias("slug"))


@check("o6_department_sections", """
SELECT m.meeting_id, d.slug, d.o AS display_order, coalesce(s.text, 'Нет') AS text FROM (SELECT DISTINCT meeting_id FROM segments) m CROSS JOIN (VALUES ('hr',10),('finance',20),('it',30),('pr_marketing',40),('iao',70),('aho',75),('other',99)) d(slug, o)
LEFT JOIN (SELECT meeting_id, ['hr','it','other'][ord % 3 + 1] AS slug, text FROM segments WHERE ord % 2 = 0) s ON s.meeting_id = m.meeting_id AND s.slug = d.slug""", "segments")
def _(t):
    slug = F.element_at(F.array(F.lit("hr"), F.lit("it"), F.lit("other")), (F.col("ord") % 3 + 1).cast("int"))
    items = t.segments.select("meeting_id", slug.alias("slug"), F.when(F.col("ord") % 2 == 0, F.col("text")).alias("text"), "ord")
    keep = items.where("text is not null")
    ids = items.select("meeting_id").distinct()
    out = pp.sections_by_department(keep.unionByName(ids.select("meeting_id", F.lit("none").alias("slug"), F.lit("x").alias("text"), F.lit(0).cast("bigint").alias("ord"))))
    return out.select("meeting_id", "slug", "display_order", "text")


@check("j25_term_hits", """
SELECT meeting_id, term, CAST(sum((length(x) - length(replace(x, lower(term), ''))) // length(term)) AS BIGINT) AS n, sum((length(x) - length(replace(x, lower(term), ''))) // length(term)) > 0 AS found
FROM (SELECT meeting_id, replace(lower(text), 'ß', 'ss') AS x FROM segments), (VALUES ('An'), ('ING the'), ('que'), ('zzz')) v(term) GROUP BY 1, 2""", "segments")
def _(t):
    ids = t.table("conversations").select(F.col("conv_id").alias("meeting_id")).distinct()
    terms = ids.select("meeting_id", F.explode(F.array(*[F.lit(x) for x in ("An", "ING the", "que", "zzz")])).alias("term"))
    return pp.term_hits(t.segments, terms)


@check("j27_enriched_vocabulary", """
SELECT name, 0 AS source FROM (SELECT DISTINCT c_mktsegment AS name FROM customer) UNION ALL
SELECT arg_min(p, o) AS name, 1 AS source FROM (SELECT trim(p_brand) AS p, p_partkey AS o FROM part UNION ALL SELECT upper(n) AS p, 1000000000 AS o FROM (SELECT DISTINCT c_mktsegment AS n FROM customer))
WHERE lower(p) NOT IN (SELECT lower(c_mktsegment) FROM customer) GROUP BY lower(p)""")
def _(t):
    emp = t.table("customer").select(F.col("c_mktsegment").alias("name")).distinct().withColumn("ord", F.lit(0).cast("long"))
    prof = t.table("part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("ord")).union(emp.select(F.upper("name"), F.lit(1000000000).cast("long")))
    return pp.enriched_vocabulary(emp, prof).select("name", "source")


@check("u3_distinct_terms", r"""
SELECT doc_id, arg_min(term, pos) AS term FROM (SELECT doc_id, trim(t) AS term, pos FROM (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[,;\n\r]+') AS ps FROM documents)))
WHERE term <> '' GROUP BY doc_id, replace(lower(term), 'ß', 'ss')""")
def _(t):
    return pp.distinct_terms(t.table("documents"), ["doc_id"], "text").select("doc_id", "term")


@check("u6_vocabulary_sections", """
SELECT event_id, event_type AS section, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS INT) AS section_rank FROM events WHERE event_type IN ('view','click','error')""")
def _(t):
    v = t.table("events").select("event_id", F.col("event_type").alias("section"))
    return pp.vocabulary_for_type(v, ["view", "click", "error"])


@check("w9_packed_prompt", """
SELECT lang, 'Имена и термины: ' || string_agg(term, ', ' ORDER BY o) || '.' AS prompt FROM (SELECT *, sum(length(term) + CASE WHEN rn > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY lang ORDER BY o) AS used FROM (
 SELECT *, row_number() OVER (PARTITION BY lang ORDER BY o) AS rn FROM (SELECT lang, lower(trim(w)) AS k, arg_min(trim(w), doc_id * 100000 + pos) AS term, min(doc_id * 100000 + pos) AS o FROM (
  SELECT lang, doc_id, unnest(ps) AS w, generate_subscripts(ps, 1) AS pos FROM (SELECT lang, doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ps FROM documents)) WHERE trim(w) <> '' GROUP BY 1, 2))) WHERE used <= 800 GROUP BY lang""")
def _(t):
    w = t.table("documents").select("lang", F.col("doc_id").alias("section_rank"), F.posexplode(F.split(F.translate("text", "\n", " "), " ")).alias("pos", "term"))
    return pp.packed_prompt(w, ["lang"])
