"""Speakers, voice profiles, names and vocabularies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators.ordered import joined_text

MATCH_THRESHOLD = 0.7
CENTROIDS_PER_BLOCK = 1024
QUERIES_PER_TASK = 20_000

# Display forms of court roles.
ROLE_DISPLAY = {
    "суд": "Суд:", "court": "Суд:", "judge": "Суд:", "истец": "Истец:", "claimant": "Истец:", "ответчик": "Ответчик:", "defendant": "Ответчик:",
    "представитель истца": "Представитель истца:", "представитель ответчика": "Представитель ответчика:", "третье лицо": "Третье лицо:",
    "мужской голос": "М. Голос:", "male voice": "М. Голос:", "женский голос": "Ж. Голос:", "female voice": "Ж. Голос:",
}

# Departments in order (slug, short name, display name, display order, aliases).
DEPARTMENTS = [
    ("hr", "HR", "HR-отдел", 10, ["HR", "HR отдел", "HR-отдел", "Отдел HR", "Кадры", "Отдел кадров", "Кадровый отдел", "Human Resources", "HR department"]),
    ("finance", "Финансы", "Финансовый отдел", 20, ["Финансы", "Финансовый отдел", "Финансовое", "Финансовое управление", "Бухгалтерия", "Finance", "Finance department", "Financial department"]),
    ("it", "ИТ", "Отдел ИТ", 30, ["ИТ", "IT", "Отдел ИТ", "Отдел IT", "ИТ-отдел", "IT department", "Information technology", "Технический отдел"]),
    ("pr_marketing", "PR", "PR и маркетинг", 40, ["PR", "PR и маркетинг", "Маркетинг", "PR-отдел", "PR department", "Marketing", "Marketing department", "PR & Marketing"]),
    ("iao", "ИАО", "ИАО (Информационно-аналитический отдел)", 70, ["ИАО", "IAO", "Информационно-аналитический отдел", "Информационно-аналитический", "Information and Analytical Department"]),
    ("aho", "АХО", "АХО (Административно-хозяйственный отдел)", 75, ["АХО", "AHO", "Административно-хозяйственный отдел", "Административно-хозяйственный", "Administrative and Economic Department", "Хозяйственный отдел"]),
    ("other", "Прочее", "Прочее", 99, ["Прочее", "Other", "Другое", "Разное", "Miscellaneous", "Прочие вопросы"]),
]


def profile_samples(profiles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Profiles with their embedding samples."""
    return profiles.join(embeddings, "profile_id")


def centroids(samples: DataFrame, vec: str = "embedding") -> DataFrame:
    """Element-wise mean per profile, scaled to unit length (a zero mean stays zero)."""
    dims = samples.select("profile_id", F.posexplode(vec).alias("pos", "x")).groupBy("profile_id", "pos").agg(F.avg("x").alias("m"))
    packed = dims.groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return packed.withColumn("norm", norm).select(
        "profile_id", F.transform("mean", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias("centroid")
    )


def best_profile(queries: DataFrame, profiles: DataFrame, key: str = "query_id", threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """The profile with the largest dot product per query vector, kept from ``threshold`` on.

    Profiles are cut into blocks and queries into shares, both of bounded size; each (block, share) task multiplies
    two small matrices and returns one best profile per query, so pairs never become rows.  The two counts that
    size the grid read one narrow column each.
    """
    n_blocks = max(1, math.ceil(profiles.count() / CENTROIDS_PER_BLOCK))
    n_shares = max(1, math.ceil(queries.count() / QUERIES_PER_TASK))
    kind = dict(queries.dtypes)[key]
    pid = dict(profiles.dtypes)["profile_id"]
    q = queries.select(key, F.col("embedding").cast("array<double>").alias("vec"), F.pmod(F.xxhash64(key), F.lit(n_shares)).alias("share"))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    c = profiles.select("profile_id", F.col("centroid").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("profile_id"), F.lit(n_blocks)).cast("int").alias("block"))
    c = c.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shares - 1).cast("long"))))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({key: [], "profile_id": [], "similarity": []})
        right = right.sort_values("profile_id", kind="stable")
        sims = np.vstack(left["vec"].to_numpy()) @ np.vstack(right["vec"].to_numpy()).T
        at = sims.argmax(axis=1)
        return pd.DataFrame({key: left[key].to_numpy(), "profile_id": right["profile_id"].to_numpy()[at], "similarity": sims[np.arange(len(at)), at]})

    cells = q.groupBy("block", "share").cogroup(c.groupBy("block", "share")).applyInPandas(score, f"`{key}` {kind}, profile_id {pid}, similarity double")
    best = cells.groupBy(key).agg(F.min_by(F.struct("profile_id", "similarity"), F.struct(-F.col("similarity"), F.col("profile_id"))).alias("b"))
    return best.select(key, "b.*").where(F.col("similarity") >= threshold)


def apply_matches(aligned: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched speakers get their name; in court hearings it is only suggested."""
    m = matches.select("meeting_id", "speaker_id", F.col("name").alias("_name"), "similarity")
    court = (F.col("meeting_type") == "court_hearing") & F.col("_name").isNotNull()
    other = (F.col("meeting_type") != "court_hearing") & F.col("_name").isNotNull()
    return (
        aligned.join(m, ["meeting_id", "speaker_id"], "left")
        .withColumns(
            {
                "suggested_speaker_name": F.when(court, F.col("_name")).otherwise(F.col("suggested_speaker_name")),
                "suggested_speaker_confidence": F.when(court, F.bround("similarity", 3)).otherwise(F.col("suggested_speaker_confidence")),
                "speaker_name": F.when(other, F.col("_name")).otherwise(F.col("speaker_name")),
            }
        )
        .drop("_name", "similarity")
    )


def update_match_counts(profiles: DataFrame, matches: DataFrame) -> DataFrame:
    """Last use and match count per profile after a batch of matches."""
    seen = matches.groupBy("profile_id").agg(F.max("matched_at").alias("_last"), F.count("*").alias("_n"))
    return (
        profiles.join(seen, "profile_id", "left")
        .withColumns({"last_used_at": F.greatest("last_used_at", "_last"), "match_count": F.coalesce("match_count", F.lit(0)) + F.coalesce("_n", F.lit(0))})
        .drop("_last", "_n")
    )


def rename_speakers(aligned: DataFrame, renames: DataFrame) -> DataFrame:
    """Rows whose id or name equals ``old_name`` get ``new_name``; ``renamed`` marks them."""
    r = renames.select("meeting_id", "old_name", F.trim("new_name").alias("new_name"))
    by_id = r.select("meeting_id", F.col("old_name").alias("speaker_id"), F.col("new_name").alias("_by_id"))
    by_name = r.select("meeting_id", F.col("old_name").alias("speaker_name"), F.col("new_name").alias("_by_name"))
    out = aligned.join(by_id, ["meeting_id", "speaker_id"], "left").join(by_name, ["meeting_id", "speaker_name"], "left")
    hit = F.coalesce("_by_id", "_by_name")
    return out.withColumns({"renamed": hit.isNotNull(), "speaker_name": F.coalesce(hit, "speaker_name")}).drop("_by_id", "_by_name")


def rename_counts(aligned: DataFrame, renames: DataFrame) -> DataFrame:
    """Rows touched by each rename; ``found`` is false where the speaker does not occur."""
    both = F.array_distinct(F.array_compact(F.array("speaker_id", "speaker_name")))
    per = aligned.select("meeting_id", F.explode(both).alias("old_name")).groupBy("meeting_id", "old_name").agg(F.count("*").alias("n"))
    return renames.join(per, ["meeting_id", "old_name"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("found", F.col("n") > 0)


def mapping_per_meeting(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """One map per meeting from (key, value) rows; a later row of the same key wins."""
    last = pairs.groupBy("meeting_id", key).agg(F.max_by(value, "pos").alias(value))
    return last.groupBy("meeting_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("mapping"))


def rewrite_fields(items: Column, fields: list[str], change) -> Column:
    """Apply ``change`` to the named string fields of every struct of an array column."""

    def one(s: Column) -> Column:
        for f in fields:
            s = s.withField(f, change(s[f]))
        return s

    return F.transform(items, one)


NESTED_NAMES = {"items": ["speaker", "owner"], "decisions": ["speaker"], "open_questions": ["speaker"], "risks": ["speaker"], "tasks": ["owner"], "turns": ["speaker"]}


def rename_in_protocols(protocols: DataFrame, renames: DataFrame) -> DataFrame:
    """The same rename inside participants, turns and item lists of protocol rows."""
    maps = mapping_per_meeting(renames.withColumn("pos", F.lit(0)), "old_name", "new_name")
    df = protocols.join(maps, "meeting_id", "left")
    change = lambda c: F.coalesce(F.try_element_at(F.col("mapping"), c), c)
    cols = {n: rewrite_fields(F.col(n), f, change) for n, f in NESTED_NAMES.items() if n in protocols.columns}
    if "participants" in protocols.columns:
        cols["participants"] = F.transform("participants", change)
    if "departments" in protocols.columns:
        inner = lambda d: d.withField("decisions", rewrite_fields(d["decisions"], ["speaker"], change)).withField(
            "tasks", rewrite_fields(d["tasks"], ["speaker"], change)
        ).withField("open_issues", rewrite_fields(d["open_issues"], ["speaker"], change))
        cols["departments"] = F.transform("departments", inner)
    return df.withColumns({n: F.when(F.col("mapping").isNotNull(), c).otherwise(F.col(n)) for n, c in cols.items()}).drop("mapping")


def resolve_in_protocols(protocols: DataFrame, maps: DataFrame) -> DataFrame:
    """J17 on nested fields: every speaker and owner of a protocol row goes through ``resolve_label``."""
    df = protocols.join(maps, "meeting_id", "left").withColumn("mapping", F.coalesce("mapping", F.create_map().cast("map<string,string>")))
    change = lambda c: tx.resolve_label(c, F.col("mapping"))
    fields = {**NESTED_NAMES, "tasks": ["owner", "speaker"]}
    cols = {}
    for n, wanted in fields.items():
        if n in protocols.columns:
            have = protocols.schema[n].dataType.elementType.fieldNames()
            cols[n] = rewrite_fields(F.col(n), [f for f in wanted if f in have], change)
    if "participants" in protocols.columns:
        cols["participants"] = F.transform("participants", change)
    return df.withColumns(cols).drop("mapping")


def validated_mapping(replies: DataFrame, attendees: DataFrame) -> DataFrame:
    """Label -> attendee pairs of a reply; only listed attendees count, in their listed spelling."""
    from parlance.functions.json import recover_object

    obj = recover_object("raw")
    nested = F.get_json_object(obj, "$.mapping")
    body = F.when(nested.startswith("{"), nested).otherwise(obj)
    pairs = replies.select("meeting_id", F.posexplode(F.map_entries(F.from_json(body, "map<string,string>"))).alias("pos", "e"))
    pairs = pairs.select("meeting_id", "pos", F.col("e.key").alias("label"), tx.strip("e.value").alias("name"))
    pairs = pairs.where(tx.is_speaker_label("label") & (F.col("name") != "") & ~F.lower("name").isin("null", "none", "нет"))
    known = attendees.groupBy("meeting_id", F.lower("attendee").alias("_k")).agg(F.max_by("attendee", "ord").alias("canonical"))
    hit = pairs.join(known, (pairs.meeting_id == known.meeting_id) & (F.lower("name") == known["_k"])).select(
        pairs.meeting_id, "pos", tx.speaker_key("label").alias("speaker_key"), "canonical"
    )
    return hit.groupBy("meeting_id", "speaker_key").agg(F.max_by("canonical", "pos").alias("name"))


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def role_label(raw: Column) -> Column:
    """Display form of a role; unknown labels get a colon."""
    bare = tx.strip(F.regexp_replace(tx.strip(F.coalesce(raw, F.lit(""))), ":+$", ""))
    return F.when(bare == "", F.lit("")).otherwise(F.coalesce(F.try_element_at(literal_map(ROLE_DISPLAY), F.lower(bare)), F.concat(bare, F.lit(":"))))


def court_turns(aligned: DataFrame, roles: DataFrame) -> DataFrame:
    """Turns labelled by name, else the reply's role of the speaker, else the id."""
    r = roles.select("meeting_id", "speaker_id", F.col("role").alias("_role"))
    present = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    out = aligned.where(tx.strip(F.coalesce("text", F.lit(""))) != "").join(r, ["meeting_id", "speaker_id"], "left")
    label = F.coalesce(present("speaker_name"), present("_role"), F.col("speaker_id"))
    return out.select("meeting_id", "ord", role_label(label).alias("speaker"), tx.strip("text").alias("text"), "start_ms")


def department_slug(raw: Column, departments=DEPARTMENTS) -> Column:
    """The first department any of whose names occurs in the text, else ``other``.

    Exact and suffix-stripped matches are substrings too, so one ordered test per department is enough.
    """
    needle = F.lower(tx.strip(F.coalesce(raw, F.lit(""))))
    out = None
    for slug, short, display, _, aliases in departments:
        names = sorted({x.lower() for x in (slug, short, display, *aliases)})
        hit = F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(needle, n))
        out = F.when(hit, slug) if out is None else out.when(hit, slug)
    return F.when(needle == "", "other").otherwise(out.otherwise("other"))


def sections_by_department(items: DataFrame, departments=DEPARTMENTS, placeholder: str = "Нет") -> DataFrame:
    """Every meeting lists all departments in display order, empty ones with a placeholder."""
    named = F.array(*[F.struct(F.lit(d[0]).alias("slug"), F.lit(d[2]).alias("display_name"), F.lit(d[3]).alias("display_order")) for d in departments])
    grid = items.select("meeting_id").distinct().select("meeting_id", F.inline(named))
    return grid.join(items, ["meeting_id", "slug"], "left").withColumn("text", F.coalesce("text", F.lit(placeholder)))


def term_hits(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences of each meeting's dictionary terms in its text, case-folded, not overlapping.

    The text of a meeting is its segments joined by line breaks and a term holds none, so hits are counted per
    segment.  A meeting's terms come from one text and travel as one array; only non-zero counts leave the scan.
    """
    fold = lambda c: F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    per_meeting = terms.groupBy("meeting_id").agg(F.collect_set(fold(F.col("term"))).alias("keys"))
    df = segments.join(per_meeting, "meeting_id").withColumn("low", fold(F.col("text")))
    counts = F.transform("keys", lambda k: F.struct(k.alias("key"), F.floor((F.length("low") - F.length(F.replace(F.col("low"), k, F.lit("")))) / F.length(k)).alias("n")))
    hits = df.select("meeting_id", F.inline(F.filter(counts, lambda c: c["n"] > 0))).groupBy("meeting_id", "key").agg(F.sum("n").alias("n"))
    out = terms.withColumn("key", fold(F.col("term"))).join(hits, ["meeting_id", "key"], "left")
    return out.select("meeting_id", "term", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("found"))


def enriched_vocabulary(employees: DataFrame, profiles: DataFrame) -> DataFrame:
    """Employees plus profile names not yet listed (case-insensitive, first spelling kept)."""
    low = lambda c: F.lower(F.trim(c))
    known = employees.select(low("name").alias("k")).distinct()
    new = profiles.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("k", low("name"))
    first = new.groupBy("k").agg(F.min_by(F.trim("name"), "ord").alias("name"), F.min("ord").alias("ord"))
    added = first.join(known, "k", "left_anti").select("name", F.lit(1).alias("source"), "ord")
    return employees.select("name", F.lit(0).alias("source"), "ord").unionByName(added)


def distinct_terms(raw: DataFrame, keys: list[str], text: str = "raw") -> DataFrame:
    """Terms split on commas, semicolons and line breaks; first spelling per case-folded term."""
    parts = raw.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"[,;\n\r]+")).alias("pos", "t")).withColumn("term", tx.strip("t"))
    fold = F.replace(F.lower("term"), F.lit("ß"), F.lit("ss"))
    return parts.where("term <> ''").groupBy(*keys, fold.alias("key")).agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos")).drop("key")


def vocabulary_for_type(vocab: DataFrame, sections: list[str]) -> DataFrame:
    """Entries of the declared sections in declared order, then the order inside the section."""
    rank = literal_map({s: f"{i:04d}" for i, s in enumerate(sections)})
    return vocab.where(F.col("section").isin(*sections)).withColumn("section_rank", rank[F.col("section")].cast("int"))


# Vocabulary sections per meeting type (empty means all).
TYPE_SECTIONS = {
    "court_hearing": ["addresses", "counterparties", "legal_terms", "clients", "finance"],
    "administrative": ["employees", "clients", "finance", "legal_terms"],
    "client_meeting": ["employees", "counterparties", "clients", "finance"],
    "interview": ["employees"],
    "generic": [],
}


def packed_prompt(vocab: DataFrame, keys: list[str], max_chars: int = 800) -> DataFrame:
    """Deduplicated entries joined by commas until the next one would pass ``max_chars``.

    Entries shrink to one row per folded spelling first; running lengths then decide the cut.
    """
    from pyspark.sql import Window

    order = F.struct("section_rank", "pos")
    first = vocab.where(F.trim("term") != "").groupBy(*keys, F.lower(F.trim("term")).alias("k")).agg(F.min_by(F.trim("term"), order).alias("term"), F.min(order).alias("o"))
    # At most max_chars entries of one character fit, so the rank filter bounds the rows before the running sum.
    ranked = first.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where(F.col("rn") <= max_chars)
    w = Window.partitionBy(*keys).orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("term") + F.when(F.col("rn") > 1, 2).otherwise(0)).over(w)
    kept = ranked.withColumn("used", used).where(F.col("used") <= max_chars)
    return kept.groupBy(*keys).agg(F.concat(F.lit("Имена и термины: "), joined_text(F.col("term"), "o", sep=", "), F.lit(".")).alias("prompt"))
