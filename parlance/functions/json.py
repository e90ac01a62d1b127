"""Recovery and shaping of model replies that should be JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import text as tx

# Spellings of item kinds and confidence labels.
KIND_ALIASES = {
    "decision": "decision", "decisions": "decision", "task": "task", "action": "task", "action_item": "task", "open_question": "open_question",
    "question": "open_question", "risk": "risk", "blocker": "risk", "thesis": "thesis", "takeaway": "thesis", "agreement": "decision",
}
CONFIDENCES = ["high", "medium", "low"]
CLIENT_WORDS = ["client", "клиент", "клиента", "client side"]
ATTENDEES = r"(?iU)Участники\s+совещания\s*:\s*([^\n\r.]+)"

ITEM = "struct<kind:string,text:string,speaker:string,evidence:string,timestamp:string,owner:string,deadline:string,confidence:string>"


def unfence(c) -> Column:
    out = F.regexp_replace(tx.strip(F.coalesce(tx._col(c), F.lit(""))), r"(?U)^```(?:json)?\s*", "")
    return F.regexp_replace(out, r"(?U)\s*```\s*$", "")


def _recover(c, opener: str, block: str) -> Column:
    bare = unfence(c)
    inner = F.regexp_extract(bare, block, 1)
    whole_ok = F.try_parse_json(bare).isNotNull() & F.ltrim(bare).startswith(opener)
    return F.when(whole_ok, bare).when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)


def recover_object(c) -> Column:
    """The reply as a JSON object text, else its first bracketed block, else null."""
    return _recover(c, "{", r"(?s)(\{.*\})")


def recover_array(c) -> Column:
    """X19 for replies that should be an array of objects; other valid JSON is returned as it is."""
    bare = unfence(c)
    inner = F.regexp_extract(bare, r"(?s)(\[\s*\{.*\}\s*\])", 1)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)


def elements(obj: Column, path: str) -> Column:
    """Array under ``path`` as variants; an empty array when absent or not an array."""
    v = F.try_variant_get(F.try_parse_json(obj), path, "array<variant>")
    return F.coalesce(v, F.array().cast("array<variant>"))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def text_of(obj: Column, name: str) -> Column:
    return tx.strip(F.coalesce(F.try_variant_get(F.try_parse_json(obj), f"$.{name}", "string"), F.lit("")))


def strings(obj: Column, path: str, clean=tx.strip) -> Column:
    vals = F.transform(elements(obj, path), lambda v: clean(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))))
    return F.filter(vals, lambda s: s != "")


def item_kind(c: Column) -> Column:
    """Canonical kind, default thesis."""
    aliases = F.create_map(*[F.lit(x) for kv in KIND_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, F.lower(tx.strip(F.coalesce(c, F.lit(""))))), F.lit("thesis"))


def item_confidence(c: Column) -> Column:
    low = F.lower(tx.clean_null(c))
    return F.when(low.isin(*CONFIDENCES), low).otherwise("medium")


def commitment_party(c: Column, default: str = "host") -> Column:
    return F.when(F.lower(tx.strip(F.coalesce(c, F.lit("")))).isin(*CLIENT_WORDS), "client").otherwise(default)


def _item(kind: Column, v: Column, speaker=True, owner=True, timestamp=True, evidence: Column | None = None) -> Column:
    blank, none = F.lit(""), F.lit(None).cast("string")
    optional = lambda c: F.when(tx.clean_null(c) != "", tx.clean_null(c))
    return F.struct(
        kind.alias("kind"),
        tx.clean_null(field(v, "text")).alias("text"),
        (tx.clean_null(field(v, "speaker")) if speaker else blank).alias("speaker"),
        tx.clean_null(evidence if evidence is not None else field(v, "evidence")).alias("evidence"),
        (tx.clean_null(field(v, "timestamp")) if timestamp else blank).alias("timestamp"),
        (optional(field(v, "owner")) if owner else none).alias("owner"),
        (optional(field(v, "deadline")) if owner else none).alias("deadline"),
        item_confidence(field(v, "confidence")).alias("confidence"),
    )


def _with_text(items: Column) -> Column:
    return F.filter(items, lambda s: s["text"] != "")


def practical_items(obj: Column) -> Column:
    """The unified item list."""
    return _with_text(
        F.transform(
            elements(obj, "$.items"),
            lambda v: _item(item_kind(F.coalesce(field(v, "type"), field(v, "kind"))), v, evidence=F.coalesce(field(v, "evidence_quote"), field(v, "evidence"))),
        )
    )


def flat_items(obj: Column, name: str, kind: str) -> Column:
    """One of the per-kind lists; tasks carry owner and deadline instead of a speaker."""
    task = kind == "task"
    return _with_text(F.transform(elements(obj, f"$.{name}"), lambda v: _item(F.lit(kind), v, speaker=not task, owner=task, timestamp=False)))


def topic_items(obj: Column, name: str, kind: str) -> Column:
    """X20 per topic: items without evidence are dropped."""
    task = kind == "task"

    def one(v):
        owner = tx.strip(F.coalesce(field(v, "owner"), F.lit("")))
        deadline = tx.strip(F.coalesce(field(v, "deadline"), F.lit("")))
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"),
            tx.strip(F.coalesce(field(v, "text"), F.lit(""))).alias("text"),
            tx.strip(F.coalesce(field(v, "speaker"), F.lit(""))).alias("speaker"),
            tx.strip(F.coalesce(field(v, "evidence"), F.lit(""))).alias("evidence"),
            F.lit("").alias("timestamp"),
            (F.when(owner != "", owner) if task else none).alias("owner"),
            (F.when((deadline != "") & ~F.lower(deadline).isin("null", "none", "нет"), deadline) if task else none).alias("deadline"),
            F.lit("medium").alias("confidence"),
        )

    return F.filter(F.transform(elements(obj, f"$.{name}"), one), lambda s: (s["text"] != "") & (s["evidence"] != ""))


def context_participants(c) -> Column:
    """Names after the attendee marker of a context line."""
    raw = F.regexp_extract(F.coalesce(tx._col(c), F.lit("")), ATTENDEES, 1)
    return F.filter(F.transform(F.split(raw, "[,;]+"), tx.strip), lambda n: n != "")


def administrative_payload(reply, context) -> Column:
    """U1 + X18 + X20: unified items win; otherwise they are the per-kind lists in order."""
    obj = recover_object(reply)
    buckets = [("decisions", "decision"), ("tasks", "task"), ("open_questions", "open_question"), ("risks", "risk")]
    unified = practical_items(obj)
    flat = [flat_items(obj, n, k) for n, k in buckets]
    named = strings(obj, "$.participants", tx.clean_null)
    use = F.size(unified) > 0
    items = F.when(use, unified).otherwise(F.concat(*flat))
    return F.struct(
        tx.clean_null(text_of(obj, "meeting_date")).alias("meeting_date"),
        tx.clean_null(text_of(obj, "meeting_goal")).alias("meeting_goal"),
        tx.clean_null(text_of(obj, "summary")).alias("summary"),
        F.when(F.size(named) > 0, named).otherwise(context_participants(context)).alias("participants"),
        strings(obj, "$.topics", tx.clean_null).alias("topics"),
        items.alias("items"),
        *[F.when(use, F.filter(unified, lambda s, k=k: s["kind"] == k)).otherwise(f).alias(n) for (n, k), f in zip(buckets, flat)],
    )


def _deadline(v: Column) -> Column:
    d = tx.strip(F.coalesce(field(v, "deadline"), F.lit("")))
    return F.when((d != "") & ~F.lower(d).isin("none", "null", "-", "нет"), d)


def court_payload(reply) -> Column:
    """X21 + X34: court title composed from the parts present; roles as a map."""
    obj = recover_object(reply)
    number, date = text_of(obj, "case_number"), text_of(obj, "hearing_date")
    title = F.concat(
        F.lit("Стенограмма судебного заседания"),
        F.when(number != "", F.concat(F.lit(" № "), number)).otherwise(""),
        F.when(date != "", F.concat(F.lit(" от "), date)).otherwise(""),
    )
    roles = F.transform_values(
        F.coalesce(F.from_json(F.get_json_object(obj, "$.speaker_roles"), "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: tx.strip(v)
    )
    return F.struct(
        title.alias("title"),
        number.alias("case_number"),
        date.alias("hearing_date"),
        text_of(obj, "summary").alias("summary"),
        strings(obj, "$.participants").alias("participants"),
        roles.alias("speaker_roles"),
    )


def client_payload(reply, host: str = "host") -> Column:
    """Client meeting with representatives, requests and commitments by party."""
    obj = recover_object(reply)
    name, date = text_of(obj, "client_name"), text_of(obj, "meeting_date")

    def items(key, party=False):
        def one(v):
            parts = [tx.strip(F.coalesce(field(v, "text"), F.lit(""))).alias("text"), tx.strip(F.coalesce(field(v, "speaker"), F.lit(""))).alias("speaker"), _deadline(v).alias("deadline")]
            if party:
                parts.append(commitment_party(field(v, "party"), host).alias("party"))
            return F.struct(*parts)

        return _with_text(F.transform(elements(obj, f"$.{key}"), one))

    return F.struct(
        F.concat_ws(" — ", F.lit("Протокол встречи с клиентом"), F.when(name != "", name), F.when(date != "", date)).alias("title"),
        date.alias("meeting_date"),
        name.alias("client_name"),
        strings(obj, f"$.{host}_representatives").alias("host_representatives"),
        strings(obj, "$.client_representatives").alias("client_representatives"),
        text_of(obj, "summary").alias("summary"),
        items("topics").alias("topics"),
        items("client_requests").alias("client_requests"),
        items("commitments", party=True).alias("commitments"),
        items("follow_ups").alias("follow_ups"),
        strings(obj, "$.parked_questions").alias("parked_questions"),
    )


def interview_payload(reply) -> Column:
    """Internal and external reports; the external name falls back to the internal one."""
    obj = recover_object(reply)
    i, e = F.get_json_object(obj, "$.internal"), F.get_json_object(obj, "$.external")

    def observations(part, key):
        rows = F.transform(
            elements(part, f"$.{key}"),
            lambda v: F.struct(
                tx.strip(F.coalesce(field(v, "observation"), F.lit(""))).alias("observation"), tx.strip(F.coalesce(field(v, "evidence"), F.lit(""))).alias("evidence")
            ),
        )
        return F.filter(rows, lambda s: s["observation"] != "")

    inner_name, outer_name = text_of(i, "candidate_name"), text_of(e, "candidate_name")
    internal = F.struct(
        text_of(i, "role").alias("role"),
        inner_name.alias("candidate_name"),
        text_of(i, "summary").alias("summary"),
        *[observations(i, k).alias(k) for k in ("strengths", "concerns", "technical_signals", "communication_signals")],
        strings(i, "$.open_questions_for_next_round").alias("open_questions_for_next_round"),
    )
    external = F.struct(
        F.when(outer_name != "", outer_name).otherwise(inner_name).alias("candidate_name"),
        strings(e, "$.speaking_style_notes").alias("speaking_style_notes"),
        observations(e, "strongest_moments").alias("strongest_moments"),
        strings(e, "$.areas_to_develop").alias("areas_to_develop"),
        text_of(e, "closing_note").alias("closing_note"),
    )
    return F.struct(text_of(obj, "meeting_date").alias("meeting_date"), internal.alias("internal"), external.alias("external"))


def context_block(participants: Column, dictionary: Column) -> Column:
    """Labelled blocks of the parts that are present."""
    p, d = tx.strip(F.coalesce(participants, F.lit(""))), tx.strip(F.coalesce(dictionary, F.lit("")))
    return F.concat_ws(
        "\n\n",
        F.when(p != "", F.concat(F.lit("COURT_PARTICIPANTS_AND_ROLES:\n"), p)),
        F.when(d != "", F.concat(F.lit("COURT_DICTIONARY_TERMS:\n"), d)),
    )


def polish_is_valid(original: Column, polished: Column) -> Column:
    """Same top-level keys, same list lengths, same speaker, owner and evidence per item."""
    keys = lambda c: F.array_sort(F.map_keys(F.from_json(c, "map<string,string>")))
    ok = F.coalesce(keys(original) == keys(polished), F.lit(False))
    for name in ("topics", "participants", "items", "decisions", "tasks", "open_questions", "risks"):
        ok = ok & (F.size(elements(original, f"$.{name}")) == F.size(elements(polished, f"$.{name}")))
    kept = {"items": ["speaker", "owner", "evidence"], "decisions": ["speaker", "evidence"], "tasks": ["owner", "evidence"], "open_questions": ["speaker", "evidence"], "risks": ["speaker", "evidence"]}
    for name, fields in kept.items():
        pairs = F.zip_with(elements(original, f"$.{name}"), elements(polished, f"$.{name}"), _same_fields(fields))
        ok = ok & F.forall(pairs, lambda b: b)
    return F.coalesce(ok, F.lit(False))


def _same_fields(fields: list[str]):
    def same(o: Column, p: Column) -> Column:
        out = F.lit(True)
        for f in fields:
            out = out & field(o, f).eqNullSafe(field(p, f))
        return out

    return same
