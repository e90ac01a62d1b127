"""Text rules as column expressions.

Patterns carry ``(?U)`` so that ``\\w``, ``\\s`` and ``\\b`` mean the Unicode classes; without it Cyrillic and
accented letters count as non-word characters.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------
WHITESPACE = "".join(
    chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
RU_FILLERS = [
    "э", "эм", "ээ", "эээ", "э-э", "аа", "ааа", "а-а", "мм", "ммм", "м-м", "ну-у",
    "ну", "вот", "как бы", "типа", "короче", "значит", "так сказать", "в общем", "ну вот", "ну как бы",
    "это самое", "то есть ну", "ну типа", "в принципе ну", "скажем так", "грубо говоря", "собственно говоря",
    "ну это", "ну там", "ну такое", "как это", "вот это",
]
EN_FILLERS = [
    "uh", "um", "uhm", "hmm", "like", "you know", "i mean", "basically", "actually", "literally", "right", "so yeah", "kind of", "sort of",
]
RU_LEFTOVERS = [
    "спасибо за просмотр", "подпишитесь на канал", "подписывайтесь на канал", "ставьте лайк", "не забудьте подписаться",
    "до новых встреч", "редактор субтитров", "корректор",
]
EN_LEFTOVERS = ["subscribe", "thanks for watching", "like and subscribe", "see you next time", "thanks for watching!", "thank you."]
ARTIFACT_MAX_CHARS = 30
MIN_MEANINGFUL_CHARS = 3
SENTENCE_PAUSE_MS = 600
CONTINUOUS_MS = 150
CHAT_MARKERS = ["<|im_end|>", "<|im_start|>", "<|endoftext|>", "<|assistant|>", "<|user|>", "<|system|>"]
NOISE_ITEMS = ["", "--", "---", "—", "–", "-", "**", "***"]
NOISE_PREFIXES = ["**В разделе ", "*Примечание", "Примечание:", 'Упоминание "', "Note:", "*Note", "**Note"]
NULL_WORDS = ["нет", "none", "null", "n/a", "-"]
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
LATIN = ["a", "b", "v", "g", "d", "e", "zh", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "ch", "sh", "sch", "", "y", "", "e", "yu", "ya"]
# -----------------------------------------------------------------------------------------------

_MARK = "\ue000"  # private-use character: splits a text at a replaced position


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def _quote(s: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-" else ch for ch in s)


def upper_first(c: Column) -> Column:
    """Upper-case a lower-case letter at position 1."""
    return F.when(c.rlike(r"^\p{Ll}"), F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))).otherwise(c)


def lower_first(c: Column) -> Column:
    return F.when(c.rlike(r"^\p{Lu}"), F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))).otherwise(c)


def _upper_after_mark(marked: Column) -> Column:
    upper = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    return F.array_join(F.transform(F.split(marked, _MARK), lambda s, i: F.when(i == 0, s).otherwise(upper(s))), "")


def clean_fillers(c, language: str = "ru") -> Column:
    """Drop filler words, longest first, then tidy spaces and edge punctuation."""
    text = _col(c)
    words = sorted(RU_FILLERS if language == "ru" else EN_FILLERS, key=len, reverse=True)
    any_word = r"(?iuU)(?<!\w)(?:" + "|".join(_quote(w) for w in words) + r")(?!\w)"
    chained = text
    for w in words:
        chained = F.regexp_replace(chained, r"(?iuU)(?<!\w)" + _quote(w) + r"(?!\w)", "")
    out = F.when(text.rlike(any_word), chained).otherwise(text)
    out = strip(F.regexp_replace(out, r"(?U)\s{2,}", " "))
    out = F.regexp_replace(out, r"(?U)^[,.\s]+", "")
    out = F.regexp_replace(out, r"(?U)[,\s]+$", "")
    out = F.regexp_replace(out, r"(?U)([.,!?])\s*\1+", "$1")
    return strip(out)


def remove_repeats(c) -> Column:
    """A one- or two-word phrase said three or more times in a row is kept once."""
    return strip(F.regexp_replace(_col(c), r"(?iuU)\b(\w+(?:\s+\w+)?)\s+(?:\1\s*){2,}", "$1"))


def drop_artifacts(c) -> Column:
    """Empty the text when it is a short recogniser artefact (leading H:MM:SS or a known leftover)."""
    text = _col(c)
    s = strip(text)
    bare = F.btrim(F.lower(s), F.lit(".!?,;:- \t\n"))
    stamped = s.rlike(r"(?U)^\s*\d{1,2}:\d{2}:\d{2}(?:\s|[.,!?])")
    artefact = (F.length(s) <= ARTIFACT_MAX_CHARS) & (stamped | bare.isin(*RU_LEFTOVERS, *EN_LEFTOVERS))
    return F.when((F.length(s) > 0) & artefact, F.lit("")).otherwise(text)


def is_meaningful(c) -> Column:
    """At least three characters once stripped."""
    return F.length(strip(c)) >= MIN_MEANINGFUL_CHARS


def capitalize_sentences(c) -> Column:
    """Upper-case the letter after sentence punctuation and the first letter."""
    marked = F.regexp_replace(_col(c), r"(?U)([.!?])\s+([a-zA-Zа-яА-ЯёЁ])", f"$1 {_MARK}$2")
    out = _upper_after_mark(marked)
    return F.when(out.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))).otherwise(out)


def cleanup_joined(c) -> Column:
    """Collapse whitespace, no space before punctuation."""
    out = F.regexp_replace(_col(c), r"(?U)\s+", " ")
    return strip(F.regexp_replace(out, r"(?U)\s+([,.!?;:])", "$1"))


def normalize_turn(c) -> Column:
    """Dash markers after end punctuation, repeated commas, leading dash/comma cluster."""
    out = _upper_after_mark(F.regexp_replace(_col(c), r"(?U)([.!?…])\s+[—–-][\s,—–-]*(\S)", f"$1 {_MARK}$2"))
    out = F.regexp_replace(out, r"(?U),(?:\s*,)+", ",")
    return upper_first(F.regexp_replace(out, r"(?U)^[—–,-][\s,—–-]+", ""))


def ends_terminal(c: Column) -> Column:
    return c.rlike("[.!?…]$")


def ends_continuing(c: Column) -> Column:
    return c.rlike("[,;:—–-]$")


def seam_suffix(prev: Column, gap_ms: Column) -> Column:
    """X7, left side: a full stop is added when speech stops without punctuation for long enough."""
    open_end = ~ends_terminal(prev) & ~ends_continuing(prev)
    return F.when(open_end & (gap_ms >= SENTENCE_PAUSE_MS) & prev.rlike(r"[\p{L}\p{N}]$"), F.lit(".")).otherwise(F.lit(""))


def seam_case(prev: Column, nxt: Column, gap_ms: Column) -> Column:
    """X7, right side: capital after a sentence end, lower case inside a sentence, else unchanged."""
    return (
        F.when(ends_terminal(prev), upper_first(nxt))
        .when(ends_continuing(prev), lower_first(nxt))
        .when(gap_ms >= SENTENCE_PAUSE_MS, upper_first(nxt))
        .when(gap_ms <= CONTINUOUS_MS, lower_first(nxt))
        .otherwise(nxt)
    )


def rule_pattern(key: str) -> str:
    """Bare words are escaped and word-bounded, keys with regex characters are used as written."""
    return "(?U)" + key if any(ch in key for ch in r"\.^$*+?()[]{}|") else r"(?U)\b" + _quote(key) + r"\b"


def apply_rules(c, rules: list[tuple[str, str]]) -> Column:
    """Ordered pattern -> replacement rewriting."""
    out = _col(c)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def scoring_normalise(c) -> Column:
    """Composed (NFC) form, lower case, yo -> ye, punctuation and symbols to spaces, whitespace collapsed."""
    out = F.translate(F.lower(compose(c)), "ё", "е")
    out = F.regexp_replace(out, r"[\p{P}\p{S}]", " ")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def compose(c) -> Column:
    """NFC form.  Only texts with combining marks travel to Python; of all others a null does, and the text stays."""
    text = _col(c)
    return F.coalesce(_nfc_udf()(F.when(text.rlike(r"[\p{M}ᄀ-ᇿ]"), text)), text)


def _nfc_udf():
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(nfc, "string")


def tokens(normalised: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(normalised, " "), lambda w: w != "")


def token_normalise(c) -> Column:
    """Lower case, yo -> ye, punctuation and symbols removed from inside the token."""
    return F.regexp_replace(F.translate(F.lower(_col(c)), "ё", "е"), r"[\p{P}\p{S}]", "")


def canonical_tail(c) -> Column:
    """Scored punctuation characters at a token's end, in order."""
    tail = F.regexp_extract(F.rtrim(_col(c)), r"([\p{P}\p{S}]+)$", 1)
    return F.regexp_replace(F.translate(tail, "…", "."), "[^.!?,;:]", "")


def pick_punct(tail: Column) -> Column:
    has = lambda ch: F.contains(tail, F.lit(ch))
    return F.when(has("?"), "?").when(has("!"), "!").when(has("."), ".").otherwise(F.right(tail, F.lit(1)))


def trailing_punct(c) -> Column:
    """Canonical punctuation at a token's end; sentence ends win, otherwise the last one."""
    return pick_punct(canonical_tail(c))


def first_letter(c) -> Column:
    return F.regexp_extract(_col(c), r"(\p{L})", 1)


def letter_case(letter: Column) -> Column:
    return F.when(letter == "", F.lit(None)).when(letter.rlike(r"^\p{Lu}"), "U").otherwise("L")


def first_alpha_case(c) -> Column:
    """X11: U or L for the first letter of a token, null when it has none."""
    return letter_case(first_letter(c))


def word_set(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1)))


def token_overlap(a, b) -> Column:
    """Jaccard overlap of word sets; both empty is 1, one empty is 0."""
    x, y = word_set(a), word_set(b)
    nx, ny = F.size(x), F.size(y)
    return (
        F.when((nx == 0) & (ny == 0), F.lit(1.0))
        .when((nx == 0) | (ny == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    )


def item_normalise(c) -> Column:
    """Lower case, yo -> ye, everything but digits, a-z and Cyrillic to single spaces."""
    out = F.translate(F.lower(F.coalesce(_col(c), F.lit(""))), "ё", "е")
    return strip(F.regexp_replace(out, "[^0-9a-zЀ-ӿ]+", " "))


def clean_null(c) -> Column:
    """Words that mean "nothing" become the empty string."""
    s = strip(F.coalesce(_col(c), F.lit("")))
    return F.when(F.lower(s).isin(*NULL_WORDS), F.lit("")).otherwise(s)


def clean_markup(c) -> Column:
    """Chat markers and reasoning blocks removed."""
    out = F.coalesce(_col(c), F.lit(""))
    for m in CHAT_MARKERS:
        out = F.replace(out, F.lit(m), F.lit(""))
    out = F.regexp_replace(out, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(out, r"(?s)<think>.*", ""))


def is_noise(c) -> Column:
    """Separators and verification remarks that leak into item lists."""
    s = strip(c)
    out = s.isin(*NOISE_ITEMS)
    for p in NOISE_PREFIXES:
        out = out | s.startswith(p)
    return out


def safe_basename(c) -> Column:
    """File stem with Cyrillic transliterated and everything unsafe turned to underscores."""
    name = F.regexp_extract(_col(c), r"(?s)([^/]*)$", 1)
    out = F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")
    one = {a: b for a, b in zip(CYRILLIC, LATIN) if len(b) == 1}
    gone = [a for a, b in zip(CYRILLIC, LATIN) if b == ""]
    src = "".join(one) + "".join(one).upper() + "".join(gone) + "".join(gone).upper()
    out = F.translate(out, src, "".join(one.values()) + "".join(one.values()).upper())
    for a, b in zip(CYRILLIC, LATIN):
        if len(b) > 1:
            out = F.replace(F.replace(out, F.lit(a), F.lit(b)), F.lit(a.upper()), F.lit(b.capitalize()))
    out = F.regexp_replace(out, r"[^A-Za-z0-9_\-.]", "_")
    out = F.btrim(F.regexp_replace(out, "_+", "_"), F.lit("_."))
    return F.when(out == "", "meeting").otherwise(out)


def safe_username(c, unsafe: str = r'[<>:"/\\|?*\x00-\x1f]') -> Column:
    out = F.btrim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), unsafe, "_"), F.lit(" ."))
    return F.when(out == "", "default").otherwise(out)


def is_twin_summary(c) -> Column:
    """The first 200 characters recur, or both halves begin alike."""
    text = _col(c)
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    mid = F.floor(F.length(flat) / 2).cast("int")
    left = F.substring(strip(F.substr(flat, F.lit(1), mid)), 1, 150)
    right = F.substring(strip(F.substr(flat, mid + 1)), 1, 150)
    recurs = F.contains(F.substr(flat, F.lit(201)), F.substring(flat, 1, 200))
    return F.when(text.isNull() | (F.length(text) < 100), F.lit(False)).otherwise(recurs | (left == right))


def group_thousands(c) -> Column:
    """No-break space every three digits in numbers of four or more digits.

    The first match takes the one to three digits before whole threes, each later one goes on from there.
    """
    return F.regexp_replace(_col(c), r"(?U)(?:(?<!\w)(\d{1,3})|\G(?<=\d)(\d{3}))(?=(?:\d{3})+(?!\w))", "$1$2\u00a0")


def token_estimate(chars: Column) -> Column:
    """Rough token count of a prompt."""
    return F.greatest(F.lit(1), F.floor(chars / 3.2)).cast("long")


def context_tier(tokens_in: Column, max_out: int, low: int = 65536, cap: int = 262144) -> Column:
    """The smallest context size that fits input plus output with 15 % headroom, else the cap."""
    needed = F.floor((tokens_in + max_out) * 1.15).cast("long")
    low = max(4096, min(low, cap))
    tiers = sorted({low, 131072, cap})
    return F.coalesce(F.get(F.filter(F.array(*[F.lit(t).cast("long") for t in tiers]), lambda t: t >= needed), F.lit(0)), F.lit(cap).cast("long"))


def cut_near(text: Column, start: Column, end: Column, cut: Column) -> Column:
    """Character position proportional to ``cut`` in time, moved to the nearest whitespace close by."""
    n = F.length(text)
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cut - start) / (end - start)))
    approx = F.bround(n * ratio, 0).cast("int")
    window = F.greatest(F.lit(8), F.least(F.lit(40), F.floor(n / 8).cast("int")))
    lo, hi = F.greatest(F.lit(1), approx - window), F.least(n - 1, approx + window)
    spaces = F.filter(F.sequence(lo, hi), lambda i: F.substr(text, i + 1, F.lit(1)).rlike(r"^(?U)\s$"))
    nearest = F.array_min(F.transform(spaces, lambda i: F.struct(F.abs(i - approx).alias("d"), i.alias("i"))))["i"]
    return F.when((end <= start) | (n == 0), n).when((approx <= 0) | (approx >= n), approx).otherwise(F.coalesce(nearest, approx))


def _ends_sentence(tok: Column) -> Column:
    return F.regexp_replace(F.rtrim(tok), "[\"»')\\]]+$", "").rlike("[.!?…]$")


def cap_first_letter(tok: Column) -> Column:
    """Upper-case the first letter anywhere in the token."""
    at = F.regexp_instr(tok, F.lit(r"\p{L}"))
    return F.when(
        at > 0,
        F.concat(F.substr(tok, F.lit(1), at - 1), F.upper(F.substr(tok, at, F.lit(1))), F.substr(tok, at + 1)),
    ).otherwise(tok)


def sentence_caps(c, lower: bool = False) -> Column:
    """Capital after sentence ends and at the start; ``lower`` first drops the native casing."""
    base = F.lower(_col(c)) if lower else _col(c)
    toks = F.filter(F.split(base, r"(?U)\s+"), lambda t: t != "")
    done = F.transform(
        toks, lambda t, i: F.when((i == 0) | _ends_sentence(F.get(toks, i - 1)), cap_first_letter(t)).otherwise(t)
    )
    return F.array_join(done, " ")


def mean_confidence(word_conf: Column, avg_logprob: Column) -> Column:
    """Mean word confidence, else exp of the mean log probability, clamped to 0..1."""
    n = F.size(word_conf)
    mean = F.aggregate(word_conf, F.lit(0.0), lambda a, x: a + x) / n
    lp = F.coalesce(avg_logprob, F.lit(0.0))
    raw = F.when(n > 0, mean).otherwise(F.when(lp < 0, F.exp(lp)).otherwise(lp))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


SPEAKER_LABEL = r"(?i)^speaker[_\s-]?(\d+)$"
SPEAKER_REF = r"(?i)speaker[_\s-]?(\d+)"
UNRESOLVED = r"(?iU)^speaker[\s_-]?\d+$"
READABLE_PREFIX = "Спикер #"


def is_speaker_label(c) -> Column:
    return strip(c).rlike(SPEAKER_LABEL)


def is_unresolved(c) -> Column:
    """Machine label such as SPEAKER_01."""
    return F.coalesce(strip(c).rlike(UNRESOLVED), F.lit(False))


def readable_label(c) -> Column:
    """SPEAKER_06 -> readable number label."""
    n = F.regexp_extract(strip(c), SPEAKER_LABEL, 1)
    return F.when(n != "", F.concat(F.lit(READABLE_PREFIX), n.cast("bigint").cast("string"))).otherwise(_col(c))


def speaker_key(c) -> Column:
    """Zero-padded upper-case form of a machine label."""
    n = F.regexp_extract(strip(c), SPEAKER_LABEL, 1)
    return F.when(n != "", F.concat(F.lit("SPEAKER_"), F.lpad(n.cast("bigint").cast("string"), F.greatest(F.lit(2), F.length(n.cast("bigint").cast("string"))), F.lit("0"))))


def resolve_label(c, mapping: Column) -> Column:
    """Mapped name, else a readable label; references inside free text are replaced one by one."""
    s = strip(c)
    named = lambda key: F.coalesce(F.try_element_at(mapping, key), readable_label(key))
    whole = named(speaker_key(s))
    refs = F.regexp_extract_all(s, F.lit("(" + SPEAKER_REF + ")"), F.lit(1))
    rest = F.split(F.regexp_replace(s, SPEAKER_REF, _MARK), _MARK)
    inside = F.array_join(F.transform(rest, lambda part, i: F.when(i == 0, part).otherwise(F.concat(named(speaker_key(F.get(refs, i - 1))), part))), "")
    return F.when(_col(c).isNull() | (_col(c) == ""), _col(c)).when(s.rlike(SPEAKER_LABEL), whole).when(s.rlike(SPEAKER_REF), inside).otherwise(s)


# ---- timestamps -------------------------------------------------------------------------------
def timestamp_seconds(c) -> Column:
    """``[H:]MM:SS`` anywhere in the string, null when absent."""
    t = F.coalesce(_col(c), F.lit(""))
    g = lambda i: F.regexp_extract(t, r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})", i)
    hours = F.when(g(1) == "", F.lit(0)).otherwise(g(1).try_cast("long"))
    return F.when(g(3) != "", hours * 3600 + g(2).try_cast("long") * 60 + g(3).try_cast("long"))


def _two(c: Column) -> Column:
    return F.format_string("%02d", c.cast("long"))


def hms_floor(ms: Column) -> Column:
    """HH:MM:SS, seconds rounded down."""
    s = F.floor(ms / 1000)
    return F.concat_ws(":", _two(F.floor(s / 3600)), _two(F.floor(s % 3600 / 60)), _two(s % 60))


def h_mm_ss(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), _two(F.floor(s % 3600 / 60)), _two(s % 60))


def bracket_stamp(ms: Column, hms: Column | None = None) -> Column:
    """``[MM:SS]`` or ``[HH:MM:SS]``, rounded half to even; ``hms`` forces the long form."""
    s = F.greatest(F.lit(0), F.bround(ms / 1000, 0)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    long_form = F.concat(F.lit("["), F.concat_ws(":", _two(h), _two(m), _two(s % 60)), F.lit("]"))
    if hms is None:
        return F.when(h > 0, long_form).otherwise(F.concat(F.lit("["), _two(m), F.lit(":"), _two(s % 60), F.lit("]")))
    return F.when(hms, long_form).otherwise(F.concat(F.lit("["), _two(h * 60 + m), F.lit(":"), _two(s % 60), F.lit("]")))


def hms_hundredths(ms: Column) -> Column:
    """HH:MM:SS.ff"""
    s = F.floor(ms / 1000)
    return F.concat(_two(F.floor(s / 3600)), F.lit(":"), _two(F.floor(s % 3600 / 60)), F.lit(":"), F.format_string("%05.2f", ((ms % 60000) / 1000).cast("double")))


def timestamped_text(decoded, offset_ms: Column, duration_ms: Column) -> Column:
    """``<|0.00|> text <|4.52|>`` to an array of (start_ms, end_ms, text, confidence).

    A text between two stamps is a timed segment; text without a stamp before it starts where the last segment
    ended and lasts at most five seconds.
    """
    special = r"<\|(startoftranscript|endoftext|startoflm|startofprev|nospeech|notimestamps|transcribe|translate|[a-z]{2,3})\|>"
    cleaned = F.regexp_replace(_col(decoded), special, "")
    parts = F.filter(F.split(F.regexp_replace(cleaned, r"<\|(\d+\.\d+)\|>", f"{_MARK}T$1{_MARK}"), _MARK), lambda p: strip(p) != "")
    dur = duration_ms.cast("long")
    seg = "array<struct<start_ms:bigint,end_ms:bigint,text:string,confidence:double>>"
    zero = F.struct(
        F.array().cast(seg).alias("out"),
        F.lit(None).cast("bigint").alias("open"),
        F.lit(None).cast("string").alias("text"),
    )
    is_stamp = lambda p: p.rlike(r"^T\d+\.\d+$")
    ms = lambda p: F.bround(F.substr(p, F.lit(2)).cast("double") * 1000, 0).cast("bigint")

    def timed(start: Column, end: Column, text: Column) -> Column:
        s, e = F.least(start, dur), F.least(end, dur)
        return F.struct(
            (s + offset_ms).alias("start_ms"),
            (F.when(e <= s, F.least(s + 500, dur)).otherwise(e) + offset_ms).alias("end_ms"),
            text.alias("text"),
            F.lit(0.9).alias("confidence"),
        )

    def orphan(acc: Column, text: Column) -> Column:
        s = F.coalesce(F.element_at(acc["out"], -1)["end_ms"] - offset_ms, F.lit(0).cast("bigint"))
        s = F.when(F.size(acc["out"]) == 0, F.lit(0).cast("bigint")).otherwise(s)
        return F.struct((s + offset_ms).alias("start_ms"), (F.least(s + 5000, dur) + offset_ms).alias("end_ms"), text.alias("text"), F.lit(0.7).alias("confidence"))

    def state(out, open_, text):
        return F.struct(out.alias("out"), open_.cast("bigint").alias("open"), text.cast("string").alias("text"))

    none = F.lit(None)

    def step(acc: Column, p: Column) -> Column:
        words = strip(p)
        closes = acc["open"].isNotNull() & acc["text"].isNotNull()
        return (
            F.when(is_stamp(p) & closes, state(F.concat(acc["out"], F.array(timed(acc["open"], ms(p), acc["text"]))), none, none))
            .when(is_stamp(p), state(acc["out"], ms(p), none))
            .when(acc["open"].isNotNull() & acc["text"].isNull(), state(acc["out"], acc["open"], words))
            .otherwise(state(F.concat(acc["out"], F.array(orphan(acc, words))), none, none))
        )

    def finish(acc: Column) -> Column:
        # A stamp followed by text but by no closing stamp: the text is an orphan.
        return F.when(acc["text"].isNotNull(), F.concat(acc["out"], F.array(orphan(acc, acc["text"])))).otherwise(acc["out"])

    return F.aggregate(parts, zero, step, finish)
