"""Evaluation of transcripts and diarisation against references.

Pairs of texts, a row each, are compared by an Arrow function over rows; recordings whose tokens are rows are aligned by
``alignment.aligned_positions``, whatever their length.  Everything counted afterwards is ordinary aggregation.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators.alignment import aligned_positions, codes, matching_blocks
from parlance.operators.intervals import interval_join
from parlance.operators.ordered import BLOCK_MS, Timeline, by_position, joined_text, neighbours, running_totals
from parlance.session import cut

PUNCT_CLASSES = [".", ",", "?", "!", ":", ";"]
SENTENCE_ENDS = [".", "!", "?"]


# ---- sequence comparison ----------------------------------------------------------------------
def _blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"a": i, "b": j, "size": n} for i, j, n in matching_blocks(list(p), list(q))] for p, q in zip(a, b)])


def blocks_of(a, b) -> Column:
    """matching blocks of two token arrays."""
    return F.pandas_udf(_blocks, "array<struct<a:int,b:int,size:int>>")(a, b)


def similarity_ratio(a: Column, b: Column) -> Column:
    """twice the matched tokens over all tokens; 1 for two empty lists."""
    hit = F.aggregate(blocks_of(a, b), F.lit(0), lambda s, m: s + m["size"])
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * hit / n)


def edit_counts(ref: list, hyp: list) -> dict:
    """Fewest edits between two token lists and, among those alignments, the most hits."""
    x, y = codes(ref, hyp)
    # Equal ends can be aligned with each other without giving up edits or hits.
    k = min(len(x), len(y))
    head = k if (x[:k] == y[:k]).all() else int((x[:k] != y[:k]).argmax())
    x, y = x[head:], y[head:]
    k = min(len(x), len(y))
    back = (x[len(x) - k :] == y[len(y) - k :])[::-1]
    tail = k if back.all() else int((~back).argmax())
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    n, m = len(x), len(y)
    unit = n + m + 1
    steps = np.arange(m + 1, dtype=np.int64) * unit
    row = steps.copy()
    for i in range(n):
        t = row + unit
        t[1:] = np.minimum(t[1:], row[:-1] + np.where(y == x[i], -1, unit))
        row = np.minimum.accumulate(t - steps) + steps
    value = int(row[m])
    edits = -(-value // unit)
    hits = edits * unit - value
    subs = n + m - 2 * hits - edits
    return {"hits": head + tail + hits, "substitutions": subs, "deletions": n - hits - subs, "insertions": m - hits - subs}


def _edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_counts(list(p), list(q)) for p, q in zip(ref, hyp)], columns=["hits", "substitutions", "deletions", "insertions"])


def edits_of(ref, hyp) -> Column:
    """word edit alignment counts."""
    return F.pandas_udf(_edits, "struct<hits:int,substitutions:int,deletions:int,insertions:int>")(ref, hyp)


def word_errors(pairs: DataFrame) -> DataFrame:
    """Hits, substitutions, deletions, insertions and WER of (ref, hyp) text pairs."""
    ref, hyp = tx.tokens(tx.scoring_normalise("ref")), tx.tokens(tx.scoring_normalise("hyp"))
    df = pairs.withColumns({"_r": ref, "_h": hyp}).withColumn("_e", edits_of("_r", "_h"))
    errors = F.col("_e.substitutions") + F.col("_e.deletions") + F.col("_e.insertions")
    return df.select(
        *[c for c in pairs.columns if c not in ("ref", "hyp")],
        F.size("_r").alias("n_ref"),
        F.size("_h").alias("n_hyp"),
        "_e.*",
        F.when(F.size("_r") > 0, F.bround(errors / F.size("_r"), 4)).alias("wer"),
    )


def corpus_error_rate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Total edits over total reference words."""
    edits = F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    return scored.groupBy(*keys).agg(F.sum("n_ref").alias("n_ref"), edits.alias("edits")).withColumn("wer", F.when(F.col("n_ref") > 0, F.bround(F.col("edits") / F.col("n_ref"), 4)))


def char_error_rate(ref, hyp) -> Column:
    """Edits between normalised texts without spaces over the reference length."""
    r, h = (F.replace(tx.scoring_normalise(c), F.lit(" "), F.lit("")) for c in (ref, hyp))
    return F.when(F.length(r) > 0, F.bround(F.levenshtein(r, h) / F.length(r), 4))


# ---- matched tokens ---------------------------------------------------------------------------
def scored_tokens(text: Column) -> Column:
    """Tokens with normal form, trailing punctuation, case and original; tokens without a normal form go.

    Lambdas share no common subexpressions, so each pattern runs once into a field that the second pass reads.
    """
    raw = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    parts = F.transform(raw, lambda w: F.struct(tx.token_normalise(w).alias("norm"), tx.canonical_tail(w).alias("tail"), tx.first_letter(w).alias("letter"), w.alias("orig")))
    return F.transform(
        F.filter(parts, lambda s: s["norm"] != ""),
        lambda s: F.struct(s["norm"].alias("norm"), tx.pick_punct(s["tail"]).alias("punct"), tx.letter_case(s["letter"]).alias("kase"), s["orig"].alias("orig")),
    )


def matched_pairs(pairs: DataFrame) -> DataFrame:
    """One row per matched token pair of every (ref, hyp) text pair."""
    keep = [c for c in pairs.columns if c not in ("ref", "hyp")]
    df = pairs.select(*keep, scored_tokens(F.col("ref")).alias("g"), scored_tokens(F.col("hyp")).alias("h"))
    df = df.withColumn("m", blocks_of(F.transform("g", lambda s: s["norm"]), F.transform("h", lambda s: s["norm"])))
    return df.select(*keep, F.inline(_pairs_in(F.col("m"), F.col("g"), F.col("h"))))


def _pairs_in(blocks: Column, g: Column, h: Column) -> Column:
    """Matched elements of two arrays.  They are picked before the explode, so no output row carries the arrays."""

    def block(m: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), m["size"] - 1),
            lambda k: F.struct((m["a"] + k).alias("gold_pos"), (m["b"] + k).alias("hyp_pos"), F.get(g, m["a"] + k).alias("gold"), F.get(h, m["b"] + k).alias("hyp")),
        )

    return F.flatten(F.transform(blocks, block))


def _prf(tp: Column, fp: Column, fn: Column, digits: int) -> dict[str, Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return {"precision": F.bround(p, digits), "recall": F.bround(r, digits), "f1": F.bround(f, digits)}


def punctuation_scores(matched: DataFrame, keys: list[str]) -> DataFrame:
    """TP/FP/FN and P/R/F1 per class, ``micro`` over all classes, ``boundary`` for sentence ends."""
    g, h = F.col("gold.punct"), F.col("hyp.punct")
    one = lambda name, a, b: F.struct(F.lit(name).alias("class"), a.alias("g"), b.alias("h"))
    rows = [one(c, g == c, h == c) for c in PUNCT_CLASSES] + [one("boundary", g.isin(*SENTENCE_ENDS), h.isin(*SENTENCE_ENDS))]
    long = matched.select(*keys, F.inline(F.array(*rows)))
    per = long.groupBy(*keys, "class").agg(
        F.count_if(F.col("g") & F.col("h")).alias("tp"), F.count_if(~F.col("g") & F.col("h")).alias("fp"), F.count_if(F.col("g") & ~F.col("h")).alias("fn")
    )
    micro = per.where(F.col("class") != "boundary").groupBy(*keys).agg(F.lit("micro").alias("class"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return per.unionByName(micro).withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn"), 3))


def sentence_counts(pairs: DataFrame) -> DataFrame:
    """Tokens and sentence ends on both sides."""
    ends = lambda c: F.size(F.filter(c, lambda s: s["punct"].isin(*SENTENCE_ENDS)))
    keep = [c for c in pairs.columns if c not in ("ref", "hyp")]
    df = pairs.select(*keep, scored_tokens(F.col("ref")).alias("g"), scored_tokens(F.col("hyp")).alias("h"))
    return df.select(*keep, F.size("g").alias("gold_tokens"), F.size("h").alias("hyp_tokens"), ends("g").alias("gold_sentences"), ends("h").alias("hyp_sentences"))


def capital_scores(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, missed and added capitals, confusion of "starts with a capital"."""
    g, h = F.col("gold.kase"), F.col("hyp.kase")
    n = lambda a, b: F.count_if((g == a) & (h == b))
    per = matched.groupBy(*keys).agg(
        F.count("*").alias("pairs"),
        F.count_if(g.isNull() | h.isNull()).alias("no_alpha"),
        n("U", "U").alias("tp"),
        n("L", "U").alias("fp"),
        n("U", "L").alias("fn"),
        n("L", "L").alias("tn"),
    )
    acc = (F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), F.col("pairs") - F.col("no_alpha"))
    return per.withColumns({"accuracy": F.bround(acc, 4), **_prf(F.col("tp"), F.col("fp"), F.col("fn"), 4)})


def top_offenders(matched: DataFrame, keys: list[str], order: list[str], n: int = 20) -> DataFrame:
    """O3: the most frequent words per direction of a casing error, with the first example."""
    g, h = F.col("gold.kase"), F.col("hyp.kase")
    side = F.when((g == "U") & (h == "L"), "missed").when((g == "L") & (h == "U"), "over")
    first = F.struct(*order, "gold_pos")
    per = (
        matched.withColumn("direction", side)
        .where("direction is not null")
        .groupBy(*keys, "direction", F.col("gold.norm").alias("lemma"))
        .agg(F.count("*").alias("n"), F.min(first).alias("at"), F.min_by(F.struct(F.col("gold.orig").alias("gold"), F.col("hyp.orig").alias("hyp")), first).alias("example"))
    )
    w = Window.partitionBy(*keys, "direction").orderBy(F.desc("n"), "at")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("at")


def turn_coverage(turns: DataFrame, words: DataFrame) -> DataFrame:
    """Per reference turn the matched tokens and the span of the recogniser words they match.

    ``turns(recording_id, turn, text)``, ``words(recording_id, pos, word, start_ms, end_ms)``; ``turn`` and ``pos`` order a
    recording and occur once in it.  Tokens stay rows; matches are positions, joined back to them.
    """
    norm = lambda c: tx.tokens(tx.scoring_normalise(c))

    def placed(df: DataFrame, text: str, order: str, *keep: str) -> DataFrame:
        """Tokens with their positions in the recording."""
        sized = df.select("recording_id", order, *keep, norm(text).alias("ws")).withColumn("n", F.size("ws").cast("long"))
        upto = running_totals(sized, by_position(("recording_id",), order), {"upto": F.col("n")})
        return cut(upto.select("recording_id", order, *keep, (F.col("upto") - F.col("n")).alias("before"), F.posexplode("ws").alias("k", "tok")).withColumn("pos_", F.col("before") + F.col("k")).drop("before", "k"))

    gold, hyp = placed(turns, "text", "turn"), placed(words, "word", "pos", "start_ms", "end_ms")
    side = lambda t: t.select("recording_id", F.col("pos_").alias("pos"), "tok")
    hits = aligned_positions(side(gold), side(hyp))
    hits = hits.join(gold.select("recording_id", F.col("pos_").alias("gold_pos"), "turn"), ["recording_id", "gold_pos"])
    hits = hits.join(hyp.select("recording_id", F.col("pos_").alias("hyp_pos"), "start_ms", "end_ms"), ["recording_id", "hyp_pos"])
    found = hits.groupBy("recording_id", "turn").agg(F.count("*").alias("n_matched"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    sized = turns.withColumn("n_tokens", F.size(norm("text")))
    return sized.join(found, ["recording_id", "turn"], "left").withColumns(
        {"n_matched": F.coalesce("n_matched", F.lit(0)), "status": F.when(F.col("n_matched").isNotNull(), "aligned").otherwise("unaligned")}
    )


def proper_noun_lexicon(turns: DataFrame, min_count: int = 2, min_share: float = 0.7) -> DataFrame:
    """Normal forms seen often enough and mostly with a capital."""
    w = turns.select(F.explode(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")).alias("w"))
    w = w.select(tx.token_normalise("w").alias("key"), tx.first_alpha_case("w").alias("kase")).where("key <> '' and kase is not null")
    per = w.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("kase") == "U").alias("n_upper"))
    return per.where((F.col("n") >= min_count) & (F.length("key") > 1) & (F.col("n_upper") / F.col("n") >= min_share))


def overlay_proper_nouns(turns: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """Sentence capitals plus a capital on every token whose normal form is in the lexicon.

    The lexicon grows with the corpus, so tokens are joined to it by key instead of carrying it along.
    """
    toks = F.filter(F.split(tx.sentence_caps("text"), " "), lambda w: w != "")
    rows = turns.select(*keys, F.posexplode(toks).alias("pos", "w")).withColumn("key", tx.token_normalise("w"))
    hit = rows.join(lexicon.select("key", F.lit(True).alias("proper")), "key", "left")
    word = F.when(F.col("proper"), tx.cap_first_letter(F.col("w"))).otherwise(F.col("w"))
    return hit.groupBy(*keys).agg(joined_text(word, "pos").alias("text"), F.count_if("proper").alias("proper"))


# ---- diarisation error ------------------------------------------------------------------------
def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Optimal one-to-one assignment that maximises the summed gain (shortest augmenting paths)."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0] = i
        dist, back, done, j = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool), 0
        while True:
            done[j] = True
            row = owner[j]
            free = np.flatnonzero(~done[1:]) + 1
            slack = cost[row - 1, free - 1] - u[row] - v[free]
            better = slack < dist[free]
            dist[free[better]], back[free[better]] = slack[better], j
            nxt = free[dist[free].argmin()]
            step = dist[nxt]
            u[owner[done]] += step
            v[done] -= step
            dist[~done] -= step
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    found = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in found] if flip else found


def speaker_mapping(overlaps: DataFrame, gain: str = "ms") -> DataFrame:
    """optimal reference/hypothesis speaker pairs per recording; the matrix is speakers by speakers."""
    kind = dict(overlaps.dtypes)["recording_id"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        refs, hyps = sorted(pdf["ref"].unique()), sorted(pdf["hyp"].unique())
        table = pdf.pivot_table(index="ref", columns="hyp", values=gain, aggfunc="sum", fill_value=0).reindex(index=refs, columns=hyps, fill_value=0).to_numpy()
        out = [(pdf["recording_id"].iloc[0], refs[i], hyps[j]) for i, j in best_assignment(table) if table[i, j] > 0]
        return pd.DataFrame(out, columns=["recording_id", "ref", "hyp"])

    return overlaps.groupBy("recording_id").applyInPandas(solve, f"recording_id {kind}, ref string, hyp string")


def diarization_atoms(ref: DataFrame, hyp: DataFrame, collar_ms: int, skip_overlap: bool, width: int = 30_000) -> DataFrame:
    """Scored pieces between neighbouring boundaries with the active speakers of both sides.

    The collar is centred on every reference boundary, half before and half after it.
    """
    rid = "recording_id"
    half = collar_ms // 2
    s, e = F.col("start_ms"), F.col("end_ms")
    collars = F.array(*[F.struct(F.lit("collar").alias("kind"), F.lit(None).cast("string").alias("sp"), (t - half).alias("s"), (t + half).alias("e")) for t in (s, e)])
    own = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.col("speaker").alias("sp"), s.alias("s"), e.alias("e")))
    spans = ref.select(rid, F.inline(F.concat(own("ref"), collars) if half else own("ref"))).unionByName(hyp.select(rid, F.inline(own("hyp"))))
    points = spans.select(rid, F.explode(F.array("s", "e")).alias("t")).distinct()
    atoms = neighbours(points, Timeline((rid,), ("t",), BLOCK_MS), ["t"], prev=None, following="nxt")
    atoms = atoms.where("nxt is not null").select(rid, F.col("t").alias("a"), F.col("nxt.t").alias("b"))
    hits = interval_join(atoms, spans.where("e > s"), [rid], ("a", "b"), ("s", "e"), width)
    side = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("sp")))
    out = hits.groupBy(rid, "a", "b").agg(side("ref").alias("refs"), side("hyp").alias("hyps"), F.max(F.col("kind") == "collar").alias("hidden"))
    out = out.where("not hidden").withColumn("ms", F.col("b") - F.col("a")).drop("hidden")
    return out.where(F.size("refs") <= 1) if skip_overlap else out


def diarization_error(ref: DataFrame, hyp: DataFrame, collar_ms: int = 250, skip_overlap: bool = False) -> DataFrame:
    """Missed, false-alarm and confused speech over reference speech, Jaccard error, speaker counts."""
    rid = "recording_id"
    atoms = cut(diarization_atoms(ref, hyp, collar_ms, skip_overlap))
    nr, nh, ms = F.size("refs"), F.size("hyps"), F.col("ms")
    totals = atoms.groupBy(rid).agg(
        F.sum(nr * ms).alias("total_ms"),
        F.sum(F.greatest(F.lit(0), nr - nh) * ms).alias("miss_ms"),
        F.sum(F.greatest(F.lit(0), nh - nr) * ms).alias("false_alarm_ms"),
        F.sum(F.least(nr, nh) * ms).alias("both_ms"),
    )
    cells = atoms.select(rid, "ms", F.explode("refs").alias("ref"), "hyps").select(rid, "ms", "ref", F.explode("hyps").alias("hyp"))
    overlap = cells.groupBy(rid, "ref", "hyp").agg(F.sum("ms").alias("ms"))
    mapped = speaker_mapping(overlap).join(overlap, [rid, "ref", "hyp"])
    correct = mapped.groupBy(rid).agg(F.sum("ms").alias("correct_ms"))
    time = lambda c, n: atoms.select(rid, F.explode(c).alias(n), "ms").groupBy(rid, n).agg(F.sum("ms").alias(f"{n}_ms"))
    per_ref = (
        time("refs", "ref")
        .join(mapped.select(rid, "ref", "hyp", F.col("ms").alias("shared")), [rid, "ref"], "left")
        .join(time("hyps", "hyp"), [rid, "hyp"], "left")
        .withColumn("je", F.when(F.col("hyp").isNull(), 1.0).otherwise(1 - F.col("shared") / (F.col("ref_ms") + F.col("hyp_ms") - F.col("shared"))))
    )
    jer = per_ref.groupBy(rid).agg(F.avg("je").alias("jer"))
    count = lambda df, n: df.groupBy(rid).agg(F.count_distinct("speaker").alias(n))
    out = totals.join(correct, rid, "left").join(jer, rid, "left").join(count(ref, "n_ref"), rid, "left").join(count(hyp, "n_hyp"), rid, "left")
    ok = F.coalesce("correct_ms", F.lit(0))
    wrong = F.col("both_ms") - ok
    return out.select(
        rid,
        "total_ms",
        ok.alias("correct_ms"),
        "miss_ms",
        "false_alarm_ms",
        wrong.alias("confusion_ms"),
        F.when(F.col("total_ms") > 0, F.bround((F.col("miss_ms") + F.col("false_alarm_ms") + wrong) / F.col("total_ms"), 4)).alias("der"),
        F.bround("jer", 4).alias("jer"),
        (F.coalesce("n_hyp", F.lit(0)) - F.coalesce("n_ref", F.lit(0))).alias("speaker_count_error"),
    )
