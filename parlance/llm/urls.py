"""URL filter: rules on hosts and paths first, a logistic regression on hashed character n-grams for all other URLs.

Only DataFrame and ML-pipeline operations run, inside the JVM.  Defined results: a null URL or one without ``://`` has an empty host and
path; an empty labelled table gives the verdict ``allow`` with a null score; repeated URLs get equal verdicts.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (3, 4)
BUCKETS = 1 << 14
TRAIN_ROWS = 4096  # Bound of the labelled sample a model is fitted on.


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(r.fits(host, path), F.lit(value(r))).otherwise(out)
    return out


def _pieces(s: Column, n: int, mark: str) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - n + 1))
    return F.transform(places, lambda i: F.concat(F.lit(mark), F.substring(s, i, F.lit(n))))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host (marked at both ends) and of the path, told apart by a prefix."""
    marked = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$"))))
    return F.concat(*[_pieces(s, n, mark) for mark, s in marked for n in SIZES])


def fit(labelled: DataFrame):
    """A model from ``url`` and ``label`` (1: block), on the first ``TRAIN_ROWS`` different rows by hash of the URL; None without rows."""
    known = labelled.where("label is not null").select("url", F.col("label").cast("double").alias("label"), F.xxhash64("url").alias("h"))
    kinds = known.agg(F.approx_count_distinct("h").alias("n")).first()["n"] or 1
    low = known.where(F.col("h").cast("double") <= min(1.0, 4.0 * TRAIN_ROWS / kinds) * 2.0**64 - 2.0**63)  # about four times the sample
    # The sample has at most TRAIN_ROWS rows: one ordered partition makes sums, and so the model, the same on every run.
    rows = (
        low.distinct()
        .orderBy("h", "url", "label")
        .limit(TRAIN_ROWS)
        .select("label", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"))
    ).cache()
    try:
        if not rows.head(1):
            return None
        steps = [
            HashingTF(inputCol="grams", outputCol="counts", numFeatures=BUCKETS),
            Normalizer(inputCol="counts", outputCol="features", p=2.0),
            LogisticRegression(maxIter=60, regParam=1e-3),
        ]
        return Pipeline(stages=steps).fit(rows)
    finally:
        rows.unpersist()


def judge(pages: DataFrame, model, rules: list[Rule], keep: list[str]) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (null where a rule decides or no model is given)."""
    parted = pages.select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    ruled = parted.withColumns({"rule": longest_rule(host, path, rules, lambda r: r.name), "by_rule": longest_rule(host, path, rules, lambda r: r.verdict)})
    if model is None:
        return ruled.select(*keep, "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    scored = model.transform(ruled.withColumn("grams", grams(host, path)))
    score = F.when(F.col("rule").isNull(), vector_to_array("probability")[1])
    guess = F.when(score >= 0.5, "block").otherwise("allow")
    return scored.select(*keep, "host", "path", "rule", F.coalesce("by_rule", guess).alias("verdict"), score.alias("block_score"))
