"""Memory of the corpus operators' Python: what tasks hold at once, that they hand it back, and what the driver collects."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from parlance.llm import jaccard, language, repeats
from parlance.llm.words import powers

MB = 1 << 20
TASKS = {"sample": jaccard._sample_shingles, "heads": jaccard._heads(np.zeros(0, np.int64)), "seeds": repeats._seeds}


def peak(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", TASKS)
def test_a_task_holds_arrays_of_half_a_megabyte_of_text(name):
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(10**6, 10**7, 250))) for _ in range(2000)]
    batch = pa.record_batch({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    powers(len("".join(texts)))

    def work():
        for _ in TASKS[name](iter([batch])):
            pass

    assert peak(work) < 16


def test_tasks_hand_back_their_memory(spark, monkeypatch):
    seen = []
    plain = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, func, *a, **k: (seen.append(func.__qualname__), plain(self, func, *a, **k))[1])
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["text"] for r in repeats.drop_repeats(docs, repeats.repeated_spans(docs)).collect()} == {1: text, 2: " end", 3: "other words"}
    assert set(seen) == {"tidy.<locals>.run"} and len(seen) >= 6


def test_the_driver_collects_grams_as_columns(spark):
    rows = spark.range(800).select(F.concat(*[F.translate(F.sha2(F.concat(F.lit(f"{j} "), "id"), 512), "0123456789", "ghijklmnop") for j in range(3)]).alias("text"), F.lit("xx").alias("lang"))
    found = {}
    assert peak(lambda: found.update(language.fit(rows).models)) < 80
    assert len(found["xx"].grams[-1][0]) > 200_000
