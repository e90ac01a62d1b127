import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # small products, many processes

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from plain_text import prose  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, component string"


@pytest.fixture(scope="session")
def spark():
    from parlance.session import build_session

    return build_session("local[8]", shuffle_partitions=4)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, near copies, ties and repeated rows, with columns whose names operators use inside."""
    base, long_ = prose(1, 200), prose(2, 30_000)
    near = base.split()
    near[5] = "changed"
    shared = prose(3, 60)
    texts = {
        0: base, 1: base, 2: " ".join(near), 3: base.upper(), 4: None, 5: "", 6: " \t\n", 7: "one two", 8: "One\tTWO", 9: long_, 10: long_ + " tail",
        11: prose(4, 80) + " " + shared, 12: shared + " " + prose(5, 90), 13: prose(6, 40), 14: "Éa été où ça ıß", 15: "!!! ... 123", 16: "a" * 50_000,
    }
    rows = [(k, t, "en" if k % 2 else None, None if k == 3 else "s", None if k == 6 else len(t or ""), k, "c") for k, t in texts.items()]
    rows += [rows[2], (None, base, "en", "s", 3, 1, "c"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
