import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table, in several partitions, with clashing extra columns on request."""

    def make(texts, langs=None, sources=None, ids=None, extra=False):
        rows = [
            (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t) if t is not None else None)
            for i, t in enumerate(texts)
        ]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        if extra:
            for name in ("id", "n", "size", "row", "target", "copies", "component", "digest", "start", "score"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


#: Nulls, empty and white texts, a tie, and a long one.
ODD = [None, "", " \n\t ", "one", "one", "a b", "\x0b", "é" * 3, "word " * 30_000]
