import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table; a row is (doc_id, text) or (doc_id, text, source)."""

    def make(rows, extra: bool = False):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that the operators use themselves
            for name in ("score", "shard", "row", "node", "key", "id", "size", "target", "number", "items", "base", "held_out"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make
