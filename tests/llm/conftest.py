import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text), with further columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2) for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, start int, block string, spans int"
        )

    return make
