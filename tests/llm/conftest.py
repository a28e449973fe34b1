from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from texts, or from (id, text) pairs."""

    def make(*rows, extra: str = ""):
        full = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(i, t, "en", "s", None if t is None else len(t), *(("x",) * bool(extra))) for i, t in full]
        return spark.createDataFrame(data, DOCS + (f", {extra} string" if extra else ""))

    return make
