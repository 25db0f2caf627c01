from __future__ import annotations

import pytest

from lorespark.llm.common import ROW

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows."""

    def frame(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return frame


LONG = "long words " * 30_000
#: Nulls, empty and white-space texts, ties, repeated rows, a very long text, other scripts.
ODD = [(1, "a b"), (2, "a  b"), (3, None), (4, ""), (5, " \n "), (6, "a\tb"), (7, "A b"), (7, "A b"), (None, "a b"), (8, LONG), (9, "中文 текст ﷺ"), (10, LONG), (11, "a b", None)]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["h", "sha", "part", "norm", "fp", "root", "node", "u", "v", "start", "stop", "hi", "lo", "words", "keep_id", "key", "bits", "of", "code", "n", "__x", "__key", "spans", "__row_spans"]
    names += [f"{c}{end}" for c in ROW for end in ("", "_of")]
    return odd.select("*", *[F.lit("x").alias(n) for n in names])
