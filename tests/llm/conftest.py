from __future__ import annotations

import pytest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def docs(spark):
    """Makes a documents table of texts, with columns whose names clash with those the operators use."""

    def make(texts, ids=None, **columns):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, columns.get("source", ["s"] * len(texts))[n], columns.get("lang", ["en"] * len(texts))[n], 7, "x", 1) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n long, rep string, key long")

    return make
