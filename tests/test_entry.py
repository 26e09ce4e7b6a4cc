from __future__ import annotations

import __spark_entry__ as entry


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["item_id", "doc_id", "rank", "score"] and got.count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
