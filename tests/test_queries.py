"""Every registered query of the core against its oracle."""

import pytest

from quillon import catalog
from tests.oracle import duckdb_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_oracle(spark, sf_dir, name):
    columns, rows = spark_rows(catalog.QUERIES[name](spark, sf_dir))
    expected_columns, expected = duckdb_rows(catalog.ORACLE_SQL[name], sf_dir)
    assert columns == expected_columns
    assert rows == expected


def test_kmeans_codebook_has_all_codes(spark, sf_dir):
    rows = catalog.QUERIES["kmeans_codebook"](spark, sf_dir).collect()
    assert {(r["m"], r["code"]) for r in rows} == {(m, c) for m in range(4) for c in range(8)}
    assert all(len(r["centroid"]) == 16 for r in rows)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["vec_id", "doc_id"]
    assert df.count() == df.select("doc_id").distinct().count() > 0
