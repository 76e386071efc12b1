"""Every library query against its SQL, and a stable schema for the rest."""

import pytest

from pairlab.plans import contract_queries, records_queries, score_queries

from .helpers import rows_of, rows_of_sql

QUERIES = records_queries.QUERIES | score_queries.QUERIES | contract_queries.QUERIES
SQL = records_queries.SQL | score_queries.SQL | contract_queries.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = rows_of(df, columns)
    if name in SQL:
        assert got == rows_of_sql(duck, SQL[name], columns)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_table_files_lists_what_is_there(spark, sf):
    import os

    found = {r["side"]: (r["files"], r["error_message"], r["bad_digests"]) for r in QUERIES["table_files"](spark, sf).collect()}
    count = lambda n: sum(f.endswith(".parquet") for _, _, fs in os.walk(f"{sf}/{n}.parquet") for f in fs) if os.path.isdir(f"{sf}/{n}.parquet") else 1
    assert found == {"documents": (count("documents"), None, 0), "orders": (count("orders"), None, 0), "absent": (0, "missing_directory", 0)}


def test_feature_scores_follow_their_formula(spark, sf, duck):
    """Points and matches as SQL counts them; the score of the inliers found; too few matches are a valid zero."""
    from math import log

    points = duck.execute(f"WITH {score_queries.KNN_SQL}, n AS (SELECT label, count(*) FILTER (WHERE even) AS a, count(*) FILTER (WHERE NOT even) AS b FROM p GROUP BY label) SELECT label, a, b, (SELECT count(*) FROM mu WHERE mu.label = n.label) FROM n WHERE a > 0 AND b > 0").fetchall()
    got = {r["label"]: r for r in QUERIES["feature_scores"](spark, sf).collect()}
    assert {k: (r["points_a"], r["points_b"], r["matches"]) for k, r in got.items()} == {k: (a, b, m) for k, a, b, m in points}
    for r in got.values():
        i, m = r["inliers"], r["matches"]
        assert 0 <= i <= m and r["raw_score"] == pytest.approx(i * (i / m) * log(1 + m) if i else 0.0, abs=1e-6)
        assert r["reason"] == "insufficient_geometry_matches" if m < 3 else r["reason"] in (None, "model_estimation_failure")
