"""Exact diffs of result tables and repeatability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonmaps import sorted_json, stable_map
from ..sources.reconcile import reconciled


def outcome(df: DataFrame, key: list[str], plain: list[str], documents: list[str] = ()) -> DataFrame:
    """Key, outcome columns, and JSON columns without their volatile fields."""
    return df.select(*key, *plain, *[sorted_json(stable_map(F.col(d))).alias(d) for d in documents])


def row_diff(expected: DataFrame, actual: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, field, expected, actual) of every differing cell; rows of one side alone have field `row`.

    Large tables are compared by digests of buckets first, and only rows of
    buckets that differ are joined.
    """
    expected, actual = reconciled(expected, actual, key, columns)
    e = expected.select(*key, F.struct(*columns).alias("_e"))
    a = actual.select(*key, F.struct(*columns).alias("_a"))
    j = e.join(a, key, "full_outer")
    text = lambda c: c.cast("string")
    one = F.when(F.col("_e").isNull() | F.col("_a").isNull(), F.struct(F.lit("row").alias("field"), F.when(F.col("_e").isNull(), "absent").otherwise("present").alias("expected"), F.when(F.col("_a").isNull(), "absent").otherwise("present").alias("actual")))
    cells = [
        F.when(F.col("_e").isNotNull() & F.col("_a").isNotNull() & ~F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}")), F.struct(F.lit(c).alias("field"), text(F.col(f"_e.{c}")).alias("expected"), text(F.col(f"_a.{c}")).alias("actual")))
        for c in columns
    ]
    return j.select(*key, F.explode(F.filter(F.array(one, *cells), lambda x: x.isNotNull())).alias("d")).select(*key, "d.*")


def three_way(oracle: DataFrame, a: DataFrame, b: DataFrame, key: list[str], columns: list[str], declared: list[str] = ()) -> DataFrame:
    """D3: cells where oracle ≠ a, or a ≠ b; columns declared to differ count in the second comparison only."""
    first = row_diff(oracle, a, key, [c for c in columns if c not in declared]).withColumn("comparison", F.lit("oracle_a"))
    return first.unionByName(row_diff(a, b, key, columns).withColumn("comparison", F.lit("a_b")))


def gate_report(sampled: DataFrame, diffs: DataFrame, key: list[str], groups: list[str], least: int) -> DataFrame:
    """Per group sampled rows, mismatching rows, pass; groups are columns of `sampled`."""
    bad = diffs.select(*key).distinct().withColumn("_bad", F.lit(True))
    j = sampled.select(*key, *groups).join(bad, key, "left")
    n_bad = F.count_if(F.col("_bad"))
    return j.groupBy(*groups).agg(F.count("*").alias("sampled"), n_bad.alias("mismatching"), ((n_bad == 0) & (F.count("*") >= least)).alias("passed"))


def repeatability(runs: DataFrame, case: str, run: str, columns: list[str]) -> DataFrame:
    """(case, run, identical to the case's first run)."""
    first = runs.filter(F.col(run) == 0).select(case, F.struct(*columns).alias("_f"))
    j = runs.select(case, run, F.struct(*columns).alias("_r")).join(first, case, "left")
    return j.select(case, run, F.col("_r").eqNullSafe(F.col("_f")).alias("identical"))


def repeat_flags(items: DataFrame, key: str, repeat: str, required: list[str], reported: list[str] = ()) -> DataFrame:
    """Per item and column whether repeats 1 and 2 agree; the gate takes the required columns only."""
    side = lambda r, n: items.filter(F.col(repeat) == r).select(key, F.struct(*required, *reported).alias(n))
    j = side(1, "_1").join(side(2, "_2"), key, "full_outer")
    same = {c: F.col(f"_1.{c}").eqNullSafe(F.col(f"_2.{c}")) & F.col("_1").isNotNull() & F.col("_2").isNotNull() for c in (*required, *reported)}
    gate: Column = F.lit(True)
    for c in required:
        gate = gate & same[c]
    return j.select(key, *[v.alias(f"{c}_equal") for c, v in same.items()], gate.alias("gate"))
