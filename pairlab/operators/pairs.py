"""Pair construction and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once_only(df: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """A5 guard: keys that occur exactly once, with their columns; one partial aggregation, no self-join."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in carry]).filter("_n = 1").drop("_n")


def self_pairs(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each capture paired with itself; every column twice."""
    return df.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns], *[F.col(c).alias(f"{c}_b") for c in columns])


def genuine_pairs(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The two sides of one identity."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, keys)


def reconcile(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every identity with its class `both`, `a_only` or `b_only`; one aggregation over the union."""
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    both = tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    kind = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both").when(F.col("_a") == 1, "a_only").otherwise("b_only")
    return both.select(*keys, kind.alias("presence"))


def reconcile_report(classes: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of the classes per group."""
    n = lambda k: F.count_if(F.col("presence") == k).alias(k)
    return classes.groupBy(*groups).agg(F.count("*").alias("identities"), n("both"), n("a_only"), n("b_only"))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with multiplicity; empty for equal tables."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def consistency(manifest: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Compare a manifest's a/b columns with the source's; `swapped` outranks `a_mismatch` and `b_mismatch`."""
    s = source.select(*keys, *[F.col(f"{c}_{x}").alias(f"_{c}_{x}") for c in columns for x in "ab"], F.lit(True).alias("_s"))
    m = manifest.withColumn("_m", F.lit(True)).join(s, keys, "full_outer")
    every = lambda x, y: reduce(lambda p, q: p & q, [F.col(f"{c}_{x}").eqNullSafe(F.col(f"_{c}_{y}")) for c in columns])
    verdict = (
        F.when(F.col("_m").isNull(), "missing").when(F.col("_s").isNull(), "extra")
        .when(every("a", "a") & every("b", "b"), "consistent").when(every("a", "b") & every("b", "a"), "swapped")
        .when(~every("a", "a"), "a_mismatch").otherwise("b_mismatch")
    )
    return m.withColumn("verdict", verdict).drop("_m", "_s")


def eligible(sources: dict[str, DataFrame], keys: list[str], consistent: Column | None = None) -> DataFrame:
    """Identities present exactly once in every source (and consistent in each): one shuffle for N sources."""
    tagged = [df.select(*keys, (F.lit(True) if consistent is None else consistent).alias("_ok"), F.lit(i).alias("_s")) for i, df in enumerate(sources.values())]
    every = reduce(DataFrame.unionByName, tagged)
    n = len(tagged)
    counts = [F.count_if(F.col("_s") == i).alias(f"_n{i}") for i in range(n)]
    grouped = every.groupBy(*keys).agg(*counts, F.bool_and("_ok").alias("_ok"))
    once = reduce(lambda p, q: p & q, [F.col(f"_n{i}") == 1 for i in range(n)])
    return grouped.filter(once & F.col("_ok")).select(*keys)


def derived_manifest(cohort: DataFrame, manifest: DataFrame, keys: list[str], new_id: Column, name: str = "pair_id") -> DataFrame:
    """Manifest rows of the cohort, under new ids."""
    return cohort.join(manifest, keys).withColumn(name, new_id)


def impostor_manifest(pairing: DataFrame, side_a: DataFrame, side_b: DataFrame, stratum: str, columns: list[str]) -> DataFrame:
    """probe's side A and candidate's side B, each by its own key."""
    a = side_a.select(stratum, F.col("subject").alias("probe"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = side_b.select(stratum, F.col("subject").alias("candidate"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairing.join(a, [stratum, "probe"]).join(b, [stratum, "candidate"])


def in_order(result: DataFrame, manifest: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Places where the result's id sequence differs from the manifest's (empty: identical)."""
    r = result.select(ordinal, F.col(key).alias("actual"))
    m = manifest.select(ordinal, F.col(key).alias("expected"))
    return m.join(r, ordinal, "full_outer").filter(~F.col("actual").eqNullSafe(F.col("expected")))


def matrix_gaps(dimensions: list[DataFrame], actual: DataFrame) -> DataFrame:
    """Combinations of the dimensions' values that the table lacks; the dimensions are small vocabularies."""
    wanted = reduce(lambda a, b: a.crossJoin(b), dimensions)
    return wanted.join(actual.select(*wanted.columns).distinct(), wanted.columns, "left_anti")


def rederived_pairs(captures: DataFrame, side_a: Column, side_b: Column, keys: list[str], columns: list[str]) -> DataFrame:
    """The genuine pairs that a fresh table of captures implies, to hold a stored manifest against."""
    usable = captures.filter("slot IS NOT NULL") if "slot" in captures.columns else captures
    return genuine_pairs(once_only(usable.filter(side_a), keys, columns), once_only(usable.filter(side_b), keys, columns), keys, columns)
