"""Deterministic row samples by stride and outcome class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.publish import staged


def with_ordinals(df: DataFrame, key: str, name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """O1: 0-based ordinals in key order, ties by the whole row, independent of the partitioning; ranges are counted, no task sees all rows."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("x"))) for c in df.columns])  # equal rows may take each other's ordinals
    dealt = staged(df.withColumn("_t", whole).repartitionByRange(n, key, "_t").withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = dealt.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(key, "_t")) - 1
    return dealt.withColumn("_r", inside).join(offsets, "_p").withColumn(name, (F.col("_r") + F.col("_o")).cast("bigint")).drop("_p", "_r", "_o", "_t")


def ranked_in_groups(df: DataFrame, groups: list[str], order: list[str], name: str, first: int = 0) -> DataFrame:
    """Ranks by `order` (a total order) in each of a few large groups; ranges are counted, no task sees a whole group."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(n, *groups, *order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a group and partition
    offsets = dealt.groupBy(*groups, "_p").agg(F.count("*").alias("_n")).select(*groups, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_p").orderBy(*order)) - 1 + first
    return dealt.withColumn("_r", inside).join(offsets, [*groups, "_p"]).withColumn(name, (F.col("_r") + F.col("_o")).cast("bigint")).drop("_p", "_r", "_o")


def stride_ordinals(rows: DataFrame, count: int = 10) -> DataFrame:
    """Ordinals ⌊i·N/count⌋ with their reasons; several strides may meet in one ordinal."""
    n = rows.agg(F.count("*").alias("n"))
    return n.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"), "n").filter("n > 0").select(F.expr("i * n div " + str(count)).alias("ordinal"), F.concat(F.lit("stride_"), F.col("i").cast("string")).alias("reason"))


def first_of_classes(rows: DataFrame, classes: dict[str, Column], ordinal: str = "ordinal") -> DataFrame:
    """The first row of each class that has one."""
    found = rows.agg(*[F.min(F.when(p, F.col(ordinal))).alias(c) for c, p in classes.items()])
    return found.select(F.explode(F.array(*[F.struct(F.col(c).alias("ordinal"), F.lit(c).alias("reason")) for c in classes])).alias("x")).select("x.*").filter("ordinal IS NOT NULL")


def highest(rows: DataFrame, score: str, reason: str = "highest_score", ordinal: str = "ordinal") -> DataFrame:
    """The row with the largest score, ties to the larger ordinal."""
    return rows.filter(F.col(score).isNotNull()).agg(F.max(F.struct(score, ordinal)).alias("m")).select(F.col(f"m.{ordinal}").alias("ordinal"), F.lit(reason).alias("reason")).filter("ordinal IS NOT NULL")


def all_reasons(*samples: DataFrame) -> DataFrame:
    """Each chosen ordinal once, with every reason in alphabetical order."""
    every = reduce(DataFrame.unionByName, samples)
    return every.groupBy("ordinal").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def missed_classes(rows: DataFrame, strides: DataFrame, classes: dict[str, Column], ordinal: str = "ordinal") -> DataFrame:
    """Like `first_of_classes`, but only for classes that no stride row belongs to; the first reason wins."""
    covered = rows.join(strides.select("ordinal").distinct(), F.col(ordinal) == F.col("ordinal") if ordinal != "ordinal" else "ordinal", "left_semi")
    flags = covered.agg(*[F.coalesce(F.bool_or(p), F.lit(False)).alias(c) for c, p in classes.items()])
    seen = flags.select(F.explode(F.array(*[F.struct(F.lit(c).alias("reason"), F.col(c).alias("seen")) for c in classes])).alias("x")).select("x.*").filter("seen").select("reason")
    return first_of_classes(rows, classes, ordinal).join(seen, "reason", "left_anti")


def distinct_cases(rows: DataFrame, cases: dict[str, Column], ordinal: str = "ordinal") -> DataFrame:
    """The k-th case is the first matching row that no earlier case took.

    Each case needs at most as many candidates as there are cases, so one pass
    keeps that many ordinals of each, and the choice in turn is an expression
    over one row of short arrays.
    """
    n = len(cases)
    firsts = []
    for i, p in enumerate(cases.values()):
        few = rows.filter(p).orderBy(ordinal).limit(n)
        firsts.append(few.agg(F.array_sort(F.collect_list(F.col(ordinal))).alias(f"c{i}")))
    row = reduce(DataFrame.crossJoin, firsts)  # one row each
    for i in range(n):
        taken = F.array(*[F.col(f"p{j}") for j in range(i)]).cast("array<bigint>")
        row = row.withColumn(f"p{i}", F.get(F.array_except(f"c{i}", taken), F.lit(0)))
    picks = F.array(*[F.struct(F.lit(c).alias("case_name"), F.col(f"p{i}").alias("ordinal")) for i, c in enumerate(cases)])
    return row.select(F.explode(picks).alias("x")).select("x.*")


def capped(df: DataFrame, rank: str, n: int) -> DataFrame:
    """O3: the first n by an existing rank."""
    return df.filter(F.col(rank) < n)


def refused_over(df: DataFrame, groups: list[str], n: int) -> DataFrame:
    """Groups with more than n rows, as failures; no silent subset."""
    return df.groupBy(*groups).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > n).withColumn("error", F.lit("too_many_points"))


def ranked_points(df: DataFrame, groups: list[str], keys: tuple[str, ...] = ("y", "x", "type", "direction", "idx"), name: str = "rank") -> DataFrame:
    """O2: 0-based ranks of a group's points by several keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*keys)) - 1)


def first_rows(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k rows by order; every task keeps k before they meet."""
    return df.orderBy(*order).limit(k)
