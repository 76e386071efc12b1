"""Counts, quantiles and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..sources.publish import staged
from .selection import summaries

#: Codes that a histogram text lists at most.
MOST_CODES = 1000


def zero_filled(df: DataFrame, domain: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """A1-A3, A10: counts over a fixed domain, zero where the table has none."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(name))
    return domain.join(counts, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def distinct_bits(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """(groups, bucket, bits, rows): the distinct integers of a column as bitmaps of 32,768, which merge over any coarser grouping."""
    x = F.col(column).cast("bigint")
    return df.groupBy(*groups, F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"), F.count("*").alias("rows"))


def totals(df: DataFrame, group: str, distinct: str) -> DataFrame:
    """A4: per group and grand total; distinct values are counted anew for the total, not summed.

    Integers are counted by bitmaps, made once per group and merged for the
    total; other values once per group and value.
    """
    whole = F.lit("total").alias(group)
    name = F.col(group).cast("string").alias(group)
    if dict(df.dtypes)[distinct] in ("tinyint", "smallint", "int", "bigint"):
        bits = staged(distinct_bits(df, [group], distinct))
        counted = lambda x, *by: x.groupBy(*by).agg(F.sum("rows").alias("rows"), F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("subjects"))
        merged = bits.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.bitmap_or_agg("bits").alias("bits"))
        return counted(bits, group).select(name, "rows", "subjects").unionByName(counted(merged).select(whole, F.coalesce("rows", F.lit(0)).alias("rows"), "subjects"))
    pairs = staged(df.groupBy(group, distinct).agg(F.count("*").alias("rows")))
    counted = lambda x, *by: x.groupBy(*by).agg(F.sum("rows").alias("rows"), F.count(distinct).alias("subjects"))
    values = pairs.groupBy(distinct).agg(F.sum("rows").alias("rows"))
    return counted(pairs, group).select(name, "rows", "subjects").unionByName(counted(values).select(whole, F.coalesce("rows", F.lit(0)).alias("rows"), "subjects"))


def simple_summary(df: DataFrame, groups: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Per group min, max, mean, median of each metric; null for no values."""
    return summaries(df, groups, metrics, {"median": 0.5}, plain=("min", "max", "mean"))


def nearest_rank(df: DataFrame, groups: list[str], metrics: dict[str, Column], fractions: dict[str, float]) -> DataFrame:
    """Per group the value at rank ceil(f·n) of each metric, exact."""
    return summaries(df, groups, metrics, {}, fractions, ())


def five_numbers(df: DataFrame, groups: list[str], metrics: dict[str, Column], interpolated: dict[str, float] | None = None, ranked: dict[str, float] | None = None, plain: tuple[str, ...] = ("n", "min", "max")) -> DataFrame:
    """Per group count, min, interpolated quartiles, max of each metric, and whatever else is asked for."""
    return summaries(df, groups, metrics, {"p25": 0.25, "p50": 0.5, "p75": 0.75} | (interpolated or {}), ranked, plain)


def residual_summary(x: Column, prefix: str) -> list[Column]:
    """Mean, median, interpolated p95, max."""
    return [F.avg(x).alias(f"{prefix}_mean"), F.median(x).alias(f"{prefix}_median"), F.percentile(x, 0.95).alias(f"{prefix}_p95"), F.max(x).alias(f"{prefix}_max")]


def delta_summary(df: DataFrame, groups: list[str], deltas: dict[str, Column]) -> DataFrame:
    """Per group count, median, median of absolute values and mean of each delta."""
    both = {f"{m}_{n}": x for m, d in deltas.items() for n, x in (("median", d), ("median_abs", F.abs(d)))}
    found = summaries(df, groups, both, {"delta": 0.5}, plain=("n", "mean"))
    columns = [c for m in deltas for c in (F.col(f"{m}_median_n").alias(f"{m}_n"), F.col(f"{m}_median_mean").alias(f"{m}_mean_delta"), F.col(f"{m}_median_delta"), F.col(f"{m}_median_abs_delta"))]
    return found.select(*groups, *columns)


def code_counts(df: DataFrame, groups: list[str], code: str, name: str = "n") -> DataFrame:
    """(groups, code, n) of every code that occurs, null codes left out; exact whatever the vocabulary."""
    return df.filter(F.col(code).isNotNull()).groupBy(*groups, code).agg(F.count("*").alias(name))


def histogram_text(df: DataFrame, groups: list[str], code: str, name: str) -> DataFrame:
    """All `code:count` pairs in code order per group, for small vocabularies.

    A group with more than `MOST_CODES` codes has no such text (null): its
    counts are rows of `code_counts`.  Nothing is merged or left out.
    """
    counts = code_counts(df, groups, code, "_n")
    first = F.row_number().over(Window.partitionBy(*groups).orderBy(code))
    few = counts.withColumn("_r", first).filter(F.col("_r") <= MOST_CODES + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(code, "_n"))), lambda s: F.concat_ws(":", s[code], s["_n"].cast("string"))), ",")
    return few.groupBy(*groups).agg(F.when(F.count("*") <= MOST_CODES, text).alias(name))


def failure_counts(status: Column) -> list[Column]:
    """Requested, successful, failed in preparation and in comparison."""
    return [
        F.count("*").alias("requested_rows"), F.count_if(status == "ok").alias("successful_rows"),
        F.count_if(status.isin("prepare_a_failure", "prepare_b_failure")).alias("prepare_failures"), F.count_if(status == "comparison_failure").alias("comparison_failures"),
    ]


def mean_of_available(*xs: Column) -> Column:
    """Mean of the non-null values of a row; null if there are none."""
    there = F.filter(F.array(*xs), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))


def pearson(df: DataFrame, x: str, y: str, groups: list[str], digits: int | None = None) -> DataFrame:
    """Correlation per group; null for under two rows or no variance. Two passes: means, then centred products."""
    means = df.groupBy(*groups).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    joined = df.select(*groups, x, y).join(means, groups) if groups else df.select(x, y).crossJoin(F.broadcast(means))
    sums = joined.groupBy(*groups).agg(F.count("*").alias("_n"), F.sum(dx * dy).alias("_xy"), F.sum(dx * dx).alias("_xx"), F.sum(dy * dy).alias("_yy"))
    r = F.when((F.col("_n") >= 2) & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))))
    return sums.select(*groups, (r if digits is None else F.round(r, digits)).alias("pearson"))


def homogeneous(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Whether a group has one combination of run constants."""
    n = F.count_distinct(F.struct(*columns))
    return df.groupBy(group).agg(n.alias("variants"), (n == 1).alias("homogeneous"))


def gate(df: DataFrame, groups: list[str], matched: Column, least: int) -> DataFrame:
    """Mismatches, and a pass only without any and with a minimum sample."""
    bad = F.count_if(~matched)
    return df.groupBy(*groups).agg(F.count("*").alias("sampled"), bad.alias("mismatches"), ((bad == 0) & (F.count("*") >= least)).alias("passed"))


def file_summary(df: DataFrame, file: str, timings: list[str], statuses: list[str], files: DataFrame | None = None) -> DataFrame:
    """Status counts, score summary and timing median and p95 of each result file.

    `files` (file, sha256, see A26) adds the digest of each; a file without one keeps a null.
    """
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    score = F.when(finite(F.col("raw_score")), F.col("raw_score"))
    found = summaries(df, [file], {"score": score} | {t: F.col(t) for t in timings}, {"median": 0.5}, {"p95": 0.95})
    kept = [f"score_{c}" for c in ("min", "max", "mean", "median")] + [f"{t}_{c}" for t in timings for c in ("median", "p95")]
    out = df.groupBy(file).agg(F.count("*").alias("rows"), *counts).join(found.select(file, *kept), file)
    return out if files is None else out.join(files.select(file, "sha256"), file, "left")
