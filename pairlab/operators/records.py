"""Record parsing and validation; bad records are rows with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule that a row breaks, else null; a rule that is null counts as broken."""
    out = None
    for ok, reason in rules:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out


def with_failure(df: DataFrame, rules: list[tuple[Column, str]], name: str = "error_message") -> DataFrame:
    """Keep every row and say why it is bad; split by null afterwards."""
    return df.withColumn(name, first_failure(rules))


def coded(df: DataFrame, dimension: DataFrame, keys: list[str], label: str, default: Column | None = None) -> DataFrame:
    """Label of a code from a small dimension (a fixed vocabulary, which Spark broadcasts by its size); unknown codes get `default`."""
    out = df.join(dimension, keys, "left")
    return out if default is None else out.withColumn(label, F.coalesce(F.col(label), default))


def slotted(df: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Three-valued slots. `dimension` has keys, nullable slot; adds is_valid, slot, is_single, is_multi."""
    known = dimension.withColumn("_known", F.lit(True))
    out = df.join(known, keys, "left").withColumn("is_valid", F.coalesce("_known", F.lit(False))).drop("_known")
    return out.withColumns({"is_single": F.col("is_valid") & F.col("slot").isNotNull(), "is_multi": F.col("is_valid") & F.col("slot").isNull()})


def pairable(df: DataFrame, side: Column) -> DataFrame:
    """Rows of one side with a usable slot."""
    return df.filter(side & F.col("slot").isNotNull())


def constant_violations(df: DataFrame, expected: dict[str, object], key: str) -> DataFrame:
    """(key, field, expected, actual) where a column differs from its constant."""
    faults = [
        F.when(~F.col(c).eqNullSafe(F.lit(v)), F.struct(F.lit(c).alias("field"), F.lit(str(v)).alias("expected"), F.col(c).cast("string").alias("actual")))
        for c, v in expected.items()
    ]
    return df.select(key, F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("f")).select(key, "f.*")


def side_rule(path_a: Column, path_b: Column, same: bool) -> Column:
    """P10: self rows have equal sides, two-sided rows different ones."""
    return path_a.eqNullSafe(path_b) if same else ~path_a.eqNullSafe(path_b)


def under_root(path: Column, root: Column) -> Column:
    """The normalised path lies below the root; `..` never does."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/(\\./)+", "/"), "/+", "/")
    return F.startswith(clean, F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))) & ~clean.rlike(r"(^|/)\.\.(/|$)")


def disagreements(df: DataFrame, pairs: list[tuple[str, str]], key: str) -> DataFrame:
    """(key, field, expected, actual) for column pairs (declared, derived) that differ."""
    faults = [
        F.when(~F.col(a).eqNullSafe(F.col(b)), F.struct(F.lit(a).alias("field"), F.col(a).cast("string").alias("expected"), F.col(b).cast("string").alias("actual")))
        for a, b in pairs
    ]
    return df.select(key, F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("f")).select(key, "f.*")


def unpivot_sides(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """One row per side of a pair; columns come as `{name}_a` and `{name}_b`."""
    side = lambda s: F.struct(F.lit(s).alias("side"), *[F.col(f"{c}_{s}").alias(c) for c in columns])
    return df.select(*keep, F.explode(F.array(side("a"), side("b"))).alias("s")).select(*keep, "s.*")


def duplicate_keys(df: DataFrame, keys: list[str], sample: str, k: int = 3) -> DataFrame:
    """A5: keys that occur more than once, with the k smallest sample values; only k values a task are gathered."""
    smallest = Window.partitionBy(*keys).orderBy(sample)
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    samples = (
        df.select(*keys, sample).withColumn("_r", F.row_number().over(smallest)).filter(F.col("_r") <= k)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(sample).cast("string"))).alias("_s"))
    )
    return counts.join(samples, keys).select(*keys, "n_rows", F.array_join("_s", ",").alias("samples"))


def duplicate_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values that occur more than once and how often, over one or all columns."""
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def error_digest(df: DataFrame, groups: list[str], message: str, order: str, k: int = 5) -> DataFrame:
    """The first k messages of a group and how many more there are."""
    first = Window.partitionBy(*groups).orderBy(order)
    shown = df.select(*groups, order, message).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    shown = shown.groupBy(*groups).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", message))), lambda s: s[message]), "; ").alias("shown"))
    counts = df.groupBy(*groups).agg(F.count("*").alias("n_errors"))
    return counts.join(shown, groups).withColumn("n_more", F.greatest(F.col("n_errors") - k, F.lit(0)))


def declared(df: DataFrame, columns: list[str]) -> DataFrame:
    """The declared columns in their order, nothing else; a missing one fails analysis."""
    return df.select(*columns)
