"""Exact order statistics by radix selection: values are counted in buckets, never shuffled or sorted.

Each pass counts values in ordered buckets, which combine in every task before
the shuffle, and narrows every rank that is asked for to one bucket.  The first
pass takes sign, exponent and eight bits of the fraction (a map of doubles that
keeps their order); later ones cut a bucket's own range into `CELLS`.  A bucket
whose least value is its largest is the answer, and one of `FEW` values at most
is counted value by value, so two passes do unless very many values are nearly
the same, and five or so always.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.publish import staged

CELLS = 4096
#: Values of a bucket that are counted one by one.
FEW = 1 << 17


def coarse(x: Column) -> Column:
    """A bucket of doubles in their order, as a double: 256 to a power of two, zero between the signs, infinities and NaN at the ends."""
    size = F.rint(F.log2(F.abs(x)) * 256) + 300_000  # the exponent of a double is above -1075
    return F.coalesce(F.signum(x) * size, F.lit(0.0))


def _counted(values: DataFrame, keys: list[str], cell: Column) -> DataFrame:
    """(keys, cell, n, lo, hi, before): values of each cell and of all cells before it."""
    hist = values.groupBy(*keys, cell.alias("_cell")).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))


def _targets(total: Column, interpolated: list[float], ranked: list[float]) -> Column:
    """The 0-based ranks of all quantiles, numbered: two for an interpolated one, with the weight of the second."""
    out = []
    for f in interpolated:
        h = F.lit(f) * (total - 1)
        out += [(F.floor(h), h - F.floor(h)), (F.ceil(h), h - F.floor(h))]
    for f in ranked:
        out.append((F.greatest(F.ceil(F.lit(f) * total - 1e-9), F.lit(1)) - 1, F.lit(0.0)))
    return F.array(*[F.struct(F.lit(t).alias("_t"), r.cast("bigint").alias("_rank"), w.cast("double").alias("_w")) for t, (r, w) in enumerate(out)])


def _narrowed(long: DataFrame, hits: DataFrame, few: int) -> DataFrame:
    """One pass: hits that are settled stay, the others are found in the cells of their bucket."""
    cell_of = ["_g", "_m", "_lo0", "_hi0"]
    open_hits = hits.filter("NOT _lo <=> _hi").select("_g", "_m", "_t", "_w", F.col("_rank").alias("_r0"), F.col("_lo").alias("_lo0"), F.col("_hi").alias("_hi0"))
    buckets = hits.filter("NOT _lo <=> _hi").select("_g", "_m", F.col("_lo").alias("_lo0"), F.col("_hi").alias("_hi0"), F.col("_n").alias("_n0")).distinct()
    inside = long.join(buckets, ["_g", "_m"]).filter("_x >= _lo0 AND _x <= _hi0")
    part = F.floor((F.col("_x") - F.col("_lo0")) / (F.col("_hi0") - F.col("_lo0")) * CELLS).cast("double")
    cells = _counted(inside, cell_of, F.when(F.col("_n0") <= few, F.col("_x")).otherwise(part))
    found = open_hits.join(cells, cell_of).filter("_before <= _r0 AND _r0 < _before + _n")
    return hits.filter("_lo <=> _hi").unionByName(found.select("_g", "_m", "_t", "_w", (F.col("_r0") - F.col("_before")).alias("_rank"), "_lo", "_hi", "_n"))


def order_statistics(values: DataFrame, groups: list[str], metrics: list[str], interpolated: dict[str, float], ranked: dict[str, float], few: int = FEW) -> DataFrame:
    """values (groups, metrics as doubles), staged → per group `metric_suffix` of every quantile; null for a metric without values.

    Null values are left out, null groups are groups, NaN is above all numbers.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(m).alias("_x")) for i, m in enumerate(metrics)])
    key = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    long = values.select(key.alias("_g"), F.explode(cells).alias("_c")).select("_g", "_c._m", "_c._x").filter("_x IS NOT NULL")
    first = _counted(long, ["_g", "_m"], coarse(F.col("_x"))).withColumn("_all", F.sum("_n").over(Window.partitionBy("_g", "_m")))
    asked = first.withColumn("_a", F.explode(_targets(F.col("_all"), list(interpolated.values()), list(ranked.values())))).select("*", "_a.*")
    hits = asked.filter("_before <= _rank AND _rank < _before + _n").select("_g", "_m", "_t", "_w", (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi", "_n")
    hits = staged(hits)
    while (largest := hits.filter("NOT _lo <=> _hi").agg(F.max("_n")).first()[0]) is not None:
        hits = _narrowed(long, hits, few)
        if largest <= few:  # counted value by value: nothing is open any more
            break
        hits = staged(hits)
    at = lambda m, t: F.max(F.when((F.col("_m") == m) & (F.col("_t") == t), F.col("_lo")))
    weight = lambda m, t: F.max(F.when((F.col("_m") == m) & (F.col("_t") == t), F.col("_w")))
    out = []
    for m, name in enumerate(metrics):
        for t, suffix in enumerate(interpolated):
            out.append((at(m, 2 * t) + (at(m, 2 * t + 1) - at(m, 2 * t)) * weight(m, 2 * t)).alias(f"{name}_{suffix}"))
        for t, suffix in enumerate(ranked):
            out.append(at(m, 2 * len(interpolated) + t).alias(f"{name}_{suffix}"))
    return hits.groupBy("_g").agg(*out)


def summaries(df: DataFrame, groups: list[str], metrics: dict[str, Column], interpolated: dict[str, float], ranked: dict[str, float] | None = None, plain: tuple[str, ...] = ("n", "min", "max", "mean"), few: int = FEW) -> DataFrame:
    """Per group count, min, max, mean and exact quantiles of each metric, from one staged table of the values."""
    values = staged(df.select(*groups, *[x.cast("double").alias(f"_v_{m}") for m, x in metrics.items()]))
    make = {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg}
    simple = [make[p](f"_v_{m}").alias(f"{m}_{p}") for m in metrics for p in plain]
    key = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    base = values.groupBy(key.alias("_g")).agg(*simple, F.lit(True).alias("_there"))
    found = order_statistics(values, groups, [f"_v_{m}" for m in metrics], interpolated, ranked or {}, few)
    suffixes = [*interpolated, *(ranked or {})]
    named = found.select("_g", *[F.col(f"_v_{m}_{s}").alias(f"{m}_{s}") for m in metrics for s in suffixes])
    return base.join(named, "_g", "left").select(*[F.col(f"_g.{g}").alias(g) for g in groups], *[f"{m}_{c}" for m in metrics for c in (*plain, *suffixes)])
