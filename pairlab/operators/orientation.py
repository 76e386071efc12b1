"""Dominant gradient orientation of points (K6, K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 36


def disc_radius(support: Column) -> Column:
    """Radius of the weighted disc for a support size."""
    return F.greatest(F.lit(1), F.floor(F.lit(2.25) * support + 0.5)).cast("double")


def dominant_angle(points: DataFrame, samples: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """K6: (keys, pid, bin, angle) of points (keys, pid, x, y, support) over gradient samples (keys, x, y, gx, gy).

    Both sides meet on grid cells as wide as the radius: a sample goes to its
    own cell, a point to the nine around it, so the range join is an equi-join.
    Ties go to the lowest bin; a point without a valid sample has angle 0.
    """
    r = disc_radius(F.col("support"))
    p = points.select(*keys, "pid", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), r.alias("r"), (F.col("support") * 0.75).alias("sigma"))
    # cell widths are powers of two, so a sample has one cell for each width in use
    p = p.withColumn("w", F.pow(F.lit(2.0), F.ceil(F.log2("r"))))
    shift = F.sequence(F.lit(-1), F.lit(1))
    p = p.withColumn("i", F.explode(shift)).withColumn("j", F.explode(shift))
    p = p.withColumns({"cx": F.floor(F.col("px") / F.col("w")) + F.col("i"), "cy": F.floor(F.col("py") / F.col("w")) + F.col("j")}).drop("i", "j")
    widths = p.select(*keys, "w").distinct()
    s = samples.select(*keys, F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy"), F.col("gx").cast("double").alias("gx"), F.col("gy").cast("double").alias("gy"))
    s = s.join(widths, keys).withColumns({"cx": F.floor(F.col("sx") / F.col("w")), "cy": F.floor(F.col("sy") / F.col("w"))})
    met = p.join(s, [*keys, "w", "cx", "cy"])
    d2 = (F.col("sx") - F.col("px")) ** 2 + (F.col("sy") - F.col("py")) ** 2
    m = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)
    degrees = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(360.0))
    weighed = met.filter((d2 <= F.col("r") ** 2) & (m > 0)).select(
        *keys, "pid", F.pmod(F.floor(degrees * bins / 360.0), F.lit(bins)).cast("int").alias("bin"), (F.exp(-d2 / (2 * F.col("sigma") ** 2)) * m).alias("weight")
    )
    sums = weighed.groupBy(*keys, "pid", "bin").agg(F.round(F.sum("weight"), 9).alias("weight"))
    peak = sums.groupBy(*keys, "pid").agg(F.max_by("bin", F.struct("weight", -F.col("bin"))).alias("bin"))
    out = points.select(*keys, "pid").join(peak, [*keys, "pid"], "left")
    return out.select(*keys, "pid", "bin", F.coalesce(F.col("bin") * 360.0 / bins, F.lit(0.0)).alias("angle"))


def oriented(points: DataFrame, samples: DataFrame, keys: list[str], rank: str, cap: int, support: Column) -> DataFrame:
    """K7: the first `cap` points by rank with a uniform support and their angle."""
    kept = points.filter(F.col(rank) < cap).withColumn("support", support)
    return kept.join(dominant_angle(kept, samples, keys), [*keys, "pid"])
