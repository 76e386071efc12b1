"""Verification curves.

Scores are first reduced to a histogram per group and distinct score; all
curve points then come from prefix sums of the histogram, which are taken in
range partitions, so a group with very many distinct scores is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.publish import staged


def score_histogram(rows: DataFrame, groups: list[str], score: str, genuine: Column) -> DataFrame:
    """(groups, score, g, i): genuine and impostor rows at each distinct finite score."""
    return rows.groupBy(*groups, F.col(score).alias("score")).agg(F.count_if(genuine).alias("g"), F.count_if(~genuine).alias("i"))


def range_prefix(hist: DataFrame, groups: list[str], parts: int | None = None, descending: bool = True, key: str = "score", counts: tuple[str, ...] = ("g", "i")) -> DataFrame:
    """Adds g_sum, i_sum (sums of `counts` up to and including each key, in descending order) for histograms of any length.

    Keys are dealt into ranges; ranges are summed (one row a group and range),
    and each range's prefix is added to the sums inside it.
    """
    parts = parts or int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key).desc() if descending else F.col(key).asc()
    dealt = hist.repartitionByRange(parts, *groups, order).withColumn("_p", F.spark_partition_id())
    dealt = staged(dealt)
    inside = Window.partitionBy(*groups, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*groups, "_p").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    sums = sums.select(*groups, "_p", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_0{c}") for c in counts])
    out = dealt.withColumns({f"_s{c}": F.sum(c).over(inside) for c in counts}).join(sums, [*groups, "_p"])
    return out.select(*hist.columns, *[(F.col(f"_s{c}") + F.col(f"_0{c}")).alias(f"{c}_sum") for c in counts])


def _totals(hist: DataFrame, groups: list[str]) -> DataFrame:
    """Groups with at least one genuine and one impostor score."""
    return hist.groupBy(*groups).agg(F.sum("g").alias("ng"), F.sum("i").alias("ni"), F.max("score").alias("top")).filter("ng > 0 AND ni > 0")


def roc(hist: DataFrame, groups: list[str]) -> DataFrame:
    """(threshold, far, tar) at each distinct score, and one point above the largest."""
    sums = range_prefix(hist, groups)
    totals_ = _totals(hist, groups)
    points = sums.join(totals_, groups).select(*groups, F.col("score").alias("threshold"), (F.col("i_sum") / F.col("ni")).alias("far"), (F.col("g_sum") / F.col("ng")).alias("tar"))
    above = totals_.select(*groups, F.expr("reflect('java.lang.Math', 'nextUp', top)").cast("double").alias("threshold"), F.lit(0.0).alias("far"), F.lit(0.0).alias("tar"))
    return points.unionByName(above)


def auc(hist: DataFrame, groups: list[str]) -> DataFrame:
    """P(genuine > impostor) + half the ties, exact, from prefix sums of impostors."""
    sums = range_prefix(hist, groups).join(_totals(hist, groups), groups)
    lower = F.col("ni") - F.col("i_sum")  # impostors below the score
    terms = sums.withColumn("_t", F.col("g") * (lower + 0.5 * F.col("i")))
    return terms.groupBy(*groups).agg((F.sum("_t") / (F.first("ng") * F.first("ni"))).alias("auc"))


def operating_points(curve: DataFrame, groups: list[str], most_far: float = 0.01) -> DataFrame:
    """Equal-error point (first in descending threshold) and best TAR with FAR at most `most_far`."""
    gap = F.abs(F.col("far") - (1.0 - F.col("tar")))
    point = F.struct("threshold", "far", "tar")
    eer = F.min_by(point, F.struct(gap, -F.col("threshold")))
    best = F.max_by(F.when(F.col("far") <= most_far, point), F.when(F.col("far") <= most_far, F.struct("tar", "far", -F.col("threshold"))))
    found = curve.groupBy(*groups).agg(eer.alias("e"), best.alias("b"))
    return found.select(
        *groups, ((F.col("e.far") + (1.0 - F.col("e.tar"))) / 2.0).alias("eer"), F.col("e.threshold").alias("eer_threshold"),
        F.col("b.tar").alias("tar_at_far"), F.col("b.far").alias("actual_far"), F.col("b.threshold").alias("far_threshold"),
    )


def operational(rows: DataFrame, points: DataFrame, groups: list[str], score: str, genuine: Column, ok: Column) -> DataFrame:
    """Fail-closed rates at the chosen threshold: failed rows count in the denominator, never as accepted.

    A group without a successful genuine or impostor score has no curve and no
    threshold: it stays, with its counts, no rates, and the `reason`.
    """
    hit = F.coalesce(ok & (F.col(score) >= F.col("far_threshold")), F.lit(False))
    joined = rows.join(points.select(*groups, "far_threshold"), groups, "left")
    found = joined.groupBy(*groups).agg(
        F.count_if(genuine).alias("genuine_requested"), F.count_if(genuine & ok).alias("genuine_successful"),
        F.count_if(~genuine).alias("impostor_requested"), F.count_if(~genuine & ok).alias("impostor_successful"),
        F.count_if(genuine & hit).alias("_g"), F.count_if(~genuine & hit).alias("_i"),
    )
    reason = F.when(F.col("genuine_successful") == 0, "no_successful_genuine_score").when(F.col("impostor_successful") == 0, "no_successful_impostor_score")
    rate = lambda n, of: F.when(F.col("reason").isNull(), F.try_divide(F.col(n), F.col(of)))
    return found.withColumn("reason", reason).withColumns({"operational_tar": rate("_g", "genuine_requested"), "operational_far": rate("_i", "impostor_requested")}).drop("_g", "_i")


def screened_summary(rows: DataFrame, groups: list[str], score: str, genuine: Column, ok: Column) -> DataFrame:
    """AUC, operating points and fail-closed rates of every group, refused ones with their reason."""
    hist = score_histogram(rows.filter(ok), groups, score, genuine)
    points = operating_points(roc(hist, groups), groups)
    rates = operational(rows, points, groups, score, genuine, ok)
    return rates.join(auc(hist, groups), groups, "left").join(points, groups, "left")
