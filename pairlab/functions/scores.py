"""Score formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import finite

COUNT, RATIO, OVER_MIN, COMPOSITE = "geometric_inlier_count", "geometric_inlier_ratio", "inliers_over_min_keypoints", "inliers_times_inlier_ratio_times_log1p_matches"


def score_components(inliers: Column, matches: Column, points_a: Column, points_b: Column) -> Column:
    """map of the four components; zero counts give zeros."""
    i, m = inliers.cast("double"), matches.cast("double")
    ratio = F.when(m > 0, i / m).otherwise(0.0)
    over = i / F.greatest(F.lit(1.0), F.least(points_a, points_b).cast("double"))
    whole = F.when((i > 0) & (m > 0), i * ratio * F.log1p(m)).otherwise(0.0)
    return F.create_map(F.lit(COUNT), i, F.lit(RATIO), ratio, F.lit(OVER_MIN), over, F.lit(COMPOSITE), whole)


def score_of_mode(components: Column, mode: Column) -> Column:
    """struct<score, error>; an unknown mode or a value that is not finite and non-negative is an error, not a score."""
    x = F.try_element_at(components, mode)
    error = F.when(x.isNull(), "unsupported_score_mode").when(~finite(x) | (x < 0), "score_out_of_range")
    return F.struct(F.when(error.isNull(), x).alias("score"), error.alias("error"))
