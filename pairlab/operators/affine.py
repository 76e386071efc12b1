"""Robust affine fits per pair as joins and aggregations.

Hypotheses are 2-point (partial, four degrees of freedom) or 3-point (full)
samples of a pair's matches.  Samples are drawn by a hash of the pair and the
draw's number, as many distinct ones as are asked for or there are, so runs
agree for any partitioning; degenerate ones are dropped.
Hypotheses are joined to their pair's matches and inliers are counted.  A pair
of many matches tries all of them on a part of its matches, drawn by a hash, and
only those that do best there on all.  The best hypothesis (most inliers, then
least residual sum) is refined by least squares over its inliers from sums alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.publish import staged
from .aggregates import residual_summary

MODEL = ["a", "b", "tx", "c", "d", "ty"]
#: Matches from which a pair tries hypotheses on a part first, the part's share, and the hypotheses that go on (and those that tie with the last).
MANY, PART, GO_ON = 2048, 32, 8


def _partial(p: list[Column]) -> list[Column]:
    """Similarity through two point pairs: the complex ratio (q2 - q1) / (p2 - p1)."""
    x1, y1, u1, v1, x2, y2, u2, v2 = p
    dx, dy, du, dv = x2 - x1, y2 - y1, u2 - u1, v2 - v1
    n = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    re, im = (du * dx + dv * dy) / n, (dv * dx - du * dy) / n
    return [re, -im, u1 - (re * x1 - im * y1), im, re, v1 - (im * x1 + re * y1)]


def _full(p: list[Column]) -> list[Column]:
    """Affine map through three point pairs, by Cramer's rule."""
    x1, y1, u1, v1, x2, y2, u2, v2, x3, y3, u3, v3 = p
    det = F.nullif((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1), F.lit(0.0))

    def row(w1, w2, w3):
        a = ((w2 - w1) * (y3 - y1) - (w3 - w1) * (y2 - y1)) / det
        b = ((x2 - x1) * (w3 - w1) - (x3 - x1) * (w2 - w1)) / det
        return [a, b, w1 - a * x1 - b * y1]

    return row(u1, u2, u3) + row(v1, v2, v3)


def _residual() -> Column:
    px = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("tx") - F.col("u")
    py = F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("ty") - F.col("v")
    return F.sqrt(px * px + py * py)


def drawn_samples(sizes: DataFrame, size: int, hypotheses: int) -> DataFrame:
    """(pair, k0 < k1 [< k2]) of `hypotheses` distinct samples of each pair's n matches, or of all there are; sizes are (pair, n).

    The j-th draw of a pair names one of its C(n, size) samples: a start by the
    pair's hash, then strides coprime to their number, so draws repeat only
    after all samples; the number becomes indices by the combinatorial number
    system.
    """
    n = F.col("n").cast("bigint")
    every = F.floor(n * (n - 1) / 2) if size == 2 else F.floor(n * (n - 1) * (n - 2) / 6)
    hashed = lambda salt: F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("pair").cast("string"), F.lit(salt)), 256), 1, 7), 16, 10).cast("bigint")
    tries = sizes.withColumn("all", every.cast("bigint")).withColumns({"start": F.pmod(hashed("start"), F.col("all")), "stride": F.pmod(hashed("stride"), F.col("all"))})
    gcd = "aggregate(sequence(1, 48), struct({a} AS a, {b} AS b), (s, _) -> if(s.b = 0, s, struct(s.b AS a, s.a % s.b AS b)), s -> s.a)"
    prime = F.expr(f"get(filter(transform(sequence(0, 63), i -> stride + i), x -> x > 0 AND {gcd.format(a='`all`', b='x')} = 1), 0)")
    tries = tries.withColumn("stride", F.coalesce(prime, F.lit(1)))
    drawn = tries.select("pair", "all", "start", "stride", F.explode(F.expr(f"sequence(0L, least(`all`, {hypotheses}L) - 1)")).alias("h"))
    rank = F.pmod(F.col("start") + F.pmod(F.col("h") * F.col("stride"), F.col("all")), F.col("all")).alias("s")
    samples = drawn.select("pair", rank)
    if size == 3:  # the largest k2 with C(k2, 3) <= s; the root is off by one at most
        root = F.floor(F.cbrt(6.0 * F.col("s")) + 1).cast("bigint")
        third = F.expr("get(filter(array(r + 2, r + 1, r, r - 1, r - 2, r - 3), x -> x >= 2 AND x * (x - 1) * (x - 2) div 6 <= s), 0)")
        samples = samples.withColumn("r", root).withColumn("k2", third).withColumn("s", F.expr("s - k2 * (k2 - 1) * (k2 - 2) div 6")).drop("r")
    root = F.floor(F.sqrt(2.0 * F.col("s")) + 1).cast("bigint")
    second = F.expr("get(filter(array(r + 1, r, r - 1, r - 2), x -> x >= 1 AND x * (x - 1) div 2 <= s), 0)")
    samples = samples.withColumn("r", root).withColumn("k1", second).withColumn("k0", F.expr("s - k1 * (k1 - 1) div 2"))
    return samples.select("pair", *[F.col(f"k{i}").cast("int").alias(f"k{i}") for i in range(size)])


def tried(fits: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """(pair, h, model, hits, sum_r) of every hypothesis over the points that are given."""
    near = F.when(F.col("r") <= threshold, F.col("r"))
    judged = fits.join(points, "pair", "left").withColumn("r", _residual())
    return judged.groupBy("pair", "h", *MODEL).agg(F.count(near).alias("hits"), F.coalesce(F.sum(near), F.lit(0.0)).alias("sum_r"))


def part_of(points: DataFrame) -> DataFrame:
    """The points (pair, idx, n, …) that hypotheses are tried on first: all of a small pair's."""
    return points.filter((F.col("n") < MANY) | (F.pmod(F.xxhash64("pair", "idx"), F.lit(PART)) == 0))


def going_on(first: DataFrame, sizes: DataFrame) -> DataFrame:
    """The hypotheses of large pairs that did best on the part."""
    best = F.rank().over(Window.partitionBy("pair").orderBy(F.desc("hits")))
    return first.join(sizes.filter(F.col("n") >= MANY).select("pair"), "pair", "left_semi").withColumn("_r", best).filter(F.col("_r") <= GO_ON).select("pair", "h", *MODEL)


def robust_affine(matches: DataFrame, pair: str = "pair", model: str = "partial", threshold: float = 3.0, hypotheses: int = 200, least: int = 3) -> DataFrame:
    """K3-K5: one row per pair of `matches` (pair, idx, x, y, u, v).

    Fewer than `least` matches, or only degenerate samples, is a valid zero with
    a reason, not a failure.
    """
    size = 2 if model == "partial" else 3
    numbered = matches.select(F.col(pair).alias("pair"), "idx", *[F.col(c).cast("double").alias(c) for c in "xyuv"])
    counts = numbered.groupBy("pair").agg(F.count("*").alias("n"))
    enough = counts.filter(F.col("n") >= least).select("pair", "n")
    points = numbered.join(enough, "pair")
    ranked = points.drop("n").withColumn("k", F.row_number().over(Window.partitionBy("pair").orderBy("idx")) - 1)
    samples = drawn_samples(enough, size, hypotheses)
    for i in range(size):
        side = ranked.select("pair", F.col("k").alias(f"k{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyuv"])
        samples = samples.join(side, ["pair", f"k{i}"])
    p = [F.col(f"{c}{i}") for i in range(size) for c in "xyuv"]
    made = (_partial if size == 2 else _full)(p)
    fits = samples.select("pair", F.concat_ws("-", *[f"k{i}" for i in range(size)]).alias("h"), *[c.alias(m) for c, m in zip(made, MODEL)]).filter(F.col("a").isNotNull())
    first = tried(fits, part_of(points), threshold)
    if not enough.filter(F.col("n") >= MANY).isEmpty():
        first = staged(first)
        small = first.join(enough.filter(F.col("n") < MANY).select("pair"), "pair", "left_semi")
        first = small.unionByName(tried(going_on(first, enough), points, threshold))
    scored = first
    best = scored.groupBy("pair").agg(F.max_by(F.struct(*MODEL), F.struct("hits", -F.col("sum_r"), "h")).alias("m")).select("pair", "m.*")
    inliers = points.join(best, "pair").withColumn("r", _residual()).filter(F.col("r") <= threshold)
    refined = _refit(inliers, size == 2).select("pair", *[F.col(f"_{m}").alias(m) for m in MODEL])
    final = points.join(refined, "pair").withColumn("r", _residual())
    hit = F.col("r") <= threshold
    inlier_r = F.when(hit, F.col("r"))
    result = final.groupBy("pair", *MODEL).agg(F.count_if(hit).alias("inliers"), *residual_summary(inlier_r, "residual"))
    out = counts.join(result, "pair", "left")
    reason = F.when(F.col("n") < least, "insufficient_geometry_matches").when(F.col("a").isNull(), "model_estimation_failure")
    det = F.col("a") * F.col("d") - F.col("b") * F.col("c")
    return out.select(
        F.col("pair").alias(pair), F.col("n").alias("matches"), F.coalesce("inliers", F.lit(0)).alias("inliers"),
        (F.col("n") - F.coalesce("inliers", F.lit(0))).alias("outliers"), F.try_divide(F.coalesce("inliers", F.lit(0)), F.col("n")).alias("inlier_ratio"),
        reason.alias("reason"), *MODEL, F.sqrt(F.abs(det)).alias("scale"), F.degrees(F.atan2("c", "a")).alias("rotation_degrees"),
        "residual_mean", "residual_median", "residual_p95", "residual_max",
    )


def _refit(inliers: DataFrame, partial: bool) -> DataFrame:
    """Least squares over inliers; a degenerate refit keeps the hypothesis."""
    means = inliers.groupBy("pair", *MODEL).agg(*[F.avg(c).alias(f"m{c}") for c in "xyuv"])
    c = inliers.select("pair", *"xyuv").join(means, "pair").withColumns({f"c{k}": F.col(k) - F.col(f"m{k}") for k in "xyuv"})
    s = lambda p, q: F.sum(F.col(f"c{p}") * F.col(f"c{q}")).alias(f"s{p}{q}")
    t = c.groupBy("pair", *MODEL, *[f"m{k}" for k in "xyuv"]).agg(s("x", "x"), s("y", "y"), s("x", "y"), s("x", "u"), s("y", "u"), s("x", "v"), s("y", "v"))
    if partial:
        n = F.nullif(F.col("sxx") + F.col("syy"), F.lit(0.0))
        a, cc = (F.col("sxu") + F.col("syv")) / n, (F.col("sxv") - F.col("syu")) / n
        b, d = -cc, a
    else:
        n = F.nullif(F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy"), F.lit(0.0))
        a, b = (F.col("sxu") * F.col("syy") - F.col("syu") * F.col("sxy")) / n, (F.col("syu") * F.col("sxx") - F.col("sxu") * F.col("sxy")) / n
        cc, d = (F.col("sxv") * F.col("syy") - F.col("syv") * F.col("sxy")) / n, (F.col("syv") * F.col("sxx") - F.col("sxv") * F.col("sxy")) / n
    made = {"_a": F.coalesce(a, "a"), "_b": F.coalesce(b, "b"), "_c": F.coalesce(cc, "c"), "_d": F.coalesce(d, "d")}
    t = t.withColumns(made)
    return t.withColumns({"_tx": F.col("mu") - F.col("_a") * F.col("mx") - F.col("_b") * F.col("my"), "_ty": F.col("mv") - F.col("_c") * F.col("mx") - F.col("_d") * F.col("my")})
