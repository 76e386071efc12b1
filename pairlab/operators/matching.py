"""Nearest-neighbour matching inside groups.

Small point sets, of a few hundred points, are joined whole on their group.  In
larger ones distances are pruned by pivots: points of the searched set stand in
the cell of their nearest pivot, a query finds two neighbours in its own cell
first, and then looks only into cells, and there only at points, that the
triangle inequality leaves within the distance of the second.  Both give the
same rows.  Cells are the units that meet in a join, so a large set is split
over tasks however large it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_distance
from ..sources.publish import staged

#: Points of a set that is compared whole, and pivots of a larger one at most.
FEW, PIVOTS = 512, 256
_MODES = ("one_way", "mutual", "bidirectional_union")


def distances(a: DataFrame, b: DataFrame, group: list[str], digits: int | None = None) -> DataFrame:
    """(group, ia, ib, d) of every pair of points of a group; inputs have (group, idx, v)."""
    left = a.select(*group, F.col("idx").alias("ia"), F.col("v").alias("va"))
    right = b.select(*group, F.col("idx").alias("ib"), F.col("v").alias("vb"))
    d = l2_distance(F.col("va"), F.col("vb"))
    return left.join(right, group).select(*group, "ia", "ib", (d if digits is None else F.round(d, digits)).alias("d"))


def nearest_two(dist: DataFrame, group: list[str], query: str, train: str) -> DataFrame:
    """(group, query, train, d1, d2); d2 is null for a lone neighbour; ties go to the smaller index."""
    w = Window.partitionBy(*group, query).orderBy("d", train)
    top = dist.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    return top.groupBy(*group, query).agg(
        F.max(F.when(F.col("_r") == 1, F.col(train))).alias(train), F.max(F.when(F.col("_r") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("_r") == 2, F.col("d"))).alias("d2")
    )


def pivots_of(train: DataFrame, group: list[str]) -> DataFrame:
    """(group, ps): some points of each set, by hash: the root of their number, `PIVOTS` at most."""
    sizes = train.groupBy(*group).agg(F.least(F.ceil(F.sqrt(F.count("*"))), F.lit(PIVOTS)).alias("_k"))
    by_hash = Window.partitionBy(*group).orderBy(F.xxhash64("idx"), "idx")
    first = train.select(*group, "idx", "v").withColumn("_r", F.row_number().over(by_hash)).filter(F.col("_r") <= PIVOTS)
    return first.join(sizes, group).filter("_r <= _k").groupBy(*group).agg(F.collect_list("v").alias("ps"))


def _placed(points: DataFrame, pivots: DataFrame, group: list[str]) -> DataFrame:
    """(group, idx, v, ds, cell, own): distances to the pivots, the nearest pivot and its distance."""
    ds = F.transform("ps", lambda p: l2_distance(F.col("v"), p))
    return points.join(pivots, group).select(*group, "idx", "v", ds.alias("ds")).withColumn("own", F.array_min("ds")).withColumn("cell", F.array_position("ds", F.col("own")).cast("int") - 1)


def pruned_pairs(query: DataFrame, train: DataFrame, group: list[str], digits: int | None = None) -> DataFrame:
    """(group, ia, ib, d): pairs among which are the two nearest of every query point, found by pivots.

    Bounds are taken with a margin for rounding, so no tie is lost.
    """
    pivots = staged(pivots_of(train, group))
    there = staged(_placed(train, pivots, group).drop("ds"))
    asked = staged(_placed(query, pivots, group))
    cells = there.groupBy(*group, "cell").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("n"))
    margin = 0.0 if digits is None else 10.0**-digits
    inside = asked.select(*group, "cell", F.col("idx").alias("ia"), F.col("v").alias("va")).join(there.select(*group, "cell", F.col("idx").alias("ib"), F.col("v").alias("vb")), [*group, "cell"])
    exact = inside.select(*group, "ia", "ib", l2_distance(F.col("va"), F.col("vb")).alias("d"))
    near = exact.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "ia").orderBy("d", "ib"))).filter("_r <= 2")
    near = staged(near.select(*group, "ia", "ib", "d"))
    second = near.groupBy(*group, "ia").agg(F.when(F.count("*") > 1, F.max("d")).alias("_two"))
    listed = cells.groupBy(*group).agg(F.collect_list(F.struct("cell", "lo", "hi", "n")).alias("cs"))  # a row a pivot
    bounded = asked.join(second.withColumnRenamed("ia", "idx"), [*group, "idx"], "left").join(listed, group)
    # every cell has a point within d + lo, and a cell of two or more another within d + hi
    reach = F.array_sort(F.flatten(F.transform("cs", lambda c: F.when(c["n"] > 1, F.array(F.get("ds", c["cell"]) + c["lo"], F.get("ds", c["cell"]) + c["hi"])).otherwise(F.array(F.get("ds", c["cell"]) + c["lo"])))))
    limit = F.coalesce(F.least("_two", F.get(reach, F.lit(1))), F.lit(float("inf")))
    bounded = bounded.withColumn("_most", limit * (1 + 1e-9) + margin + 1e-12)
    least = lambda c: F.greatest(c["lo"] - F.get("ds", c["cell"]), F.get("ds", c["cell"]) - c["hi"], (F.get("ds", c["cell"]) - F.col("own")) / 2)
    others = F.filter("cs", lambda c: (c["cell"] != F.col("cell")) & (least(c) <= F.col("_most")))
    sought = bounded.select(*group, F.col("idx").alias("ia"), F.col("v").alias("va"), "ds", "_most", F.explode(others).alias("c")).select(*group, "ia", "va", "_most", F.col("c.cell").alias("cell"), F.get("ds", F.col("c.cell")).alias("_d"))
    met = sought.join(there.select(*group, "cell", F.col("idx").alias("ib"), F.col("v").alias("vb"), "own"), [*group, "cell"]).filter(F.abs(F.col("own") - F.col("_d")) <= F.col("_most"))
    found = near.unionByName(met.select(*group, "ia", "ib", l2_distance(F.col("va"), F.col("vb")).alias("d")))
    return found if digits is None else found.withColumn("d", F.round("d", digits))


def two_nearest(query: DataFrame, train: DataFrame, group: list[str], digits: int | None = None, few: int = FEW) -> DataFrame:
    """(group, ia, ib, d1, d2): a query point's nearest of its group's train points, and the second's distance; inputs have (group, idx, v).

    Sets of at most `few` train points are compared whole, larger ones by pivots.
    """
    sizes = staged(train.groupBy(*group).agg((F.count("*") > few).alias("_large")))
    if sizes.filter("_large").isEmpty():
        return nearest_two(distances(query, train, group, digits), group, "ia", "ib")
    large = sizes.filter("_large").select(*group)
    one = lambda df: df.join(large, group, "left_semi")
    rest = lambda df: df.join(large, group, "left_anti")
    pairs = distances(rest(query), rest(train), group, digits).unionByName(pruned_pairs(one(query), one(train), group, digits))
    return nearest_two(pairs, group, "ia", "ib")


def both_ways(a: DataFrame, b: DataFrame, group: list[str], digits: int | None = None, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """K1: (forward, reverse) nearest neighbours of two point sets, both with ia of `a` and ib of `b`, staged."""
    back = two_nearest(b, a, group, digits, few).select(*group, F.col("ib").alias("ia"), F.col("ia").alias("ib"), "d1", "d2")
    return staged(two_nearest(a, b, group, digits, few)), staged(back)


def ratio_kept(two: DataFrame, ratio: float) -> DataFrame:
    """The nearest is clearly nearer than an existing second one."""
    return two.filter(F.col("d2").isNotNull() & (F.col("d1") < F.lit(ratio) * F.col("d2")))


def mutual(forward: DataFrame, reverse: DataFrame, group: list[str]) -> DataFrame:
    """Forward matches that reverse has too."""
    return forward.join(reverse.select(*group, "ia", "ib"), [*group, "ia", "ib"], "left_semi")


def union_nearest(forward: DataFrame, reverse: DataFrame, group: list[str]) -> DataFrame:
    """Matches of either direction, the nearer record of each pair."""
    both = forward.unionByName(reverse)
    return both.groupBy(*group, "ia", "ib").agg(F.min(F.struct("d1", "d2")).alias("_m")).select(*group, "ia", "ib", "_m.d1", "_m.d2")


def match(two: tuple[DataFrame, DataFrame], group: list[str], ratio: float) -> DataFrame:
    """K1: (mode, group, ia, ib, d1, d2) of the three modes, from the neighbours of `both_ways`."""
    cols = [*group, "ia", "ib", "d1", "d2"]
    forward, reverse = (ratio_kept(x, ratio).select(cols) for x in two)
    found = dict(zip(_MODES, (forward, mutual(forward, reverse, group), union_nearest(forward, reverse, group))))
    return reduce(DataFrame.unionByName, [df.select(F.lit(mode).alias("mode"), *cols) for mode, df in found.items()])


def match_counts(two: tuple[DataFrame, DataFrame], matches: DataFrame, group: list[str], ratio: float) -> DataFrame:
    """K1: diagnostics per group."""
    asked = lambda df, n: df.groupBy(*group).agg(F.count("*").alias(n))
    per = matches.groupBy(*group).pivot("mode", list(_MODES)).count()
    kept_b = asked(ratio_kept(two[1], ratio), "ratio_b_to_a")
    out = asked(two[0], "knn_a_to_b").join(asked(two[1], "knn_b_to_a"), group).join(per, group, "left").join(kept_b, group, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*group, "knn_a_to_b", "knn_b_to_a", zero("one_way").alias("ratio_a_to_b"), zero("ratio_b_to_a").alias("ratio_b_to_a"), zero("mutual").alias("mutual"), zero("bidirectional_union").alias("bidirectional_union"))
