"""Reproducible cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import joined_sha256
from ..sources.publish import staged
from .sampling import ranked_in_groups


def selection_hash(version: str, seed: str, stratum: Column, subject: Column) -> Column:
    """SHA-256 of version, seed, stratum and subject, joined by newlines."""
    return joined_sha256(F.lit(version), F.lit(seed), stratum.cast("string"), subject.cast("string"))


def hash_ranked(candidates: DataFrame, version: str, seed: str, stratum: str = "stratum", subject: str = "subject", k: int | None = None) -> DataFrame:
    """Rank inside each stratum by hash, then subject. With k, Spark cuts every task's candidates to k before the shuffle."""
    hashed = candidates.withColumn("selection_hash", selection_hash(version, seed, F.col(stratum), F.col(subject)))
    if k is None:  # all ranks: strata are few, so ranges of hashes are ranked and their counts added
        return ranked_in_groups(hashed, [stratum], ["selection_hash", subject], "selection_rank", 1)
    ranked = hashed.withColumn("selection_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("selection_hash", subject)).cast("bigint"))
    return ranked.filter(F.col("selection_rank") <= k)


def proposals(left: DataFrame, k: int, stratum: str = "stratum", subject: str = "subject") -> DataFrame:
    """The first k of each stratum among the candidates that are left, with their ranks."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("selection_hash", subject)).cast("bigint")
    return left.withColumn("selection_rank", rank).filter(F.col("selection_rank") <= k)


def select_cohort(candidates: DataFrame, strata: list[str], k: int, version: str, seed: str, stratum: str = "stratum", subject: str = "subject", whole: bool = False) -> DataFrame:
    """The first k of each stratum in turn, a subject chosen once being excluded later.

    All strata choose at once, in rounds of deferred acceptance: each proposes
    its k best candidates that have not refused it, a subject keeps the earliest
    stratum in `strata` that has ever proposed and refuses the others for good,
    and rounds end when nobody refuses.  Strata that are earlier for all subjects
    make this the choice in turn, the only stable one.  A stratum can be refused
    by no more than k × (strata before it) subjects, so one ranked pass cuts the
    candidates to k × strata each, before the shuffle, and rounds run on that.

    With `whole`, a stratum of fewer than k is refused (W2's failure); without,
    it is left short and `cohort_faults` names it.
    """
    best = hash_ranked(candidates.filter(F.col(stratum).isin(*strata)), version, seed, stratum, subject, k * len(strata))
    turn = F.array_position(F.array(*map(F.lit, strata)), F.col(stratum).cast("string"))
    left = staged(best.select(stratum, subject, "selection_hash", turn.alias("_turn")))
    while True:
        asked = staged(proposals(left, k, stratum, subject))
        held = asked.groupBy(subject).agg(F.min("_turn").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(subject, "_first")
        if held.isEmpty():
            break
        left = staged(left.join(held, subject, "left").filter("_first IS NULL OR _turn <= _first").drop("_first"))
    chosen = asked.drop("_turn")
    if whole:
        short = {r[0]: r[1] for r in chosen.groupBy(stratum).count().collect()}  # a row a stratum
        for name in strata:
            if short.get(name, 0) < k:
                raise ValueError(f"stratum {name} has {short.get(name, 0)} of {k} candidates")
    return chosen


def circular_pairs(cohort: DataFrame, stratum: str = "stratum", subject: str = "subject") -> DataFrame:
    """Each subject's impostor is the next one by rank, the last one's the first."""
    by_rank = Window.partitionBy(stratum).orderBy("selection_rank")
    whole = Window.partitionBy(stratum).orderBy("selection_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(by_rank), F.first(c).over(whole))
    return cohort.select(
        stratum, F.col(subject).alias("probe"), nxt(subject).alias("candidate"),
        F.col("selection_rank").alias("rank_probe"), nxt("selection_rank").alias("rank_candidate"),
    )


def bijection_report(pairing: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Per stratum counts of probes and candidates, self pairs, and candidates that are no probe."""
    sides = pairing.select(stratum, F.explode(F.array(F.struct(F.lit(1).alias("p"), F.lit(0).alias("c"), F.col("probe").alias("s")), F.struct(F.lit(0).alias("p"), F.lit(1).alias("c"), F.col("candidate").alias("s")))).alias("x"))
    per = sides.groupBy(stratum, "x.s").agg(F.sum("x.p").alias("p"), F.sum("x.c").alias("c"))
    found = per.groupBy(stratum).agg(F.count_if(F.expr("p > 0")).alias("probes"), F.count_if(F.expr("c > 0")).alias("candidates"), F.count_if(F.expr("c > 0 AND p = 0")).alias("outside"), F.count_if(F.expr("p <> 1 OR c <> 1")).alias("unbalanced"))
    selves = pairing.groupBy(stratum).agg(F.count("*").alias("pairs"), F.count_if(F.col("probe") == F.col("candidate")).alias("self_pairs"))
    return found.join(selves, stratum).withColumn("is_bijection", (F.col("unbalanced") == 0) & (F.col("self_pairs") == 0) & (F.col("outside") == 0))


def cohort_faults(cohort: DataFrame, k: int, stratum: str = "stratum", subject: str = "subject") -> DataFrame:
    """Per stratum size, distinct subjects, and whether the ranks are exactly 1..k."""
    rank = F.col("selection_rank").cast("bigint")
    bits = cohort.groupBy(stratum, F.bitmap_bucket_number(rank).alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(rank)).alias("_m"), F.min(rank).alias("_lo"), F.max(rank).alias("_hi"), F.count("*").alias("_n"))
    exact = (F.min("_lo") == 1) & (F.max("_hi") == k) & (F.sum(F.bitmap_count("_m")) == k) & (F.sum("_n") == k)
    ranks = bits.groupBy(stratum).agg(F.sum("_n").alias("rows"), exact.alias("ranks_exact"))
    subjects = cohort.groupBy(stratum, subject).agg(F.lit(1)).groupBy(stratum).agg(F.count(subject).alias("subjects"))
    return ranks.join(subjects, stratum).select(stratum, "rows", "subjects", "ranks_exact")
