"""Operator 4: mixing sources to target weights by systematic sampling (DataFrame functions only).

Within a source every document has the same expected number of copies,
target / source size.  Documents are ordered by size, their expected copies are
prefix-summed, one random offset per source is added, and a document is emitted
once per integer boundary that its interval crosses.  The order by size makes
the words taken follow the target closely.

The prefix sum has two levels: groups (source, size bucket, salt of the id) are
counted, counts are summed per source over its few groups, and ranks inside a
group are added, so a source with a third of all documents is spread over many
tasks.  Source targets are found by water filling: a few aggregations over the
table of sources, each bringing one row to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table

WEIGHTS, MOST_COPIES, SEED = (5, 2, 1), 3, "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """(sk, sn, source_size) → plus target double, rate double, start double in [0, 1).

    Sources take the weights in code-point order, null last, repeating.  Ranks
    come from a range partitioning and partition counts, not from one task.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(sizes.repartitionByRange(parts, "sn", "sk").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("sn", "sk")) - 1
    ranked = ranged.withColumn("in_part", rank).join(offsets, "part")
    place = F.pmod(F.col("in_part") + F.col("before"), F.lit(len(weights)))
    ranked = staged(ranked.select("sk", "sn", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("bigint").alias("w")))
    whole = ranked.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    total, weight = int(whole["t"] or 0), int(whole["w"] or 0)
    num, den = total, weight
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    above = lambda n, d: big(n) * F.col("w") > big(most) * F.col("source_size") * big(d)
    while den:
        capped = ranked.filter(above(num, den)).agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).first()
        now = total - most * int(capped["s"] or 0), weight - int(capped["w"] or 0)
        if now == (num, den):
            break
        num, den = now
    shared = (F.col("w") * F.lit(num)).cast("double") / F.lit(float(den or 1))
    most_of = (F.lit(most) * F.col("source_size")).cast("double")
    target = F.when(above(num, den) if den else F.lit(True), most_of).otherwise(shared)
    text = F.concat(F.lit(seed + "|"), F.when(F.col("sn"), "null").otherwise(F.concat(F.lit("s"), "sk")))
    start = F.conv(F.substring(F.sha2(text, 256), 1, 10), 16, 10).cast("bigint").cast("double") / F.lit(float(2**40))
    out = ranked.select("sk", "sn", "source_size", target.alias("target"), start.alias("start"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """(_row struct of all columns, doc_id, size, source_size, target, copies) of every row.

    Null texts have size 0; null sources form one source, null ids order first;
    repeated rows are sampled once each; an empty table gives no rows; a source
    of size 0 has target 0; a very long text counts with its whole size.  Other
    columns may have any names.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("doc_id").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("sk"),
        F.col("source").isNull().alias("sn"),
        size_of(F.col("text")).alias("size"),
        F.xxhash64("text").alias("tie"),
    ).withColumns({
        "bucket": F.floor(F.sqrt(F.col("size").cast("double"))).cast("bigint"),
        "salt": F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2),
    })
    key = ["sk", "sn", "bucket", "salt"]
    groups = staged(rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("group_size")))
    targets = source_targets(groups.groupBy("sk", "sn").agg(F.sum("group_size").alias("source_size")), weights, most, seed)
    before = Window.partitionBy("sk", "sn").orderBy("bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(targets, ["sk", "sn"])
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("size", "doc_id", "tie"))
    ranked = rows.withColumn("rank", inside).join(placed.drop("n", "group_size"), key)
    last = (F.col("before") + F.col("rank")).cast("double")
    crossed = F.floor(last * F.col("rate") + F.col("start")) - F.floor((last - 1) * F.col("rate") + F.col("start"))
    copies = F.least(crossed, F.lit(most)).cast("bigint")
    return ranked.select("_row", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS sk, source IS NULL AS sn,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size FROM documents
), s AS (
  SELECT sk, sn, sum(size)::bigint AS source_size, (row_number() OVER (ORDER BY sn, sk) - 1) % 3 AS place FROM d GROUP BY sk, sn
), w AS (
  SELECT *, CASE place WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), o AS (
  SELECT *, sum(source_size) OVER () AS t, sum(w) OVER () AS tw,
         coalesce(sum(source_size) OVER (ORDER BY source_size * 1.0::double / w, sn, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cs,
         coalesce(sum(w) OVER (ORDER BY source_size * 1.0::double / w, sn, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cw FROM w
), level AS (
  SELECT t - 3 * cs AS num, tw - cw AS den FROM o WHERE (t - 3 * cs) * w <= 3 * source_size * (tw - cw) ORDER BY cw LIMIT 1
), targets AS (
  SELECT sk, sn, source_size,
         CASE WHEN num * w > 3 * source_size * den THEN (3 * source_size)::double ELSE (w * num)::double / den::double END AS target,
         ('0x' || substring(sha256('mix-1|' || CASE WHEN sn THEN 'null' ELSE 's' || sk END), 1, 10))::bigint::double / 1099511627776.0::double AS start
  FROM o, level
), ranked AS (
  SELECT doc_id, size, sk, sn, row_number() OVER (PARTITION BY sk, sn ORDER BY floor(sqrt(size::double)), substring(md5(coalesce(doc_id::varchar, '')), 1, 2), size, doc_id)::double AS r FROM d
)
SELECT doc_id, size, source_size, target,
       (size * least(floor(r * rate + start) - floor((r - 1) * rate + start), 3))::bigint AS taken
FROM ranked JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::double ELSE 0 END AS rate FROM targets) USING (sk, sn)
"""
