"""Strict readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .publish import staged

MANIFEST = (
    "pair_id string, dataset string, protocol string, subject_id string, canonical_finger_position int, ppi int, "
    "raw_frgp_a int, raw_frgp_b int, path_a string, path_b string"
)


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The header must equal the schema's names in order, and no row may have extra cells; both fail the read."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.option("nullValue", "").csv(path)


def tolerant_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: like `strict_csv`, but a cell that does not parse becomes null and stays, as text, in `_corrupt`."""
    fields = T.StructType.fromDDL(schema).fields
    text = strict_csv(spark, path, ", ".join(f"`{f.name}` string" for f in fields))
    typed = {f.name: F.trim(f.name).try_cast(f.dataType) for f in fields}
    bad = [F.when(F.col(n).isNotNull() & c.isNull(), F.concat_ws("=", F.lit(n), F.col(n))) for n, c in typed.items()]
    corrupt = F.array_join(F.filter(F.array(*bad), lambda x: x.isNotNull()), ";")
    return text.select(*[c.alias(n) for n, c in typed.items()], F.nullif(corrupt, F.lit("")).alias("_corrupt"))


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, record, text) of the records of CSV files, in which quoted cells may hold newlines; files are read in splits.

    A line starts a record if an even number of quotes stands before it in its
    file.  Every split counts the quotes before its lines and in all of it; the
    splits' counts, one row each, are summed along the file, and that tells each
    split whether it begins inside a cell.  Lines of a record that one split
    ends and others go on with meet by the split and number of its first line.
    """
    file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", file, block, F.monotonically_increasing_id().alias("i"))
    lines = lines.withColumn("q", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    split = Window.partitionBy("file", "block").orderBy("i")
    odd = F.coalesce(F.sum("q").over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    lines = lines.withColumn("odd", odd).withColumns({f"r{k}": F.count_if(F.col("odd") == k).over(split.rowsBetween(Window.unboundedPreceding, 0)) for k in (0, 1)})
    lines = staged(lines)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = lines.groupBy("file", "block").agg((F.sum("q") % 2).alias("odd"), F.count_if(F.col("odd") == 0).alias("s0"), F.count_if(F.col("odd") == 1).alias("s1"))
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).withColumn("starts", F.when(F.col("inside") == 0, F.col("s0")).otherwise(F.col("s1")))
    splits = splits.withColumn("last", F.max(F.when(F.col("starts") > 0, F.struct("block", "starts"))).over(before)).select("file", "block", "inside", "last")
    number = F.when(F.col("inside") == 0, F.col("r0")).otherwise(F.col("r1"))
    met = lines.join(splits, ["file", "block"]).withColumn("n", number)
    own = F.when(F.col("n") > 0, F.struct("block", F.col("n").alias("starts"))).otherwise(F.col("last"))
    met = met.select("file", own.alias("own"), "block", "i", "value", ((F.col("odd") == F.col("inside")) & (F.col("q") % 2 == 0)).alias("whole"))
    one = met.filter("whole").select("file", "own.block", F.col("own.starts").alias("record"), F.col("value").alias("text"))
    parts = met.filter("NOT whole").groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("block", "i", "value"))).alias("parts"))
    joined = parts.select("file", "own.block", F.col("own.starts").alias("record"), F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("text"))
    return one.unionByName(joined).withColumn("text", F.regexp_replace("text", "\r$", ""))


def text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All cells as text, of any length, with quoted newlines; the header must hold these names in order.  Large files are read by several tasks."""
    records = staged(quoted_records(spark, path))
    schema = ", ".join(f"`{c}` string" for c in columns)
    cells = lambda c: F.from_csv(c, F.lit(schema), {"escape": '"', "maxCharsPerColumn": "-1"})
    first = (F.col("block") == 0) & (F.col("record") == 1)
    header = F.struct(*[F.lit(c).alias(c) for c in columns])
    wrong = records.filter(first & ~cells(F.col("text")).eqNullSafe(header)).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['file']}: the header is {wrong[0]['text']!r}, not {columns}")
    return records.filter(~first & (F.col("text") != "")).select(cells(F.col("text")).alias("r")).select("r.*")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a file, with a schema or as variant; anything else is marked in `is_object`."""
    if schema:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    text = spark.read.option("wholetext", True).text(path).withColumn("document", F.try_parse_json("value"))
    return text.select(F.col("_metadata.file_path").alias("file"), "document", F.coalesce(F.startswith(F.schema_of_variant("document"), F.lit("OBJECT<")), F.lit(False)).alias("is_object"))


def manifest_faults(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, rule) for empty cells and repeated ids."""
    empty = [F.when(F.col(c).isNull(), F.lit(f"empty:{c}")) for c in columns]
    cells = rows.select(key, F.explode(F.filter(F.array(*empty), lambda x: x.isNotNull())).alias("rule"))
    repeated = rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, F.lit("repeated_id").alias("rule"))
    return cells.unionByName(repeated)
