"""File discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import file_digests


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) below a root; contents are pruned, so nothing is read but the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that Spark uses for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_dataset(spark: SparkSession, dataset: str, roots: dict[str, str], pattern: str = "*") -> DataFrame:
    """Captures of one dataset's side directories; a missing directory is an error row, not an exception."""
    schema = "dataset string, side string, path string, length bigint, error_message string"
    found = [scan_files(spark, r, pattern).select(F.lit(dataset).alias("dataset"), F.lit(s).alias("side"), "path", "length", F.lit(None).cast("string").alias("error_message")) for s, r in roots.items() if exists(spark, r)]
    missing = [(dataset, s, r, None, "missing_directory") for s, r in roots.items() if not exists(spark, r)]
    return reduce(DataFrame.unionByName, found + [spark.createDataFrame(missing, schema)])


def scan_all(spark: SparkSession, datasets: dict[str, dict[str, str]], pattern: str = "*") -> DataFrame:
    """S2, U4."""
    return reduce(DataFrame.unionByName, [scan_dataset(spark, d, roots, pattern) for d, roots in datasets.items()])


def load_tagged(spark: SparkSession, paths: list[str], schema: str, tag: str, digests: bool = False) -> DataFrame:
    """One read of several CSV manifests; rows carry their file, the tag that the pattern finds in its path, and, with `digests`, the file's SHA-256."""
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths)
    file = F.col("_metadata.file_path")
    tagged = rows.select("*", file.alias("file"), F.regexp_extract(file, tag, 1).alias("tag"))
    if not digests:
        return tagged
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  the two listings write local paths differently
    sums = reduce(DataFrame.unionByName, [file_digests(spark, p) for p in paths]).select(plain("path").alias("_f"), "sha256").distinct()
    return tagged.withColumn("_f", plain("file")).join(sums, "_f", "left").drop("_f")
