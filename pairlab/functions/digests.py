"""Digests (F3, F4, A24-A27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Files of a piece of a list's text; a batch of 10,000 pieces is some 30 MB.
LISTED = 32
#: Stores whose addresses Arrow opens.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def joined_sha256(*parts: Column) -> Column:
    """SHA-256 of the parts joined by newlines."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def is_sha256(text: Column) -> Column:
    """F4."""
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def row_text(columns: list[Column]) -> Column:
    """One row in canonical text: values by unit separators, null marked."""
    return F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])


def config_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with its fields in name order; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"}), 256)


def ordered_digest(df: DataFrame, ordinal: str, columns: list[str], groups: list[str] | None = None, bucket_rows: int = 10000) -> DataFrame:
    """Digest of rows in ordinal order per group, over the named columns only.

    Rows are hashed, hashes are joined in order inside buckets of `bucket_rows`
    consecutive ordinals, and so are the buckets' digests, three times over: no
    gather is wider than a bucket up to its fourth power of rows, and the result
    does not depend on the partitioning.
    """
    groups = groups or []
    rows = df.select(*groups, ordinal, F.sha2(row_text([F.col(c) for c in columns]), 256).alias("h"))
    rows = rows.withColumn("bucket", F.floor(F.col(ordinal) / bucket_rows))
    ordered = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda s: s["h"]), "\n")
    buckets = rows.groupBy(*groups, "bucket").agg(F.sha2(ordered(ordinal), 256).alias("h"), F.count("*").alias("n"))
    buckets = buckets.withColumn("b", F.lit(1).cast("bigint"))
    for _ in range(2):
        up = F.floor(F.col("bucket") / bucket_rows).alias("up")
        buckets = buckets.groupBy(*groups, up).agg(F.sha2(ordered("bucket"), 256).alias("h"), F.sum("n").alias("n"), F.sum("b").alias("b")).withColumnRenamed("up", "bucket")
    return buckets.groupBy(*groups).agg(F.sum("n").alias("n_rows"), F.sum("b").alias("n_buckets"), F.sha2(ordered("bucket"), 256).alias("digest"))


def list_digest(df: DataFrame, groups: list[str], key: str, sha: str, most: int | None = None) -> DataFrame:
    """Digest of a list of (path, sha) ordered by path, per group, as one JSON text, which is what makes it comparable elsewhere.

    Lists may have any length: rows are sorted and written as text in ranges by
    many tasks, `LISTED` files a piece.  SHA-256 is one chain, so the pieces of a
    group come in order to one task, which hashes them as a stream and never
    holds the text.  Groups with more than `most` files, if given, have no digest.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(n) for g, n in zip(groups, named)], F.col(key).alias("path"), F.col(sha).alias("sha256"))
    dealt = rows.repartitionByRange(parts, *named, "path", "sha256").withColumn("_p", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy(*named, "_p").orderBy("path", "sha256")) - 1
    files = dealt.select(*named, "_p", place.alias("_r"), F.to_json(F.struct("path", "sha256")).alias("file"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_r", "file"))), lambda s: s["file"])
    pieces = files.groupBy(*named, "_p", F.floor(F.col("_r") / LISTED).alias("_b")).agg(F.count("*").alias("n"), F.array_join(ordered, ",").alias("text"))
    of_group = F.row_number().over(Window.partitionBy(*named).orderBy("_p", "_b"))
    chain = pieces.select(*named, of_group.alias("at"), "n", "text")
    width = len(groups)

    def hashed(batches):  # all its parts are nested, so workers need no import of this package
        import hashlib

        import pyarrow as pa

        h, files, group = None, 0, []

        def done():
            h.update(b"]")
            return pa.RecordBatch.from_arrays([*group, pa.array([h.hexdigest()]), pa.array([files], pa.int64())], [*named, "digest", "n_files"])

        for b in batches:
            for i, (at, n, text) in enumerate(zip(*[b.column(width + j).to_pylist() for j in range(3)])):
                if at == 1 and h:
                    yield done()
                if at == 1:
                    h, files, group = hashlib.sha256(b"["), 0, [b.column(j).slice(i, 1) for j in range(width)]
                else:
                    h.update(b",")
                h.update(text.encode())
                files += n
        if h:
            yield done()

    schema = StructType([*rows.select(*named).schema.fields, StructField("digest", StringType()), StructField("n_files", LongType())])
    found = chain.mapInArrow(hashed, schema)
    if not groups:  # an empty list has a digest too
        found = found.agg(F.coalesce(F.max("digest"), F.sha2(F.lit("[]"), 256)).alias("digest"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"))
    digest = F.col("digest") if most is None else F.when(F.col("n_files") <= most, F.col("digest"))
    return found.select(*[F.col(n).alias(g) for n, g in zip(named, groups)], digest.alias("digest"), "n_files")


def file_digests(spark, path: str, chunk: int = 8 << 20) -> DataFrame:
    """(path, length, sha256) of every file below a path, of any size.

    Files are listed by Spark and dealt over tasks by their own row; a task reads
    each in ranges of `chunk` bytes, so it holds one range whatever the length.
    An empty file has no row, as in every listing of Spark's.
    Stores that Arrow cannot open by their address are read by Spark's own
    reader, which takes files of up to 2 GB.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = listing.select("path", "length").withColumn("opens", F.lower(F.regexp_extract("path", "^([A-Za-z0-9+.-]+):", 1)).isin("", *OPENED))

    def read(batches):  # all its parts are nested, so workers need no import of this package
        import hashlib
        import re
        from urllib.parse import quote

        import pandas as pd
        from pyarrow import fs

        for rows in batches:
            digests = []
            for name in rows["path"]:
                address = re.sub("^s3a:", "s3:", re.sub("^file:/+", "file:///", name))
                store, inner = fs.FileSystem.from_uri(quote(address, safe=":/@"))  # Spark lists names as they are
                h = hashlib.sha256()
                with store.open_input_file(inner) as f:
                    while part := f.read(chunk):
                        h.update(part)
                digests.append(h.hexdigest())
            yield pd.DataFrame({"path": rows["path"], "length": rows["length"], "sha256": digests})

    if not files.filter("NOT opens").isEmpty():
        return listing.select("path", "length", F.sha2("content", 256).alias("sha256"))
    dealt = files.select("path", "length").repartition(4 * spark.sparkContext.defaultParallelism, "path", "length")
    return dealt.mapInPandas(read, "path string, length bigint, sha256 string")
