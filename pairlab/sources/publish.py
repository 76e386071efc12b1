"""Sinks: staged tables, ordered exports, validate-then-publish, idempotent builds."""

from __future__ import annotations

import json
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class PublishError(RuntimeError):
    """A candidate broke a rule, or a different table is already there."""


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Without one, a local session (one process, as in tests) takes a temporary
    one; on a cluster there is no folder that all executors see, so it fails.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise PublishError("spark.checkpoint.dir is not set: staged tables need a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class _Runs(threading.local):
    """The runs that this thread is in: jobs in other threads stage elsewhere."""

    def __init__(self):
        self.names: list[str] = []


_RUNS = _Runs()


def staging_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, or that of the run in hand."""
    return "/".join([shared_dir(spark), spark.sparkContext.applicationId, *_RUNS.names])


@contextmanager
def staging_run(spark: SparkSession):
    """Tables staged inside go to a folder of their own, removed at the end; results must be written before."""
    _RUNS.names.append(f"run-{uuid.uuid4().hex}")
    fs, path = _fs(spark, staging_dir(spark))
    try:
        yield path.toString()
    finally:
        _RUNS.names.pop()
        fs.delete(path, True)


def staged(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, gives the planner a size."""
    spark = df.sparkSession
    path = at or f"{staging_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession, path: str | None = None) -> None:
    """Remove one staged table, or all of this application; call it once results that read them are written."""
    fs, p = _fs(spark, path or staging_dir(spark))
    fs.delete(p, True)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _in_place(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside the target and rename: the path holds a whole export or nothing; an existing path is refused."""
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise PublishError(f"already exported: {path}")
    candidate = f"{path}._candidate_{uuid.uuid4().hex}"
    _, source = _fs(spark, candidate)
    try:
        write(candidate)
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise PublishError(f"could not export: {path}")
    except BaseException:
        fs.delete(source, True)
        raise


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Header, LF, rows in order over range-partitioned files, renamed into place whole."""
    ordered = df.orderBy(*order)
    _in_place(df.sparkSession, path, lambda p: ordered.write.option("header", True).option("lineSep", "\n").option("escape", '"').csv(p))


def write_json(df: DataFrame, path: str) -> None:
    """One object a line with its keys in name order, renamed into place whole."""
    lines = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
    _in_place(df.sparkSession, path, lines.write.text)


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, others unchanged."""
    nested = lambda t: t.startswith(("struct", "array", "map"))
    return df.select(*[F.to_json(c).alias(c) if nested(t) else F.col(c) for c, t in df.dtypes])


def publish(df: DataFrame, path: str, checks: Callable[[DataFrame], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
    """Write a candidate, read it back, run the checks (rows are violations), then rename into place.

    On any violation the candidate is removed and nothing else has changed; an
    existing path is refused (S10).
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise PublishError(f"already published: {path}")
    candidate = f"{path}._candidate_{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(candidate)
    _, source = _fs(spark, candidate)
    faults = checks(spark.read.parquet(candidate)).limit(5).collect()  # five rows for the message
    if faults:
        fs.delete(source, True)
        raise PublishError(f"candidate broke rules: {[r.asDict() for r in faults]}")
    if not fs.rename(source, target):
        fs.delete(source, True)
        raise PublishError(f"could not publish: {path}")
    return spark.read.parquet(path)


def publish_or_reuse(df: DataFrame, path: str, checks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reuse what is published if it still passes the checks, else publish."""
    fs, target = _fs(df.sparkSession, path)
    if not fs.exists(target):
        return publish(df, path, checks)
    stored = df.sparkSession.read.parquet(path)
    if checks(stored).limit(1).collect():
        raise PublishError(f"published table no longer valid: {path}")
    return stored


_LIVE = "live.json"


def commit_table(df: DataFrame, path: str, checks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """S9-S11 for stores that do not rename atomically: nothing moves, a manifest names the files that live.

    Data go to a folder of their own below `path`, are read back and checked,
    and one small file, created only if there is none, makes them the table.  A
    writer that is killed leaves files that no manifest names; of writers that
    race one creates the manifest, and the others take their own files away.
    """
    spark = df.sparkSession
    fs, live = _fs(spark, f"{path}/{_LIVE}")
    if fs.exists(live):
        raise PublishError(f"already published: {path}")
    folder = f"{path}/data-{uuid.uuid4().hex}"
    _, own = _fs(spark, folder)
    try:
        df.write.parquet(folder)
        faults = checks(spark.read.schema(df.schema).parquet(folder)).limit(5).collect()  # five rows for the message
        if faults:
            raise PublishError(f"candidate broke rules: {[r.asDict() for r in faults]}")
        files = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(own) if f.getPath().getName().startswith("part-"))
        named = {"folder": own.getName(), "schema": df.schema.jsonValue(), "files": [{"name": n, "length": k} for n, k in files]}
        _create(fs, live, json.dumps(named), path)
    except BaseException:
        fs.delete(own, True)
        raise
    return live_table(spark, path)


def _create(fs, target, text: str, path: str) -> None:
    """A file that must not be there yet."""
    try:
        out = fs.create(target, False)
    except Py4JJavaError as e:
        if fs.exists(target):
            raise PublishError(f"already published: {path}") from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def live_table(spark: SparkSession, path: str) -> DataFrame:
    """What `commit_table` published: exactly the files that the manifest names, each of its length."""
    fs, live = _fs(spark, f"{path}/{_LIVE}")
    if not fs.exists(live):
        raise PublishError(f"nothing is published: {path}")
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(live.toString()).collect())  # one small file
    try:
        named = json.loads(text)
    except ValueError as e:
        raise PublishError(f"the manifest is not whole: {path}") from e
    schema = StructType.fromJson(named["schema"])
    _, own = _fs(spark, f"{path}/{named['folder']}")
    there = {f.getPath().getName(): f.getLen() for f in fs.listStatus(own)}
    lost = [f["name"] for f in named["files"] if there.get(f["name"]) != f["length"]]
    if lost:
        raise PublishError(f"files of {path} are missing or changed: {lost[:5]}")
    return spark.read.schema(schema).parquet(*[f"{own.toString()}/{f['name']}" for f in named["files"]]) if named["files"] else spark.createDataFrame([], schema)


def pending_runs(requested: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Requested runs that are not published."""
    return requested.join(published.select(*keys).distinct(), keys, "left_anti")


def build_differences(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that a rebuild has more or less than the stored table; empty for an idempotent build.  Only rows of buckets whose digests differ are compared."""
    from .reconcile import reconciled  # it stages tables by this module

    columns = rebuilt.columns
    rebuilt, stored = reconciled(rebuilt, stored, columns, [])
    return rebuilt.exceptAll(stored.select(columns)).withColumn("side", F.lit("rebuilt")).unionByName(stored.select(columns).exceptAll(rebuilt).withColumn("side", F.lit("stored")))


def partition_faults(found: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions that are unknown, or that occur more than once."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("n"))
    known = allowed.select(*keys).withColumn("_k", F.lit(True))
    j = counts.join(known, keys, "left")
    rule = F.when(F.col("_k").isNull(), "unknown_partition").when(F.col("n") > 1, "duplicate_partition")
    return j.select(*keys, rule.alias("rule")).filter("rule IS NOT NULL")


def bundle_folders(files: DataFrame, root: str, levels: list[str], path: str = "path") -> DataFrame:
    """(folder, parts, one column a level) of every folder below `root` that holds files, named plainly or as
    name=value; levels are null where the depth is another."""
    inner = F.regexp_replace(F.col(path), "^[a-z]+:/+", "/")
    inner = F.regexp_replace(inner, "^" + re.escape(re.sub("^[a-z]+:/+", "/", root.rstrip("/"))) + "/+", "")
    folder = F.regexp_replace(inner, "/?[^/]*$", "")
    found = files.select(folder.alias("folder")).distinct().withColumn("parts", F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/+")))
    placed = F.size("parts") == len(levels)
    return found.select("folder", "parts", *[F.when(placed, F.regexp_replace(F.get("parts", F.lit(i)), "^[^=]*=", "")).alias(c) for i, c in enumerate(levels)])


def bundle_folder_faults(folders: DataFrame, levels: list[str], allowed: dict[str, list[str]], identity: list[str]) -> DataFrame:
    """(folder, rule) of folders at another depth, with an unknown name at a level, or of an identity that stands twice.

    `allowed` has the (few) names of a level; `identity` are the levels that
    name a bundle, the others being versions of which only one may be there.
    """
    known = {c: F.col(c).isin(*names) for c, names in allowed.items()}
    misplaced = F.size("parts") != len(levels)
    twice = folders.filter(~misplaced).groupBy(*identity).agg(F.count("*").alias("_n")).filter("_n > 1")
    j = folders.join(twice, identity, "left")
    rules = [F.when(misplaced, F.lit("misplaced"))]
    rules += [F.when(~misplaced & ~ok, F.lit(f"unknown_{c}")) for c, ok in known.items()] + [F.when(F.col("_n").isNotNull(), F.lit("duplicate"))]
    return j.select("folder", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule"))
