"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import staged

__all__ = ["SPACE", "TRIMMED", "WORD", "importable", "staged", "table", "words_of"]

#: ASCII white space of every word contract in this subpackage.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
TRIMMED = " \t\n\x0b\f\r"


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package, wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; one with fewer splits than half the cores is dealt over the cores first."""
    importable(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def words_of(text: Column) -> Column:
    """Words of a text in order; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(TRIMMED))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
