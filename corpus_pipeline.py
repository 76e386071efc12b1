"""Training-data pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage is a table function (spark, docs, sf_dir) → DataFrame; `run` writes
every stage's result as Parquet in the shared folder and reads it back as the
next one's input.  All but the last keep the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm.common import importable, staged, table
from pairlab.llm.linededup import dedup_lines
from pairlab.llm.mixing import mix
from pairlab.llm.packing import pack
from pairlab.llm.quality import judge
from pairlab.llm.simhash import near_copies
from pairlab.sources.publish import clear_staged, staging_dir, staging_run

#: Words of a shingle and Jaccard similarity of the near-dedup stage.
SHINGLE, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their divergence reject go.

    A null text has no words and goes; rows of a null lang share a reference;
    repeated rows are judged alike; an empty table gives no rows; texts are
    judged whole, and any further columns go along.
    """
    return judge(docs).filter("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of recurring line templates go; n_chars follows the new text.

    A null text stays null, an emptied one stays as an empty text; rows without
    a doc_id are documents of their own; an empty table gives no rows; long
    texts are parsed whole, and any further columns go along, whatever their names.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    out = dedup_lines(docs.select("doc_id", "text", rest))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, once; a row without a doc_id only if none has one.

    Groups are joined by SimHash, the fingerprints and balls of operator 6, with
    each link checked by the texts' shingles; near copies of the stated
    similarity that are more than its 3 bits apart are joined by the shingles.

    Rows of one doc_id with different texts in different groups all stay, as do
    those without a doc_id.  Null and blank texts are one group; repeated rows
    stay once; an empty table gives no rows; texts are taken whole, and any
    further columns go along, whatever their names.
    """
    importable(spark)
    found = near_copies(docs, SIMILARITY, SHINGLE)
    key = lambda hashed: [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), hashed.alias("hash")]
    names = ["none", "id", "hash"]
    stay = found.filter("stays").select(*key(F.col("h"))).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key(F.xxhash64(F.col("text").cast("string"))))
    return rows.join(stay, names, "left_semi").dropDuplicates(names).select("_row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks: not at all, once, or up to three times.

    A null text has size 0; null sources are one source; repeated rows are
    sampled each; an empty table gives no rows; a very long text counts with all
    its words; any further columns go along.
    """
    mixed = mix(docs).filter("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("_row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 1,024 tokens as best fit makes; see `pack` for nulls, repeats and long texts."""
    importable(spark)
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]
#: Hash fingerprints and token ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`.

    What a stage stages inside goes when its result is written, and a stage's
    result goes when the next one's is, so only the last one's table is left.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{staging_dir(spark)}/{uuid.uuid4().hex}"
        with staging_run(spark):
            docs = staged(stage(spark, docs, sf_dir), path)
        if last:
            clear_staged(spark, last)
        last = path
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
