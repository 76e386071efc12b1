"""Merkle reconciliation of two tables (D1, D3, S13): descend only where digests differ.

Rows fall into buckets by a hash of their key, the leaves of a tree of fan-out
2^`BITS`.  A bucket's digest is a sum over its rows, so it combines in every
task before the shuffle and does not depend on order or partitioning.  From the
top, each level digests only rows below buckets that differed, and what is left
at the leaves is all that a join has to see: tables that differ in few rows
shuffle few rows, whatever their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .publish import staged

#: Bits of a key's hash that a level of the tree adds, and rows of a leaf.
BITS, LEAF = 10, 4096
#: Rows of a table that is compared whole.
SMALL = 1 << 18


def _plain(df: DataFrame, c: str, same: bool) -> list[Column]:
    """A value as what can be hashed, and whether it is null."""
    kind = dict(df.dtypes)[c]
    x = F.col(f"`{c}`")
    if kind.startswith(("struct", "array", "map", "variant")):
        x = F.to_json(x)
    elif not same:
        x = x.cast("string")
    return [x, x.isNull()]


def _digested(df: DataFrame, key: list[str], columns: list[str], same: dict[str, bool]) -> DataFrame:
    """df with _b, the hash that places a row, and four 32-bit words of a 128-bit hash of the row."""
    cells = [x for c in [*key, *columns] for x in _plain(df, c, same[c])]
    one, two = F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *cells)
    words = [w for h in (one, two) for w in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    return df.withColumns({"_b": F.xxhash64(*[x for c in key for x in _plain(df, c, True)]), **{f"_w{i}": w for i, w in enumerate(words)}})


def reconciled(expected: DataFrame, actual: DataFrame, key: list[str], columns: list[str], small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that may differ: whole leaves, with all rows of every key that differs in any column.

    Equal keys stand in one leaf on both sides, so a join or a difference of the
    two results has the same rows as one of the tables.  Both tables are read
    once a level: pass stored tables, not jobs.  Tables of few rows, or with
    keys of different types, come back as they are.
    """
    small = SMALL if small is None else small
    types = [dict(x.dtypes) for x in (expected, actual)]
    if any(types[0][c] != types[1][c] for c in key):
        return expected, actual
    n = max(expected.count(), actual.count())
    if n <= small:
        return expected, actual
    same = {c: types[0][c] == types[1][c] for c in [*key, *columns]}
    sides = [_digested(x, key, columns, same) for x in (expected, actual)]
    depth, differing = 0, None
    while n >> depth > LEAF:
        depth += BITS
        bucket = F.shiftrightunsigned("_b", 64 - depth)
        below = [x if differing is None else x.withColumn("_u", F.shiftrightunsigned("_b", 64 - depth + BITS)).join(differing, "_u", "left_semi") for x in sides]
        sums = [F.count("*").alias("n"), *[F.sum(f"_w{i}").alias(f"s{i}") for i in range(4)]]
        nodes = [x.groupBy(bucket.alias("_u")).agg(F.struct(*sums).alias("d")) for x in below]
        met = nodes[0].join(nodes[1].withColumnRenamed("d", "e"), "_u", "full_outer")
        differing = staged(met.filter("NOT d <=> e").select("_u"))
    leaf = lambda x: x.withColumn("_u", F.shiftrightunsigned("_b", 64 - depth)).join(differing, "_u", "left_semi").drop("_u", "_b", "_w0", "_w1", "_w2", "_w3")
    return tuple(map(leaf, sides)) if differing is not None else (expected, actual)
