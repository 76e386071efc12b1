"""Operator 2: best-fit packing of documents into fixed-length token sequences.

Bulk-synchronous best fit.  Documents are cut into pieces of at most `capacity`
tokens.  Pieces over half of it open a sequence each.  Then every superstep

1. sorts the waiting pieces and the open gaps by size, largest first, gaps
   before pieces of their size, and matches each piece with its successor, the
   smallest gap that holds it and is left by larger pieces.  Gaps push and
   pieces pop in that order, so with the depth as a prefix sum, pieces and gaps
   of one depth alternate and a piece's gap is the row before it at its depth.
   Conflicts among equal sizes go by rank;
2. gives the largest band of pieces that found no gap of their own the places
   that the remaining gaps still have for such pieces, tightest gaps first, and
   opens sequences for the rest, filled with pieces of one size;
3. updates the gaps.

A superstep finishes its band, and bands shrink by at least an eighth, below an
eighth of the capacity by half, so there are at most some fifteen supersteps
whatever the number of documents.

Sizes are at most `capacity` different numbers, so a prefix sum is one over the
counts of that many classes plus a rank inside the class.  The counts are all
that the driver sees; matches, ranks and places are made in tasks.  Ranks are
two-level: a large class is dealt over as many salts as its count asks for, so
no task sorts a third of all rows.  A depth holds at most two rows a size.
"""

from __future__ import annotations

import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table
from .tokens import contract_ids

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Rows of one size that one task ranks.
RANKED = 1 << 16


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: a shorter first piece, then full ones."""
    head = n % capacity
    return [(0, head)] * bool(head) + [(s, capacity) for s in range(head, n, capacity)]


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece; a null text counts as empty and gives one piece, the end id alone."""

    def work(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = contract_ids(text or "")
                ids.append(end_id)
                raw = memoryview(ids.tobytes())
                rows += [(doc_id, i, s, k, zlib.crc32(raw[4 * s : 4 * (s + k)])) for i, (s, k) in enumerate(cut(len(ids), capacity))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(work, PIECES)


def _by_size(values: list[int]) -> Column:
    """The entry of a row's size in a list over all sizes."""
    return F.get(F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)"), F.col("size").cast("int"))


def _count(rows: DataFrame, capacity: int) -> tuple[list[int], list[int]]:
    """Gaps and pieces of each size of (kind, size): at most twice `capacity` numbers."""
    found = ([0] * (capacity + 1), [0] * (capacity + 1))
    for r in rows.groupBy("kind", "size").count().collect():
        found[r["kind"]][r["size"]] = r["count"]
    return found


def _ranked(rows: DataFrame, counts: list[int], by: list[str]) -> DataFrame:
    """`rows` with r, their rank from 0 among those of their size (and kind), by id; no class has more rows than its entry in `counts`."""
    if max(counts) <= RANKED:
        return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id")) - 1)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), _by_size([n // RANKED + 1 for n in counts])))
    before = Window.partitionBy(*by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*by, "salt").agg(F.count("*").alias("n")).select(*by, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*by, "salt").orderBy("id")) - 1
    return salted.withColumn("r", inside).join(starts.hint("merge"), [*by, "salt"]).withColumn("r", F.col("r") + F.col("before")).drop("salt", "before")


def sweep(rows: DataFrame, gaps: list[int], pieces: list[int]) -> DataFrame:
    """Successor sweep over (kind 0 gap or 1 piece, size, id): adds prev, the gap that a piece takes, and next = 1 to taken gaps.

    `gaps` and `pieces` count the rows of each size.
    """
    depth, opening, closing = 0, [0] * len(gaps), [0] * len(gaps)
    for size in range(len(gaps) - 1, -1, -1):
        opening[size] = depth
        depth += gaps[size]
        closing[size] = depth
        depth -= pieces[size]
    level = F.when(F.col("kind") == 0, _by_size(opening) + F.col("r") + 1).otherwise(_by_size(closing) - F.col("r"))
    at = Window.partitionBy("level").orderBy(F.col("size").desc(), "kind")
    placed = _ranked(rows, [max(x) for x in zip(gaps, pieces)], ["size", "kind"]).withColumn("level", level)
    return placed.select("kind", "size", "id", F.lag(F.struct("size", "id")).over(at).alias("prev"), F.lead("kind").over(at).alias("next"))


def fill(rows: DataFrame, gaps: list[int], pieces: list[int], opened: int) -> tuple[DataFrame, DataFrame, int]:
    """Place the largest band of pieces: (id, seq, offset, size, gap) of it, rows left as they are, sequences opened."""
    capacity = len(gaps) - 1
    top = max(size for size, n in enumerate(pieces) if n)
    each = capacity // top
    low = capacity // (each + 1) if each < 8 else top // 2
    # places of the gaps that hold such pieces, tightest gaps first
    held, start = 0, [0] * (capacity + 1)
    for size in range(top, capacity + 1):
        start[size] = held
        held += gaps[size] * (size // top)
    # pieces by size: their first place, the first one after the hosted ones, full sequences of one size, and odd ones
    place, new, odd = 0, 0, 0
    first, own, full, seqs, odds = ([0] * (capacity + 1) for _ in range(5))
    for size in range(top, low, -1):
        first[size], own[size] = place, max(place, held)
        place += pieces[size]
        m, k = max(place - own[size], 0), capacity // size
        full[size], seqs[size], odds[size] = m // k * k, new, odd
        new, odd = new + m // k, odd + m % k
    band = rows.filter((F.col("kind") == 1) & (F.col("size") > low)).select("id", "size")
    ranked = _ranked(band, pieces, ["size"]).withColumn("place", _by_size(first) + F.col("r")).withColumn("j", F.col("place") - _by_size(own))
    fits = F.floor(F.lit(capacity) / F.col("size"))
    number = F.when(F.col("j") < _by_size(full), _by_size(seqs) + F.floor(F.col("j") / fits)).otherwise(new + F.floor((_by_size(odds) + F.col("j") - _by_size(full)) / each))
    placed = ranked.filter(F.col("place") >= held).select("id", "size", "place", (-1 - opened - number).cast("bigint").alias("seq"), F.lit(capacity).cast("bigint").alias("gap"))
    rest = rows.filter((F.col("kind") == 0) | (F.col("size") <= low))
    if held:
        large = (F.col("kind") == 0) & (F.col("size") >= top)
        hosts = _ranked(rows.filter(large).select("id", "size"), gaps, ["size"]).withColumn("slots", F.floor(F.col("size") / top))
        hosts = hosts.select("id", "size", (_by_size(start) + F.col("r") * F.col("slots")).alias("start"), "slots")
        taken = hosts.filter(F.col("start") < place).select(F.col("id").alias("seq"), F.col("size").alias("gap"), F.explode(F.expr("sequence(start, start + slots - 1)")).alias("place"))
        placed = placed.union(ranked.filter(F.col("place") < held).select("id", "size", "place").join(taken, "place").select("id", "size", "place", "seq", "gap"))
        rest = rest.filter(~large).union(hosts.filter(F.col("start") >= place).select(F.lit(0).alias("kind"), "size", "id"))
    inside = Window.partitionBy("seq").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` rows
    used = F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = placed.select("id", "seq", (F.lit(capacity) - F.col("gap") + used).alias("offset"), "size", "gap")
    return placed, rest, opened + new + -(-odd // each)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every document; one row per piece with its sequence and its place there.

    Nulls: a null text is empty; a null doc_id stays null.  Repeated rows are
    packed once each.  An empty table gives no rows.  A very long text is
    encoded whole and cut into full pieces.  Extra columns are ignored.
    """
    pieces = staged(tokenize_pieces(docs, capacity, end_id).withColumn("id", F.monotonically_increasing_id()))
    large = 2 * F.col("length") > capacity
    parts = [pieces.filter(large).select("id", F.col("id").alias("seq"), F.lit(0).cast("bigint").alias("offset"))]
    rows = pieces.filter("length < " + str(capacity)).select(F.when(large, 0).otherwise(1).alias("kind"), F.when(large, F.lit(capacity) - F.col("length")).otherwise(F.col("length")).alias("size"), "id")
    opened = 0
    while True:
        gaps, waiting = _count(rows, capacity)
        if not any(waiting):
            break
        if any(gaps):
            met = staged(sweep(rows, gaps, waiting))
            matched = met.filter("kind = 1 AND prev IS NOT NULL")
            parts.append(matched.select("id", F.col("prev.id").alias("seq"), (F.lit(capacity) - F.col("prev.size")).alias("offset")))
            shrunk = matched.select(F.lit(0).alias("kind"), (F.col("prev.size") - F.col("size")).alias("size"), F.col("prev.id").alias("id")).filter("size > 0")
            rows = met.filter("CASE WHEN kind = 0 THEN next ELSE prev.id END IS NULL").select("kind", "size", "id").union(shrunk)
            gaps, waiting = _count(rows, capacity)
            if not any(waiting):
                break
        placed, rest, opened = fill(rows, gaps, waiting, opened)
        placed = staged(placed)
        parts.append(placed.select("id", "seq", "offset"))
        made = placed.groupBy("seq").agg((F.first("gap") - F.sum("size")).alias("size")).filter("size > 0")
        rows = rest.union(made.select(F.lit(0).alias("kind"), "size", F.col("seq").alias("id")))
    places = reduce(DataFrame.union, parts)
    return pieces.join(places, "id").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
