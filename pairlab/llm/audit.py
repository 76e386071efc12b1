"""Operator 11: which filter removes what, in every order of the filters.

A document is a mask of the filters that it fails.  Counts of masks add up, and
every figure of every order follows from a part's counts (at most 2^filters
rows), so the documents are judged once and not once an order.

Only the filter for repeated texts needs other documents.  A counting Bloom
sketch goes before it: every text adds one to two cells of an array, tasks' cells
are summed, and a text with a cell of count one is surely unique.  The cells
counted twice or more are told to the tasks as a bitmap; only texts whose cells
are all in it are shuffled, whole, to find the smallest doc_id of each text.  The
bitmap has sixteen cells a document up to 2^`CELLS` (64 MB); beyond some 10^8
documents it clears fewer texts and more are shuffled, and the results stay.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, staged, table

#: Power of two of the sketch's cells: the least, the most, and the cells a document.
LEAST_CELLS, CELLS, PER_TEXT = 15, 29, 16
_PAGE = 15  # cells of one bitmap row, as a power of two
_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"


class Counts(NamedTuple):
    """What the rules see of a text."""

    words: int
    distinct: int
    upper: int
    symbols: int
    chars: int


#: Failure conditions; the filter for repeated texts comes last and is not among them.
RULES: dict[str, Callable[[Counts], bool]] = {
    "A": lambda x: x.words < 100,
    "B": lambda x: 100 * x.distinct < 80 * x.words,
    "C": lambda x: 100 * x.upper > 10 * x.chars,
    "D": lambda x: x.symbols > 0,
}
REPEATED = "E"


def counted(text: bytes, chars: int) -> Counts:
    words = text.split()  # bytes: exactly the ASCII white space
    return Counts(len(words), len(set(words)), len(text) - len(text.translate(None, _UPPER)), len(text) - len(text.translate(None, _SYMBOLS)), chars)


def _hashed(texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t, seed=11) for t in texts], dtype=np.uint64).view(np.int64)


def _texts(column: pa.Array) -> tuple[list[bytes], list[int]]:
    filled = pc.fill_null(column, "")
    return filled.cast(pa.binary()).to_pylist(), pc.utf8_length(filled).to_pylist()


def judged(docs: DataFrame, rules: dict[str, Callable[[Counts], bool]] = RULES) -> DataFrame:
    """(doc_id, part, mask, h) of every row: bit i of the mask is set if the i-th rule fails the text; h is a hash of the whole text."""
    tests = list(rules.values())

    def work(batches):
        for b in batches:
            texts, chars = _texts(b.column(2))
            masks = [sum(bool(f(x)) << i for i, f in enumerate(tests)) for x in map(counted, texts, chars)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(_hashed(texts))], ["doc_id", "part", "mask", "h"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, part string, mask int, h bigint")


class Sketch:
    """Cells counted twice or more, as a bitmap of bounded size; tells which hashes may stand for a repeated text."""

    def __init__(self, bits: int, pages: list[tuple[int, bytes]]):
        self.bits = bits
        self.map = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for page, cells in pages:
            self.map[page << (_PAGE - 3) : (page + 1) << (_PAGE - 3)] = np.frombuffer(cells, dtype=np.uint8)

    def may_repeat(self, h: np.ndarray) -> np.ndarray:
        u, low = h.view(np.uint64), np.uint64((1 << self.bits) - 1)
        out = np.ones(len(h), dtype=bool)
        for cell in (u & low, (u >> np.uint64(64 - self.bits)) & low):
            out &= (self.map[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def sketch(hashes: DataFrame, most: int = CELLS) -> Sketch:
    """Counting Bloom sketch of (h); cells are counted by partial sums and bounded at two."""
    n = hashes.count()
    bits = min(max((PER_TEXT * n - 1).bit_length() if n else 0, LEAST_CELLS), most)
    cells = F.array_distinct(F.array(F.expr(f"h & {(1 << bits) - 1}L"), F.expr(f"shiftrightunsigned(h, {64 - bits})")))
    twice = hashes.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    pages = twice.groupBy(F.shiftright("cell", _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit((1 << _PAGE) - 1))).alias("map"))
    return Sketch(bits, [(r["page"], bytes(r["map"])) for r in pages.collect()])  # 2^(most - 15) rows of 4 KB at most


def first_ids(docs: DataFrame, may: Callable[[], Sketch]) -> DataFrame:
    """(doc_id, h): the smallest doc_id of each whole text that the sketch does not clear."""

    def some(batches):
        for b in batches:
            texts, _ = _texts(b.column(1))
            h = _hashed(texts)
            keep = pa.array(np.flatnonzero(may().may_repeat(h)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array(h).take(keep), pc.fill_null(b.column(1), "").take(keep)], ["doc_id", "h", "text"])

    possible = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL").mapInArrow(some, "doc_id bigint, h bigint, text string")
    return possible.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.first("h").alias("h")).select("doc_id", "h").distinct()


def mask_counts(docs: DataFrame, labels: DataFrame, rules: dict[str, Callable[[Counts], bool]] = RULES, most_cells: int = CELLS) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters that they fail; the bit after the rules' is a repeated text.

    A text is repeated if a smaller doc_id has it; a row without an id neither
    repeats nor is repeated, and has no label.  Null texts are empty ones, null
    langs the empty part.  Rows that repeat with their id count each; a document
    is good (toxic) if any of its labels says so.  Very long texts are compared
    whole; an empty table has no parts; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = staged(judged(docs, rules))
    told = spark.sparkContext.broadcast(sketch(rows.filter("doc_id IS NOT NULL").select("h"), most_cells))
    kept = staged(first_ids(docs, lambda: told.value).withColumn("first", F.lit(True)))

    def mark(batches):
        for b in batches:
            may = told.value.may_repeat(b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(may)], [*b.schema.names, "may"])

    own = rows.filter("doc_id IS NOT NULL").mapInArrow(mark, "doc_id bigint, part string, mask int, h bigint, may boolean")
    bit = 1 << len(rules)
    whole = own.filter("may").join(kept, ["doc_id", "h"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("first").isNull(), bit).otherwise(0)).alias("mask"))
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    of_ids = whole.union(own.filter("NOT may").select("doc_id", "part", "mask")).join(known.filter("doc_id IS NOT NULL"), "doc_id", "left").select("part", "mask", "good", "toxic")
    without = rows.filter("doc_id IS NULL").select("part", "mask", F.lit(None).cast("int"), F.lit(None).cast("int"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return of_ids.union(without).groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def report(counts: DataFrame, filters: str) -> DataFrame:
    """Mask counts → one row per part, order of the filters and step."""
    steps = [("".join(order), s + 1, filters.index(f), sum(1 << filters.index(x) for x in order[:s])) for order in permutations(filters) for s, f in enumerate(order)]
    orders = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, before int")
    each = counts.withColumn("f", F.explode(F.array(*map(F.lit, range(len(filters)))))).join(orders, "f")
    fails, gone = F.expr("(mask & shiftleft(1, f)) > 0"), F.expr("(mask & before) > 0")
    total = lambda test, value, name: F.sum(F.when(test, F.col(value)).otherwise(0)).cast("bigint").alias(name)
    removed = fails & ~gone
    summed = each.groupBy("part", "filter_order", "step", "f").agg(
        total(~fails & ~gone, "n", "kept"),
        total(removed, "n", "removed"),
        total(fails & gone, "n", "redundant"),
        total(F.expr("mask = shiftleft(1, f)"), "n", "unique_fails"),
        total(removed, "good", "good_lost"),
        total(removed, "toxic", "toxic_lost"),
    )
    shares = summed.groupBy("part", "f").agg(F.sum("removed").alias("shapley"))
    return summed.join(shares, ["part", "f"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Callable[[Counts], bool]] = RULES, repeated: str = REPEATED) -> DataFrame:
    """The report over all orders of the rules and the filter for repeated texts; see `mask_counts` for nulls, repeats and empty tables."""
    return report(staged(mask_counts(docs, labels, rules)), "".join(rules) + repeated)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    letters = [*RULES, REPEATED]
    picked = ", ".join(f"o{i}.f AS f{i}" for i in range(len(letters)))
    tables = ", ".join(f"l o{i}" for i in range(len(letters)))
    differ = " AND ".join(f"o{i}.f <> o{j}.f" for i in range(len(letters)) for j in range(i))
    name = " || ".join(f"chr(65 + f{i})" for i in range(len(letters)))
    steps = " UNION ALL ".join(f"SELECT {name} AS filter_order, {i + 1} AS step, f{i} AS f, {' + '.join(['0', *[f'(1 << f{j})' for j in range(i)]])} AS before FROM p" for i in range(len(letters)))
    return rf"""
WITH l AS (SELECT unnest(range({len(letters)}))::int AS f),
p AS (SELECT {picked} FROM {tables} WHERE {differ}),
o AS ({steps}),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
y AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT t.doc_id, part, good, toxic, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
      + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x))::int + 8 * regexp_matches(x, '[#$%&*|]')::int
      + 16 * coalesce(min(t.doc_id) OVER (PARTITION BY x) < t.doc_id, FALSE)::int AS mask FROM t LEFT JOIN y ON t.doc_id = y.doc_id),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM d GROUP BY part, mask),
s AS (SELECT part, filter_order, step, f, sum(n) FILTER ((mask & (1 << f)) = 0 AND (mask & before) = 0) AS k, sum(n) FILTER ((mask & (1 << f)) > 0 AND (mask & before) = 0) AS r,
      sum(n) FILTER ((mask & (1 << f)) > 0 AND (mask & before) > 0) AS d, sum(n) FILTER (mask = (1 << f)) AS u, sum(good) FILTER ((mask & (1 << f)) > 0 AND (mask & before) = 0) AS g,
      sum(toxic) FILTER ((mask & (1 << f)) > 0 AND (mask & before) = 0) AS x FROM m CROSS JOIN o GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::int AS step, coalesce(k, 0)::bigint AS kept, coalesce(r, 0)::bigint AS removed, coalesce(d, 0)::bigint AS redundant, coalesce(u, 0)::bigint AS unique_fails,
       coalesce(g, 0)::bigint AS good_lost, coalesce(x, 0)::bigint AS toxic_lost, coalesce(sum(r) OVER (PARTITION BY part, f), 0)::bigint AS shapley FROM s
"""


OP11_SQL = _sql()
