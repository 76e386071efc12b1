"""Operator 8: document fingerprints from prefix polynomial hashes.

A text's code points c get H[i] = Σ_{j<i} (c_j + 1)·B^j modulo two primes, by
array operations.  Any span's hash follows from two prefixes, so spans are
compared without touching the text, and longest common extensions are found by
binary search.  The fingerprint is the hash of the whole text and a one-
permutation MinHash of its spans, for each code point the 24 that end there (at
the text's begin those that there are); likeness is the share of agreeing bins,
an estimate of the spans' Jaccard similarity, for texts of any length.

The query's "next document" is the neighbour in descending id order.  Rows are
dealt once into id ranges (bounds are approximate percentiles of the ids; an id
that fills several ranges is dealt over them by its texts' hashes), with a copy
of each range's first row sent to the range before it, and streamed in order:
no global sort in one task, no text shuffled twice.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

PRIMES, BASES = (2147483647, 2147483629), (1000003, 999983)
SPAN, BINS = 24, 64
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 … base^(n-1) mod prime; grown by doubling and kept per worker."""
    p = _POWERS.get((base, prime), np.ones(1, np.int64))
    while len(p) < n:
        p = np.concatenate([p, p * pow(base, len(p), prime) % prime])
    _POWERS[base, prime] = p
    return p[:n]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.prefix = []
        for prime, base in zip(PRIMES, BASES):
            h = np.zeros(self.n + 1, np.int64)
            np.cumsum((codes + 1) * _powers(base, prime, self.n) % prime, out=h[1:])
            self.prefix.append(h % prime)

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """Hash of code points i … j-1, the same wherever they stand."""
        return tuple(int(h[j] - h[i]) * pow(base, -i, prime) % prime for h, prime, base in zip(self.prefix, PRIMES, BASES))

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension of self from i and other from j."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(i, other, j, middle) else (low, middle - 1)
        return low

    def spans(self, length: int = SPAN) -> np.ndarray:
        """Mixed 64-bit hashes of the `length` code points that end at each one; before the text stand zeros."""
        if not self.n:
            return np.zeros(0, np.uint64)
        h, prime, m = self.prefix[0], PRIMES[0], min(length, self.n)
        ahead = _powers(BASES[0], prime, length)[length - m : length][::-1]  # of spans that begin before the text, or with it
        behind = _powers(pow(BASES[0], -1, prime), prime, self.n - m + 1)[1:]
        begun = h[1:].copy()
        begun[m:] -= h[1 : self.n - m + 1]
        x = (begun % prime * np.concatenate([ahead, behind]) % prime).astype(np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))

    def sketch(self) -> np.ndarray:
        """Least hash of each bin, cut to 16 bits; 0 for an empty bin."""
        x = self.spans()
        out = np.zeros(BINS, np.int64)
        few = x
        if len(x) > 64 * BINS:  # the least of each bin are among the smallest by far
            few = x[x < np.uint64((1 << 64) // (len(x) // (32 * BINS)))]
        for part in (few, x):
            part = np.sort(part)
            bins, first = np.unique(part % np.uint64(BINS), return_index=True)
            if len(bins) == BINS or part is x or len(few) == len(x):
                out[bins.astype(np.int64)] = 1 + (part[first] >> np.uint64(8)).astype(np.int64) % 0xFFFF
                break
        return out

    def fingerprint(self) -> str:
        whole = self.span(0, self.n)
        return f"{self.n:x}-{whole[0]:08x}{whole[1]:08x}-" + "".join(f"{v:04x}" for v in self.sketch().tolist())


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, else the share of agreeing bins among those filled in either."""
    if a == b:
        return 1.0
    x, y = (s.rsplit("-", 1)[1] for s in (a, b))
    pairs = [(x[i : i + 4], y[i : i + 4]) for i in range(0, 4 * BINS, 4)]
    filled = sum(p != ("0000", "0000") for p in pairs)
    return sum(p == q != "0000" for p, q in pairs) / filled if filled else 0.0


def edited(text: str, following: str) -> str:
    """The last half of `text` replaced by as much of `following`, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, work, schema: str, parts: int | None = None) -> DataFrame:
    """mapInArrow of `work` over (id, text, next text) for every row, in descending id order, the first after the last.

    Rows of one id are ordered by a hash of their text; null ids come last.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(-(2**63))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("g"))
    key = F.coalesce(F.col("id"), none)
    shares = F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]) if parts > 1 else F.array(F.lit(0.5))
    found = rows.agg(F.percentile_approx(key, shares, F.lit(max(10000, 20 * parts))).alias("b")).first()["b"] or []
    bounds = sorted(found, reverse=True)
    step = max(1, isqrt(len(bounds)))
    literal = lambda xs: "array(" + ", ".join(f"{x}L" if x > -(2**63) else "-9223372036854775807L - 1L" for x in xs) + ")" if xs else "array(0L)"
    coarse, fine = literal(bounds[::step]), literal(bounds)
    # bounds run downwards; a row's range is the number of bounds above its key, and its hash's share of those that equal it
    ranged = rows.withColumn("key", key).withColumn("c", F.expr(f"greatest(size(filter({coarse}, x -> x > key)) - 1, 0)") if bounds else F.lit(0))
    ranged = ranged.withColumn("range", F.expr(f"c * {step} + size(filter(slice({fine}, c * {step} + 1, {step}), x -> x > key))") if bounds else F.lit(0)).drop("c")
    if several := sorted({b for b in bounds if bounds.count(b) > 1}):  # ids that fill ranges of their own
        same = F.expr(f"coalesce(get(array({', '.join(str(bounds.count(b)) for b in several)}), cast(array_position({literal(several)}, key) - 1 as int)), 1)")
        share = F.shiftrightunsigned(F.col("g"), 33) * same / F.lit(float(1 << 31))
        ranged = ranged.withColumn("range", F.when(F.col("key").isin(several), F.col("range") + F.floor(share).cast("int")).otherwise(F.col("range")))
    ranged = ranged.withColumn("g", F.bitwise_not(F.shiftrightunsigned(F.col("g"), 1)))  # descending, as ids are
    heads = {r["range"]: r["h"] for r in ranged.groupBy("range").agg(F.max(F.struct("key", "g")).alias("h")).collect()}  # one row a range
    used = sorted(heads)
    before = {r: used[i - 1] for i, r in enumerate(used)}  # the first range's head goes to the last one
    n = max(used, default=0) + 1
    head_of = [literal([heads[r][i] if r in heads else 0 for r in range(n)]) for i in (0, 1)]
    sent_to = "array(" + ", ".join(str(before.get(r, 0)) for r in range(n)) + ")"
    copies = F.expr(f"CASE WHEN key = {head_of[0]}[range] AND g = {head_of[1]}[range] THEN array(struct(range AS r, false AS ghost), struct({sent_to}[range] AS r, true AS ghost)) ELSE array(struct(range AS r, false AS ghost)) END")
    dealt = ranged.withColumn("to", F.explode(copies)).select("to.r", "to.ghost", "key", "id", "text", "g")
    placed = dealt.repartitionById(n, F.col("r")).sortWithinPartitions("r", "ghost", F.col("key").desc(), F.col("g").desc(), "text")

    def stream(batches):
        def walk():
            last = None  # (range, id, text)
            for b in batches:
                for r, ghost, doc_id, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                    if last is not None and last[0] == r:
                        yield last[1], last[2], text
                    last = None if ghost else (r, doc_id, text)

        yield from work(walk())

    return placed.mapInArrow(stream, schema)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its and its edited text's fingerprints, likenesses, longest common extensions.

    A null text is empty; an only document is its own next one; repeated rows
    follow each other; an empty table gives no rows; a very long text is hashed
    whole; extra columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_edited", "same_next"]
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited bigint, same_next bigint"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def work(rows):
        out = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * len(names), types)], names)
            out.clear()
            return batch

        own, said = None, None  # hashes of the text before's next, which is this text
        for doc_id, text, following in rows:
            if said is None or said != text:
                h = PrefixHash(codes_of(text))
                own = h, h.fingerprint()
            h, print_ = own
            e = edited(text, following)
            he = PrefixHash(codes_of(e))
            ep = he.fingerprint()
            hn = PrefixHash(codes_of(following))
            own, said = (hn, hn.fingerprint()), following
            out.append((doc_id, h.n, hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), print_, ep, likeness(print_, ep), likeness(print_, own[1]), h.extension(0, he, 0), h.extension(0, hn, 0)))
            if len(out) >= 1000:
                yield flush()
        yield flush()

    return with_next(docs, work, schema)


def op8_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))
