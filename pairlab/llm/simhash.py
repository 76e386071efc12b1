"""Operator 6: SimHash near-duplicates by meet-in-the-middle ball hashing.

Links are pairs of fingerprints at most 3 bits apart.  Two fingerprints 3 apart
meet in a string that is 1 bit from one and 2 bits from the other, so each
emits the variants within (about) half the radius and variants are shuffled:

* all emit their ball of radius 1 (65 variants);
* fingerprints of odd parity also emit two-bit flips.  Fingerprints 3 apart
  have opposite parity, so the odd one supplies the two flips, and two of any
  three differing bits lie in the same 32-bit half, so flips within a half do
  (992 variants).

A member within 1 bit of a variant is within 3 bits of every other member of
that variant's bucket, so linking all members to the smallest such member
gives every link's connection and only true links: no pairs inside a bucket,
no matter how large, and nothing left to verify.  To spare fingerprints that
have no partner the wide ball, a first pass takes away three of seven bit blocks
(3 differing bits lie in at most three), 35 ways, and keeps fingerprints that
share the other bits with another one.

The pipeline's stage, `near_copies`, holds the links of the balls against the
texts' sets of shingles, and finds what is alike beyond 3 bits by the sets.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table
from .components import components

SHINGLE, RADIUS = 3, 3
#: First bit and width of the blocks of which the first pass takes away as many as bits may differ.
BLOCKS = ((0, 9), (9, 9), (18, 9), (27, 10), (37, 9), (46, 9), (55, 9))


def _lanes() -> np.ndarray:
    """byte → eight 8-bit counters, one a bit, in a 64-bit word."""
    return np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").copy().view("<u8").reshape(-1)


LANES = _lanes()


def majority(hashes: np.ndarray) -> np.ndarray:
    """Column-wise SimHash of (n, k) 64-bit hashes: a bit is 1 if more than half of the rows have it."""
    n, k = hashes.shape
    octets = np.ascontiguousarray(hashes.astype("<u8", copy=False)).view(np.uint8).reshape(n, 8 * k)
    ones = np.zeros(64 * k, dtype=np.int64)
    for i in range(0, n, 255):  # a counter holds up to 255
        ones += LANES[octets[i : i + 255]].sum(axis=0).view(np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, unsigned: bit i is set in more than half of the shingle hashes."""
    return fingerprint_of(words_in(text), shingle)


def fingerprint_of(words: list[bytes], shingle: int = SHINGLE) -> int:
    """`fingerprint` of a text's words."""
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.array(list(map(hashed, shingles)), dtype=np.uint64)
    return int(majority(h.reshape(-1, 1))[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row; a null or blank text has fingerprint zero."""

    def work(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(work, "doc_id bigint, fp bigint")


def _suspects(fps: DataFrame) -> DataFrame:
    """Fingerprints that share the bits outside some three blocks with another fingerprint."""
    kept = []
    for n, away in enumerate(combinations(BLOCKS, RADIUS)):
        keep = ((1 << 64) - 1) & ~sum(((1 << width) - 1) << first for first, width in away)
        signed = keep - (1 << 64) if keep >> 63 else keep
        kept.append(f"(fp & {signed}L) | shiftleft({n}L, {away[0][0]})")  # bits of a block that is away name the blocks, so one column is the key
    variants = fps.select("fp", F.explode(F.expr("array(" + ", ".join(kept) + ")")).alias("v"))
    shared = variants.withColumn("n", F.count("*").over(Window.partitionBy("v"))).filter("n > 1")
    return shared.select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) → (a, b): a spanning set of all links within 3 bits."""
    suspects = staged(_suspects(fps))
    near = "concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))"
    pairs = "flatten(transform(sequence(0, 62), i -> transform(filter(sequence(0, 63), j -> j > i AND (i < 32) = (j < 32)), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    flips = suspects.sparkSession.range(1).selectExpr(f"{near} AS near", f"{pairs} AS wide").first()  # constants: 65 and 992 masks
    ones = F.array(*map(F.lit, flips["near"]))
    twos = F.array(*map(F.lit, flips["wide"]))
    inner = suspects.select("fp", F.explode(ones).alias("m"), F.lit(True).alias("inner"))
    outer = suspects.filter("bit_count(fp) % 2 = 1").select("fp", F.explode(twos).alias("m"), F.lit(False).alias("inner"))
    members = inner.union(outer).select("fp", "inner", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    centre = F.min(F.when(F.col("inner"), F.col("fp"))).over(Window.partitionBy("v"))
    met = members.withColumn("c", centre).filter(F.col("c").isNotNull() & (F.col("c") != F.col("fp")))
    return met.select(F.col("c").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links.

    Null and blank texts have fingerprint zero and link like any other; null
    ids get their component but never name one unless all its ids are null.
    Repeated rows are one fingerprint; an empty table gives no rows; very long
    texts are hashed whole; extra columns are ignored.

    The first pass emits 35 keys of each of n distinct fingerprints, so unrelated
    ones meet in it by chance about n * 25 / 2^36 times each: a tenth of all at
    some 3e8 fingerprints.  Beyond some 2e9 most are suspects, and
    the second pass takes the full ball of all, about a thousand variants for
    each of odd parity; the links stay the same.
    """
    docs_fp = staged(fingerprints(docs, shingle, id_col, text_col))
    distinct = staged(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = staged(named.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return docs_fp.join(of_fp, "fp").select("doc_id", "fp", "component_id")


# ---- similarity joins: exact sets of shingle hashes, for thresholds beyond a few bits of 64

#: The count from which a shingle is common, how many of the commonest are told to the tasks (five bytes each), and shingles of a part of the count.
COMMON, MOST_COMMON, _COUNTED = 8, 1 << 22, 1 << 21
_VOCABULARY = 1 << 20
#: Size of the filter that keeps sets of unlinked texts out of the verification, as a power of two.
_BITS = 23


class _Words(dict):
    """word → 64-bit hash; the memo starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _VOCABULARY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, seed=42)
        return h


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_in(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z only, and exactly the ASCII white space


def text_key(words: list[bytes]) -> int:
    """Key of a text's words, signed."""
    key = xxhash.xxh64_intdigest(b" ".join(words), seed=42)
    return key - (1 << 64) if key >> 63 else key


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, ascending; a shorter text is one shingle."""
    if not words:
        return np.array([], dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(len(w) - shingle + 1, 1)
    h = np.full(n, min(len(w), shingle), dtype=np.uint64)
    for i in range(min(len(w), shingle)):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return np.unique(_mixed(h))


class Commons:
    """The commonest shingles by the upper half of their hash, with the power of two of their count."""

    def __init__(self, keys: np.ndarray, powers: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.powers = keys[order], powers[order]

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Power of each shingle's count, 0 for those that are not common; grams ascend."""
        if not len(self.keys):
            return np.zeros(len(grams), dtype=np.uint8)
        high = (grams >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, high), len(self.keys) - 1)
        return np.where(self.keys[at] == high, self.powers[at], 0).astype(np.uint8)


def prefix(grams: np.ndarray, similarity: float, common: Commons) -> np.ndarray:
    """The first shingles of a set, rare ones first and the commonest last: two sets this similar share one of them.

    Similar sets share at least similarity * n of a set's n shingles, so all but
    that many less one are enough, whatever the order, if all sets keep to it.
    """
    order = np.argsort(common.of(grams), kind="stable")
    return grams[order[: len(grams) - ceil(similarity * len(grams) - 1e-9) + 1]]


def parities(grams: np.ndarray) -> np.ndarray:
    """One bit per residue class of hashes: whether it holds an odd number of them.

    Sets that differ in d shingles differ in at most d bits, so the bits rule
    pairs out for certain.  There are two to four bits a shingle, a power of two.
    """
    m = 64 << max(0, (max(2 * len(grams), 1) - 1).bit_length() - 6)
    odd = np.bincount((grams & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _each_text(texts: DataFrame, columns: str, make, *others: int):
    """mapInArrow of make(doc_ids, words of each text, other columns) → list of arrays, over (doc_id, t, …)."""
    names = [c.split()[0] for c in columns.split(", ")]

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(make(b.column(0), [words_in(t) for t in b.column(1).cast(pa.binary()).to_pylist()], *[b.column(i) for i in others]), names)

    return texts.mapInArrow(work, columns)


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays).view(np.int64) if arrays else np.array([], dtype=np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_joined(arrays)))


def _common(texts: DataFrame, shingle: int, words: int) -> Commons:
    """The commonest shingles of all texts, a bounded number; they only set the order of prefixes, never what is found.

    Every batch counts its own shingles and sends them packed, four bytes each,
    to a part of the hash space; parts have a like number of shingles, whatever
    the table's, and a shingle that all texts have is there once a batch.
    """
    parts = 1 << max(6, ceil(words / _COUNTED).bit_length())
    shift = np.uint32(32 - (parts.bit_length() - 1))

    def packed(ids, texts):
        high = [(shingle_set(w, shingle) >> np.uint64(32)).astype(np.uint32) for w in texts]
        keys, counts = np.unique(np.concatenate(high) if high else np.array([], dtype=np.uint32), return_counts=True)
        ends = np.searchsorted(keys >> shift, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(ends))
        cut = lambda x: [x[ends[i] : ends[i + 1]].tobytes() for i in full]
        return [pa.array(full.astype(np.int32)), pa.array(cut(keys), pa.binary()), pa.array(cut(counts.astype(np.uint32)), pa.binary())]

    def merged(part):
        keys = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in part["keys"]])
        counts = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in part["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        powers = np.log2(np.add.reduceat(counts[order], first)).astype(np.int32)
        found = [(int(p), keys[powers == p]) for p in np.unique(powers[powers >= COMMON.bit_length() - 1])]
        return pd.DataFrame({"power": [p for p, _ in found], "n": [len(k) for _, k in found], "keys": [k.tobytes() for _, k in found]})

    sent = _each_text(texts, "part int, keys binary, counts binary", packed)
    counted = staged(sent.groupBy("part").applyInPandas(merged, "power int, n bigint, keys binary"))
    least, n = 33, 0
    for r in counted.groupBy("power").agg(F.sum("n").alias("n")).orderBy(F.col("power").desc()).collect():  # one row a power of two
        n += r["n"]
        if n > MOST_COMMON:
            break
        least = r["power"]
    often = counted.filter(F.col("power") >= least).select("power", "keys").collect()  # MOST_COMMON keys at most
    keys = [np.frombuffer(r["keys"], dtype=np.uint32) for r in often]
    powers = [np.full(len(k), r["power"], dtype=np.uint8) for k, r in zip(keys, often)]
    return Commons(np.concatenate([np.array([], dtype=np.uint32), *keys]), np.concatenate([np.array([], dtype=np.uint8), *powers]))


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and parities do not rule out."""
    side = lambda x: nodes.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
    most = f"{(1 - similarity) / (1 + similarity) + 1e-9} * (na + nb)"  # shingles in which similar sets may differ
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"abs(na - nb) <= {most}")
    folded = lambda x, y: F.expr(f"CASE WHEN size({x}) > size({y}) THEN zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q) ELSE {x} END")
    bits = sized.withColumns({"fa": folded("sa", "sb"), "fb": folded("sb", "sa")})
    differ = F.expr("aggregate(zip_with(fa, fb, (p, q) -> bit_count(p ^ q)), 0, (s, x) -> s + x)")
    return bits.filter((F.size("fa") == F.size("fb")) & (differ <= F.expr(most))).select("a", "b")


def _alike(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity, by the sets themselves.

    Texts are read again for the sets that the pairs name; a bounded filter of
    their ids spares most others the work, a join on the key the rest.
    """
    wanted = staged(pairs.select(F.col("b").alias("k"), "a", "b").union(pairs.select(F.col("a").alias("k"), "a", F.lit(None).cast("bigint").alias("b")).distinct()))
    named = wanted.select("k").distinct().join(nodes, "k").select(F.coalesce("least", F.lit(0)).bitwiseAND(F.lit((1 << _BITS) - 1)).alias("x"))
    bits = named.groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("m"))
    marks = np.zeros(1 << (_BITS - 6), dtype=np.int64)
    for r in bits.collect():  # 2^17 rows at most
        marks[r["w"]] = r["m"]
    known = texts.sparkSession.sparkContext.broadcast(marks)

    def some(batches):
        for b in batches:
            x = b.column(0).fill_null(0).to_numpy(zero_copy_only=False) & ((1 << _BITS) - 1)
            keep = b.column(1).take(pa.array(np.flatnonzero((known.value[x >> 6] >> (x & 63)) & 1)))
            words = [words_in(t) for t in keep.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(text_key, words)), pa.int64()), _lists([shingle_set(w, shingle) for w in words])], ["k", "s"])

    sets = texts.mapInArrow(some, "k bigint, s array<bigint>").join(wanted.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.first("s").alias("s"))
    sides = staged(sets.join(wanted, "k").select("a", "b", "s"))
    met = sides.filter("b IS NOT NULL").withColumnRenamed("s", "sb").join(sides.filter("b IS NULL").select("a", F.col("s").alias("sa")), "a")
    sized = met.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("m"), (F.size("sa") + F.size("sb")).alias("n"))
    return sized.filter(F.col("m") / (F.col("n") - F.col("m")) >= similarity).select("a", "b")


def _ball_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of text keys that SimHash links, of rows (k, fp): the first text of each fingerprint with the others, and with those that the balls link."""
    firsts = staged(rows.groupBy("fp").agg(F.min("k").alias("first")))
    same = rows.select("fp", "k").distinct().join(firsts, "fp").select(F.col("first").alias("a"), F.col("k").alias("b"))
    side = lambda x: firsts.select(F.col("fp").alias(x), F.col("first").alias(f"k{x}"))
    near = links(firsts.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return same.union(near).filter("a <> b").distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component yet."""
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _of_size(n: str, m: str, similarity: float) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _leads(similarity: float) -> Column:
    """Whether a set's shingle stands early enough to bring a set of its size or a larger one (n, i: the set's size, the shingle's place).

    Such sets share 2s / (1 + s) of the smaller one's shingles, so all but that
    many less one are enough for the smaller set; the larger one needs its whole
    prefix.
    """
    return F.col("i") < F.col("n") - F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("n") - 1e-9) + 1


def _can_be_alike(similarity: float, n: str = "n", i: str = "i", m: str = "m", j: str = "j") -> Column:
    """Whether sets of sizes n and m can be that similar if the first shingle they share stands at places i and j."""
    shared = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return _of_size(n, m, similarity) & (shared >= F.lit(similarity / (1 + similarity)) * (F.col(n) + F.col(m)) - 1e-6)


def _open_pairs(shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs inside buckets whose members are not in one component yet: a leading shingle of the smaller set, any of the larger's prefix."""
    labelled = shared.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    bucket = Window.partitionBy("v")
    split = staged(labelled.select("v", "k", "n", "i", "leads", "root", F.min("root").over(bucket).alias("lo"), F.max("root").over(bucket).alias("hi")).filter("lo <> hi").select("v", "k", "n", "i", "leads", "root"))
    other = split.select("v", F.col("k").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other"))
    smaller = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("k") < F.col("b")))
    met = split.filter("leads").join(other, "v").filter(smaller & (F.col("root") != F.col("other")) & _can_be_alike(similarity))
    return met.select(F.least("k", "b").alias("a"), F.greatest("k", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, component_id, stays) of every row; links are all pairs of texts whose word shingles are that similar.

    h is Spark's xxhash64 of the text; `stays` marks the component's first row
    (and its copies): the smallest doc_id, null last, then the smallest text key.

    SimHash comes first: the links of operator 6, its fingerprints and balls,
    are verified by the sets of shingles and join texts into components.  No few
    bits express such a similarity, though, so texts that these components do
    not join are candidates too if they share a shingle of their prefixes,
    which no similar pair fails to do.  All candidates are held against a parity sketch of their sets, which rules out
    no similar pair, and then verified by the exact Jaccard similarity of their
    sets of (64-bit hashes of) shingles.  Texts of equal words are one node.

    Sets are ordered with their rarest shingles first, so a shingle that a
    template puts on many pages is in few prefixes.  A pair meets in a shingle
    among the first ninth of the smaller set and the first fifth of the larger,
    and only if what follows it is enough for the similarity: pages that share
    less than that of a template never meet.  Each member of a bucket first
    meets the bucket's first leading member by a hash, if SimHash has not joined
    them; then members that the links found do not join yet meet each other, so a family of near copies
    costs its size and nothing is left out.
    Null and blank texts form one component; null ids never name one unless all
    its ids are null.  Repeated rows are one node; an empty table gives no rows;
    very long texts are sets as others are; extra columns are ignored.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("h"))
    fps = lambda texts: pa.array(np.array(list(map(fingerprint_of, texts)), dtype=np.uint64).view(np.int64))
    keyed = lambda ids, texts, h: [ids, h, pa.array(list(map(text_key, texts)), pa.int64()), fps(texts), pa.array(list(map(len, texts)), pa.int64())]
    rows = staged(_each_text(texts, "doc_id bigint, h bigint, k bigint, fp bigint, words bigint", keyed, 2))
    balls = staged(_ball_pairs(rows))
    words = rows.agg(F.sum("words")).first()[0] or 0
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, shingle, words))

    def described(ids, texts):
        sets = [shingle_set(w, shingle) for w in texts]
        heads = [prefix(g, similarity, common.value) for g in sets]
        return [ids, pa.array(list(map(text_key, texts)), pa.int64()), pa.array(list(map(len, sets)), pa.int32()), _lists([parities(g) for g in sets]), _lists(heads)]

    told = _each_text(texts, "doc_id bigint, k bigint, n int, bits array<bigint>, vs array<bigint>", described)
    nodes = staged(told.groupBy("k").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("vs").alias("vs")))
    members, nodes = nodes.select("k", "n", F.posexplode("vs").alias("i", "v")).withColumn("leads", _leads(similarity)), nodes.drop("vs")
    bucket = Window.partitionBy("v")
    centre = F.min(F.when(F.col("leads"), F.struct(F.xxhash64("k").alias("h"), "k", "n", "i"))).over(bucket)
    found = members.withColumns({"o": centre, "c": F.count("*").over(bucket)}).filter("c > 1 AND o IS NOT NULL")
    shared = staged(found.select("v", "k", "n", "i", "leads", F.col("o.k").alias("o"), F.col("o.n").alias("m"), F.col("o.i").alias("j")))
    alike = lambda pairs: staged(_alike(pairs, texts, nodes, similarity, shingle))
    seen = staged(_likely(balls, nodes, similarity))
    linked = alike(seen)
    roots = components(linked)
    star = shared.filter((F.col("k") != F.col("o")) & _can_be_alike(similarity)).select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b")).distinct()
    for pairs in (lambda: _apart(star, roots), lambda: _open_pairs(shared.select("v", "k", "n", "i", "leads"), roots, similarity)):
        likely = staged(_likely(pairs(), nodes, similarity).join(seen, ["a", "b"], "left_anti"))
        if not likely.isEmpty():
            seen, linked = seen.union(likely), linked.union(alike(likely))
            roots = components(linked)
    named = nodes.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    place = F.struct(F.col("least").isNull().alias("none"), "least", "k")
    first = named.groupBy("root").agg(F.min(place).alias("first"))
    of_key = staged(named.select("k", "root").join(first, "root").select("k", F.col("first.least").alias("component_id"), F.col("first.k").alias("_k")))
    met = rows.join(of_key, "k")
    return met.select("doc_id", "h", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("k") == F.col("_k"))).alias("stays"))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
