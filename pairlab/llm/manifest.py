"""Operator 13: Merkle manifest of a table as a postorder append log.

Every tree's leaves stand in order; runs of eight consecutive nodes become the
digest of their concatenation until one remains.  The log holds a tree's nodes
in order of completion: a leaf, then every node that it completes, upwards.
Node j of level l is complete with leaf e = min(8^l (j + 1), n) - 1, and before
that leaf stand e leaves and, for each level m, the e div 8^m nodes complete by
then, so its position is

    e + e div 8 + e div 64 + … + l

without a look at the log.  Aligned builders (512 leaves, three levels) write
their part of the log on their own; their last nodes are the leaves of the next
builders, so a table of 512^k rows takes k passes and no group is larger than
512.  Proofs address siblings by position: those below level three stand in the
leaf's own part, the few above are the same for the whole part and are looked up
once for it.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

FAN, RISE = 8, 3
#: Leaves of one builder.
SPAN = FAN**RISE
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEVELS = 20  # 8^20 rows fit in a bigint


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def position(e: int, level: int) -> int:
    """Place in the log of the node of that level which is complete with leaf e."""
    at = level
    while e:
        at += e
        e //= FAN
    return at


def last_leaf(j: int, level: int, n: int) -> int:
    """The leaf that completes node j of a level."""
    return min(FAN**level * (j + 1), n) - 1


def nodes_at(level: int, n: int) -> int:
    return -(-n // FAN**level)


def depth(n: int) -> int:
    """Levels above the leaves; a lone leaf has none."""
    d = 0
    while nodes_at(d, n) > 1:
        d += 1
    return d


def completed(digests: list[str], first: int, level: int, n: int, own: bool) -> list[tuple[int, str]]:
    """The part of the log that a builder writes: (position, digest) of all nodes over consecutive nodes of a level, in order of completion.

    `first` is the index of the first of them; `own` adds these nodes themselves.
    """
    out = []
    for low in range(level, level + RISE + 1):
        if own or low > level:
            out += [(position(last_leaf(first + k, low, n), low), h) for k, h in enumerate(digests)]
        if nodes_at(low, n) == 1:
            break
        digests = [sha256("".join(digests[k : k + FAN]).encode()).hexdigest() for k in range(0, len(digests), FAN)]
        first //= FAN
    return sorted(out)


def ordered(rows: DataFrame, order: list[str], tree: str = "tree") -> DataFrame:
    """rows with `i`, the 0-based ordinal in its tree by `order`, and `n`, the tree's rows; equal rows in any order.

    Rows are dealt to ranges once and sorted there; ranges are counted, so no
    task sees a whole tree.
    """
    spark = rows.sparkSession
    keyed = staged(rows.withColumn("_r", F.monotonically_increasing_id()))  # ties are told apart by what is written, the same in every attempt
    keys = [tree, *order, "_r"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    ranges = dealt.groupBy(tree, F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    upto = Window.partitionBy(tree).orderBy("_p")
    placed = ranges.select(tree, "_p", (F.coalesce(F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_c").over(Window.partitionBy(tree)).alias("n"))
    return dealt.withColumn("_p", F.shiftright("_m", 33)).join(placed, [tree, "_p"]).withColumn("i", F.col("_m") + F.col("_shift")).drop("_p", "_m", "_r", "_shift")


def append_log(rows: DataFrame, tree: str = "tree", digest: str = "leaf") -> DataFrame:
    """rows (tree, i, n, digest) → the log (tree, pos, digest, seg, level): every node once, staged; seg and level name the builder that wrote it."""
    most = rows.agg(F.max("n")).first()[0] or 0
    columns = f"{tree} string, n bigint, seg bigint, level int, pos bigint, digest string"

    def builder(level):
        def build(key, part):
            name, n, seg = key[0], int(key[1]), int(key[2])
            done = completed(part.sort_values("i")["digest"].tolist(), seg * SPAN, level, n, level == 0)
            return pd.DataFrame({tree: name, "n": n, "seg": seg, "level": level, "pos": [p for p, _ in done], "digest": [h for _, h in done]})

        return build

    nodes, level, log = rows.select(tree, "n", "i", F.col(digest).alias("digest")), 0, []
    while True:
        written = staged(nodes.withColumn("seg", F.expr(f"i div {SPAN}")).groupBy(tree, "n", "seg").applyInPandas(builder(level), columns))
        log.append(written)
        level += RISE
        if FAN**level >= most:
            return reduce(DataFrame.union, log)
        tops = written.groupBy(tree, "n", F.col("seg").alias("i")).agg(F.max_by("digest", "pos").alias("digest"))
        nodes = tops.filter(F.col("n") > FAN**level)


def roots(log: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, root): the node that is complete last."""
    return log.groupBy(tree).agg(F.max_by("digest", "pos").alias("root"))


def _above(rows: DataFrame, log: DataFrame, tree: str) -> DataFrame:
    """(tree, seg, pos, digest): nodes of the levels from RISE on that stand beside the way of a builder's leaves to the root."""
    at = "aggregate(sequence(0, {0}), cast(m as bigint), (s, k) -> s + (least(shiftleft(1L, 3 * m) * (j + 1), n) - 1) div shiftleft(1L, 3 * k))".format(_LEVELS)
    parts = rows.select(tree, "n", F.expr(f"i div {SPAN}").alias("seg")).distinct()
    levels = parts.select("*", F.explode(F.expr(f"filter(sequence({RISE}, {_LEVELS}), m -> shiftleft(1L, 3 * m) < n)")).alias("m"))
    own = levels.withColumn("a", F.expr(f"seg div shiftleft(1L, 3 * (m - {RISE}))"))
    run = own.select("*", F.explode(F.expr(f"sequence({FAN} * (a div {FAN}), least({FAN} * (a div {FAN}) + {FAN}, (n - 1) div shiftleft(1L, 3 * m) + 1) - 1)")).alias("j")).filter("j <> a")
    return run.select(tree, "seg", F.expr(at).alias("pos")).join(log.select(tree, "pos", "digest"), [tree, "pos"]).select(tree, "seg", "pos", "digest")


def proofs(rows: DataFrame, log: DataFrame, keep: list[str], tree: str = "tree") -> DataFrame:
    """rows (tree, i, n, …) → (tree, keep…, lefts, rights): for every level up to the tree's root, the siblings' digests before and after the node, joined."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = ", ".join([f"{tree} string", *[f"`{c}` {fields[c]}" for c in keep], "lefts array<string>", "rights array<string>"])
    own = log.filter("level = 0").select(tree, "seg", "pos", "digest")
    beside = own.union(_above(rows, log, tree))

    def extract(key, leaves, nodes):
        found = dict(zip(nodes["pos"].tolist(), nodes["digest"].tolist()))
        lefts, rights = [], []
        for i, n in zip(leaves["i"].tolist(), leaves["n"].tolist()):
            left, right = [], []
            for m in range(depth(n)):
                a = i // FAN**m
                first = FAN * (a // FAN)
                run = range(first, min(first + FAN, nodes_at(m, n)))
                digest = lambda js: "".join(found[position(last_leaf(j, m, n), m)] for j in js)  # noqa: B023, E731
                left.append(digest(run[: a - first]))
                right.append(digest(run[a - first + 1 :]))
            lefts.append(left)
            rights.append(right)
        return leaves[[tree, *keep]].assign(lefts=lefts, rights=rights)

    parts = rows.withColumn("seg", F.expr(f"i div {SPAN}")).select(tree, "seg", "i", "n", *keep)
    return parts.groupBy(tree, "seg").cogroup(beside.groupBy(tree, "seg")).applyInPandas(extract, columns)


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A tree holds the rows of one lang (null is a lang of its own, before all
    others) by ascending doc_id, null first; rows of one doc_id follow each other
    by their leaf, and equal rows are leaves of their own.  The trees' roots are
    the leaves of the top tree.  `tampered` is the text as it is found now: its
    leaf and the siblings of the original give `folded_root`.  A null text, id or
    count is the leaf's `-`; very long texts are hashed whole; an empty table has
    no rows; extra columns are ignored, whatever their names.
    """
    text = F.col("text")
    values = lambda t: [t if c == "text" else F.col(c) for c in fields]
    found = F.col("text") if tampered is None else tampered
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    now = F.when(found.eqNullSafe(text), None).otherwise(leaf_digest(values(found)))
    rows = ordered(docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest(values(text)).alias("leaf"), now.alias("now")), ["doc_id", "leaf"])
    log = append_log(rows)
    subroots = roots(log).select(F.lit("").alias("top"), "tree", F.col("root").alias("subroot"))
    trees = ordered(subroots, ["tree"], "top")
    top = append_log(trees, "top", "subroot")
    ways = staged(proofs(trees, top, ["tree", "subroot"], "top").crossJoin(roots(top, "top").select("root")))  # one root
    up = ways.select("tree", "subroot", "root", F.col("lefts").alias("_l"), F.col("rights").alias("_r"))
    whole = proofs(rows, log, ["doc_id", "leaf", "now"]).join(up, "tree").withColumns({"lefts": F.concat("lefts", "_l"), "rights": F.concat("rights", "_r")})
    back = folded(F.coalesce("now", "leaf"), F.col("lefts"), F.col("rights"))
    return whole.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column, doc_id: Column) -> Column:
    """The query's tampering: A-Z in lower case where 3 divides the CRC of the decimal id."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, upper, upper.lower())).otherwise(text)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), lowered(F.col("text"), F.col("doc_id")))


def _sql(levels: int = 8) -> str:
    """Levels are unrolled: enough for 8^levels rows of a lang and as many langs."""
    encode = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda t: "sha256(" + " || ".join(encode(t if c == "text" else c) for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, o: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    steps = []

    def climb(name: str, tree: str) -> None:
        """{name}0 (tree, i, n, h) is there, and {name}p0 (tree, k, i, proof, f), a row a leaf k with its way so far."""
        for m in range(levels):
            steps.append(f"{name}{m + 1} AS (SELECT {tree}, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT {tree}, i AS i0, i, n, h FROM {name}{m}) GROUP BY {tree}, i // 8, n)".replace("ORDER BY i)", "ORDER BY i0)"))
            beside = f"SELECT p.k, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.i), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.i), '') AS r FROM {name}p{m} p JOIN {name}{m} s ON p.{tree} = s.{tree} AND p.i // 8 = s.i // 8 GROUP BY p.k"
            steps.append(f"{name}s{m} AS ({beside})")
            steps.append(f"{name}p{m + 1} AS (SELECT p.{tree}, p.k, p.i // 8 AS i, CASE WHEN n.n = 1 THEN p.proof ELSE p.proof || s.l || s.r END AS proof, CASE WHEN n.n = 1 THEN p.f ELSE sha256(s.l || p.f || s.r) END AS f FROM {name}p{m} p JOIN {name}s{m} s USING (k) JOIN (SELECT DISTINCT {tree}, n FROM {name}{m}) n ON n.{tree} = p.{tree})")

    climb("a", "tree")
    steps.append("b0 AS (SELECT 0 AS top, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h, tree FROM a%d)" % levels)
    steps.append("bp0 AS (SELECT 0 AS top, p.k, b0.i, p.proof, p.f FROM ap%d p JOIN b0 USING (tree))" % levels)
    climb("b", "top")
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"({lower})")} END AS now FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS k, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
a0 AS (SELECT tree, i, n, leaf AS h FROM o),
ap0 AS (SELECT tree, k, i, '' AS proof, coalesce(now, leaf) AS f FROM o),
{", ".join(steps)}
SELECT o.doc_id, o.leaf, b0.h AS subroot, z.h AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = z.h AS verified
FROM o JOIN b0 USING (tree) JOIN bp{levels} p USING (k) CROSS JOIN b{levels} z
"""


OP13_SQL = _sql()
