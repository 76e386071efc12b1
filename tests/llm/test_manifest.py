"""Operator 13 against a sequential build of the same trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pairlab.llm import manifest

from .conftest import odd_rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def way(levels, i):
    """(before, after) siblings of leaf i, level by level."""
    out = []
    for nodes in levels[:-1]:
        a = i - i % 8
        out.append((nodes[a:i], nodes[i + 1 : a + 8]))
        i //= 8
    return out


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) → the query's rows."""
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    trees = {}
    for i, t, la, s, n in rows:
        bad = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        trees.setdefault((la is not None, (la or "").encode()), []).append((i is not None, i or 0, leaf_of(i, s, la, n, t), leaf_of(i, s, la, n, lower(t) if bad else t)))
    built = {k: levels_of([x[2] for x in sorted(v)]) for k, v in trees.items()}
    top = levels_of([built[k][-1][0] for k in sorted(built)])
    out = []
    for at, k in enumerate(sorted(built)):
        for i, (has, doc_id, leaf, now) in enumerate(sorted(trees[k])):
            steps = way(built[k], i) + way(top, at)
            h = now
            for before, after in steps:
                h = sha(*before, h, *after)
            out.append((doc_id if has else None, leaf, built[k][-1][0], top[-1][0], sha(*(x for b, a in steps for x in b + a)), h, h == top[-1][0]))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(df):
    got = manifest.manifest(df, manifest.lowered(F.col("text"), F.col("doc_id")))
    assert got.columns == NAMES
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_positions_number_a_postorder_walk():
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 700):
        places = [manifest.position(manifest.last_leaf(j, m, n), m) for m in range(manifest.depth(n) + 1) for j in range(manifest.nodes_at(m, n))]
        assert sorted(places) == list(range(len(places)))


@pytest.mark.parametrize("sizes", [(1,), (8, 1, 9), (513, 64), (4200, 3)])
def test_trees_of_any_size(spark, sizes):
    rows = [(1000 * k + i, f"Text {i * 7919 % 100}", f"l{k}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    assert run(df) == brute(rows)


def test_more_than_eight_langs(spark):
    rows = [(i, "A" * (i % 5), None if i % 75 == 3 else f"{'é' * (i % 3)}{i % 75}", None, None) for i in range(300)]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)) == brute(rows)


def test_odd_rows(odd, empty):
    """Null ids come first, equal rows are leaves of their own, null langs a tree of their own."""
    assert run(odd) == brute([r[:5] for r in odd_rows()])
    assert run(empty) == []


def test_names_used_inside(odd):
    extra = [F.lit("x").alias(c) for c in ("tree", "leaf", "now", "i", "n", "seg", "pos", "digest", "lefts", "rights", "_r", "_m", "_p", "top", "root")]
    assert run(odd.select("*", *extra)) == brute([r[:5] for r in odd_rows()])
