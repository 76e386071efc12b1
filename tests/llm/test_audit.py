"""Operator 11 against brute force over all orders."""

from itertools import permutations

import numpy as np
import pytest

from pairlab.llm import audit

from .conftest import odd_rows

WHITE = " \t\n\x0b\f\r"


def masks(rows):
    """Rows (doc_id, text, lang) → (doc_id, part, set of failed filters)."""
    texts = [(i, t or "", la or "") for i, t, la in rows]
    out = []
    for i, t, part in texts:
        words, spaced = [], t
        for c in WHITE:
            spaced = spaced.replace(c, " ")
        words = [w for w in spaced.split(" ") if w]
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and u == t for j, u, _ in texts) else set()
        out.append((i, part, fails))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs, out = masks(rows), []
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        steps, shares = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for s, x in enumerate(order):
                left = [(i, f) for i, f in mine if not f & set(order[:s])]
                gone = [i for i, f in left if x in f]
                shares[x] += len(gone)
                failing = sum(x in f for _, f in mine)
                steps.append((order, s + 1, len(left) - len(gone), len(gone), failing - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i in gone), sum(i in toxic for i in gone)))
        out += [(part, *row, shares[row[0][row[1] - 1]]) for row in steps]
    return sorted(out)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def run(spark, docs, labels):
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit(docs, known)
    assert got.columns == NAMES
    return sorted(tuple(r) for r in got.collect())


def test_masks_and_orders(spark):
    word = lambda n, k: " ".join(f"w{i % k}x" for i in range(n))
    texts = [word(100, 100), word(100, 79), word(99, 99), word(100, 80), "AB " + word(100, 100), "a\x0bB" * 3, word(120, 120) + " #", "x" * 9 + "Y", "x" * 8 + "YY", "é" * 9 + "Y", None, "", word(100, 100), "ab cd", word(100, 100) + "\n", word(100, 100)]
    rows = [(len(texts) - i, t, ["en", None, ""][i % 3]) for i, t in enumerate(texts)]
    labels = [(i, i % 2, i % 3 // 2) for i, _, _ in rows] + [(3, None, 1), (None, 1, 1), (999, 1, 1), (1, 1, None)]
    assert run(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4), labels) == brute(rows, labels)


def test_odd_rows(spark, odd, empty):
    """Null ids repeat nothing; rows of one id that repeat count each; clashing names are ignored."""
    rows, labels = [r[:3] for r in odd_rows()], [(5, 1, 0), (4, 0, 1)]
    clash = odd.selectExpr("*", "1 AS part", "2 AS mask", "3 AS h", "4 AS may", "5 AS first", "6 AS good", "7 AS n", "8 AS toxic")
    assert run(spark, clash, labels) == brute(rows, labels)
    assert run(spark, empty, labels) == []
    assert len(run(spark, odd, [])) == 600 * len({r[2] or "" for r in odd_rows()})


def test_many_copies_and_a_full_sketch(spark):
    """A sketch far too small clears nothing and changes nothing."""
    rows = [(i, f"text {i // 3 if i % 2 else 'same'}", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = [sorted(map(tuple, audit.mask_counts(docs, labels, most_cells=m).collect())) for m in (audit.CELLS, audit.LEAST_CELLS)]
    want = {}
    for i, part, fails in masks(rows):
        m = sum(1 << "ABCDE".index(f) for f in fails)
        n, g = want.get((part, m), (0, 0))
        want[part, m] = n + 1, g + (i == 1)
    assert got[0] == got[1] == sorted((p, m, n, g, g) for (p, m), (n, g) in want.items())


def test_sketch_never_clears_a_repeat_and_clears_most_others(spark):
    h = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 6000)
    every = np.concatenate([h, h[:500], h[:200]])
    s = audit.sketch(spark.createDataFrame([(int(x),) for x in every], "h bigint").repartition(5))
    may = s.may_repeat(h)
    assert may[:500].all() and may[500:].mean() < 0.05


@pytest.mark.parametrize("bits", [15, 16])
def test_cells_of_python_and_spark_agree(spark, bits):
    """A hash seen twice alone in the table sets exactly the cells that are asked for."""
    for h in (-1, 0, 5, -(2**63), 2**63 - 1, 123456789012345678):
        s = audit.sketch(spark.createDataFrame([(h,), (h,)], "h bigint"), bits)
        assert s.may_repeat(np.array([h]))[0] and not s.may_repeat(np.array([h ^ 1 ^ (1 << 62)]))[0]
