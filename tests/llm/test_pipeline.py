"""The pipeline against a brute-force version of its stages on the smallest tables."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from pairlab.llm.common import staged
from pairlab.llm.quality import judge

from .conftest import odd_rows
from .test_operators import check_packing


def brute_lines(docs):
    """Texts without recurring lines of (doc_id → text), as plain loops over a template tree."""
    keys, leaves, tokens = {}, defaultdict(set), {}
    for i, text in docs.items():
        for p, line in enumerate(text.split("\n")):
            w = tuple("<*>" if re.search("[0-9]", x) or not any(c.isalpha() for c in x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line))
            words = sum(x != "<*>" for x in w)
            if words >= 3 and 2 * words >= len(w):
                keys[i, p] = w
                leaves[len(w), w[:3]].add(w)
            elif any(c.isalnum() for c in line):
                keys[i, p] = line.strip(" \t\n\x0b\f\r")
    where = defaultdict(set)
    for at, k in keys.items():
        where[k].add(at)
    groups = list(where.values())
    for lines in leaves.values():
        if len(lines) > 1 and len({i for k in lines for i, _ in where[k]}) > 1:
            n = len(min(lines))
            common = [Counter(k[p] for k in lines).most_common(1)[0] for p in range(n)]
            constant = [x if x != "<*>" and 2 * c > len(lines) else None for x, c in common]
            c_of = {k: sum(x == y for x, y in zip(k, constant)) for k in lines}
            groups.append(set().union(*(where[k] for k, c in c_of.items() if c >= 3 and 2 * c >= n and 4 * c >= 3 * sum(x != "<*>" for x in k))))
    gone = set().union(*(g - {min(g)} for g in groups if len({i for i, _ in g}) > 1))
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs.items()}


def shingles(text, n=cp.SHINGLE):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def check_near(before, after):
    """Each group keeps its smallest id alone; no document goes without one of the stated similarity."""
    sets = {i: shingles(t) for i, t in before.items()}
    where = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            where[g].add(i)
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    for i in before:
        close = {j: alike(i, j) for j in set().union(*(where[g] for g in sets[i])) - {i}}
        if i in after:
            assert not any(a >= cp.SIMILARITY and j < i for j, a in close.items())
        else:
            assert any(a >= cp.SIMILARITY for a in close.values())


@pytest.fixture(scope="module")
def stages(spark, sf, documents):
    docs, out = documents, []
    for name, stage in cp.STAGES:
        docs = staged(stage(spark, docs, sf))
        out.append(docs)
    return out


def test_stages_against_brute_force(documents, stages):
    columns = documents.columns
    assert all(s.columns == columns for s in stages[:-1])
    kept = {r["doc_id"]: r["text"] for r in stages[0].collect()}
    assert kept == {r["doc_id"]: r["text"] for r in judge(documents).filter("kept").select("_row.*").collect()}
    lines = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    assert lines == brute_lines(kept)
    near = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    assert all(lines[i] == t for i, t in near.items())
    check_near(lines, near)
    mixed = defaultdict(int)
    for r in stages[3].collect():
        assert near[r["doc_id"]] == r["text"]
        mixed[r["doc_id"]] += 1
    assert max(mixed.values()) <= 3
    check_packing(stages[4].collect(), [(r["doc_id"], r["text"]) for r in stages[3].collect()])


def test_run_equals_its_stages(spark, sf, stages):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(cp.run(spark, sf)) == key(stages[-1])


def test_run_leaves_only_its_result(spark, sf):
    """Inner tables and stages go as the next stage is written."""
    from pairlab.sources import publish

    with publish.staging_run(spark) as folder:
        out = cp.run(spark, sf)
        fs, path = publish._fs(spark, folder)
        left = [s.getPath().getName() for s in fs.listStatus(path)]
        assert len(left) == 1 and out.count() > 0 and all(left[0] in f for f in out.inputFiles())
    assert not fs.exists(path)


def test_near_dedup_of_rows_without_ids(spark):
    """Rows without an id go if a row with one is alike, and stay once in a group of their own; -2^63 is an id as any."""
    text = lambda t: " ".join(f"{t}{i}" for i in range(40))
    rows = [(None, text("a")), (3, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (-(2**63), text("d")), (None, text("d")), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, docs, "").collect()), key=repr)
    assert got == sorted([(3, text("a")), (None, text("b")), (None, text("c")), (-(2**63), text("d")), (None, "")], key=repr)


def test_odd_documents(spark, odd, empty):
    docs = odd.select(*[c for c in odd.columns if c != "key"])
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() <= 3 * len(odd_rows())
        assert stage(spark, empty, "").count() == 0
    assert cp.STAGES[-1][1](spark, docs, "").filter(F.col("length") > 1024).count() == 0


def test_near_copies(spark, documents, odd, empty):
    from pairlab.llm.simhash import near_copies

    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    base = max(texts.values(), key=len).split(" ")[:400]
    for k in range(30):  # near copies, one word in a hundred changed
        texts[10**6 + k] = " ".join(w if (i + k) % 100 else f"changed{k}" for i, w in enumerate(base))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies(df).collect()}
    assert len({got[10**6 + k] for k in range(30)}) == 1
    check_near(texts, {i: t for i, t in texts.items() if got[i] == i})
    found = {r["doc_id"]: r["component_id"] for r in near_copies(odd).collect()}
    assert found[2] == found[3] == found[6] == 2 and found[5] == 1 and near_copies(empty).count() == 0


def test_stages_take_columns_of_any_name(spark, odd, sf):
    """Names that stages use inside come back as they were."""
    import corpus_pipeline as cp

    names = ("_row", "_n_lines", "_n_dropped", "_nd_id", "_nd_hash", "_nd_none", "none", "id", "hash", "h", "k", "stays", "_ld_row", "_ld_masks", "component_id", "a.b")
    docs = odd.select("*", *[F.lit(c).alias(c) for c in names])
    for stage in (cp.quality_rules, cp.line_dedup, cp.near_dedup, cp.source_mixing):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all(r[len(odd.columns) :] == names for r in map(tuple, out.collect()))
