"""near_copies links exactly the texts whose shingle sets have the stated similarity."""

import random
from collections import defaultdict

import pytest

from pairlab.llm import simhash
from pairlab.llm.simhash import near_copies

from .test_pipeline import shingles


def words(rng, n, tag):
    return [f"{tag}{rng.randrange(10**9)}" for _ in range(n)]


def brute_components(texts, similarity=0.8):
    sets = {i: shingles(t) for i, t in texts.items()}
    where = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            where[g].add(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j in set().union(*(where[g] for g in s)):
            if j < i and len(s & sets[j]) / len(s | sets[j]) >= similarity:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def found(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in near_copies(df).collect()}


@pytest.mark.parametrize("share", [0.805, 0.83, 0.88])
def test_appended_and_truncated_copies_are_found(spark, share):
    rng, texts = random.Random(1), {}
    for k in range(40):
        w = words(rng, 300, "w")
        n = len(w) - 4
        texts[4 * k] = " ".join(w)
        texts[4 * k + 1] = " ".join(w + words(rng, int(n / share) - n, "x"))
        texts[4 * k + 2] = " ".join(w[: int(n * share) + 5])
    assert found(spark, texts) == brute_components(texts)
    assert all(brute_components(texts)[4 * k + 1] == brute_components(texts)[4 * k + 2] == 4 * k for k in range(40))


def test_pages_below_the_limit_stay_apart(spark):
    rng, texts = random.Random(2), {}
    for k in range(40):
        w = words(rng, 400, "w")
        n = len(w) - 4
        for m, share in enumerate((0.74, 0.76, 0.78, 0.795)):
            texts[10 * k + 2 * m] = " ".join(y := [f"{m}{x}" for x in w])
            texts[10 * k + 2 * m + 1] = " ".join(y[: int(n * share) + 4])
    assert brute_components(texts) == {i: i for i in texts} == found(spark, texts)


def test_templated_pages_link_all_near_copies(spark):
    """A family of one boilerplate, 0.6 alike across pages, with near copies inside."""
    rng, texts = random.Random(3), {}
    common = words(rng, 300, "c")
    for k in range(150):
        own = words(rng, 100, "w")
        near = own[:-10] + words(rng, 10, "x")
        texts[2 * k], texts[2 * k + 1] = " ".join(common + own), " ".join(common + near)
    want = brute_components(texts)
    assert len(set(want.values())) == 150
    assert found(spark, texts) == want


def test_pages_of_a_template_do_not_meet(spark, monkeypatch):
    """400 pages that share 85 % of their text and are 0.74 alike: hardly any pair is looked at, and the few near copies are found."""
    rng, texts = random.Random(4), {}
    common = words(rng, 340, "c")
    for k in range(400):
        texts[k] = " ".join(common + words(rng, 60, "w"))
    texts[400] = texts[7] + " and a few words more"
    listed, pairs = simhash._likely, []

    def counting(found, *rest):
        pairs.append(found.count())
        return listed(found, *rest)

    monkeypatch.setattr(simhash, "_likely", counting)
    got = found(spark, texts)
    assert got == {k: 7 if k == 400 else k for k in texts} and sum(pairs) < 20 * 400


def test_leading_shingles_bring_all_sizes(spark):
    """Pairs at the very limit, of equal and of the most different sizes, in a crowd that shares their common part."""
    rng, texts = random.Random(6), {}
    common = words(rng, 200, "c")
    for k in range(30):
        own = words(rng, 300, "w")
        base = common + own
        n = len(base) - 4
        m = int(n * 0.8) + 5  # the smallest prefix that is alike
        for j, t in enumerate((base, base[:m], base[: m - 2], base[-m:], base[:-30] + words(rng, 30, "x"), base[:-60] + words(rng, 60, "y"))):
            texts[6 * k + j] = " ".join(t)
    assert found(spark, texts) == brute_components(texts)


def test_real_texts(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert found(spark, texts) == brute_components(texts)


def test_small_sets(spark):
    rng, texts = random.Random(5), {}
    for i in range(150):
        w = list("abcdefghijkl"[: rng.randrange(1, 13)])
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "z"
        texts[i] = " ".join(w)
    assert found(spark, texts) == brute_components(texts)


def test_simhash_balls_find_their_links_themselves(spark, monkeypatch):
    """Without any shingle bucket, texts within 3 bits are still joined, by the links of operator 6; fingerprints alone link nothing."""
    from pyspark.sql import functions as F

    rng, texts = random.Random(8), {}
    for k in range(30):
        w = words(rng, 600, "w")
        texts[3 * k], texts[3 * k + 1] = " ".join(w), " ".join(w[:-1])
        texts[3 * k + 2] = " ".join(w[:300] + words(rng, 60, "x") + w[360:])  # alike, but not within 3 bits
    often = "a b c " * 500  # sets the fingerprint, not the set of shingles
    texts[900], texts[901] = often + " ".join(words(rng, 40, "y")), often + " ".join(words(rng, 40, "z"))
    fp = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    near = [i for i in range(0, 90, 3) if bin(fp[i] ^ fp[i + 1]).count("1") <= 3]
    far = [i for i in range(0, 90, 3) if all(bin(fp[i + 2] ^ fp[j]).count("1") > 3 for j in (i, i + 1))]
    assert len(near) > 20 and len(far) > 20 and bin(fp[900] ^ fp[901]).count("1") <= 3
    whole = found(spark, texts)
    assert whole == brute_components(texts) and whole[901] == 901 and all(whole[i + 2] == i for i in far)
    monkeypatch.setattr(simhash, "_leads", lambda similarity: F.lit(False))
    got = found(spark, texts)
    assert all(got[i + 1] == i for i in near) and all(got[i + 2] == i + 2 for i in far) and got[901] == 901


def test_buckets_leave_out_what_simhash_joined(spark, monkeypatch):
    """A family within 3 bits is verified by its SimHash links; no bucket brings its pairs again."""
    rng, seen, likely = random.Random(9), [], simhash._likely
    w = words(rng, 900, "w")
    texts = {k: " ".join(w[: 900 - k]) for k in range(6)}
    fp = [simhash.fingerprint(t.encode()) for t in texts.values()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in zip(fp, fp[1:]))

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return likely(pairs, *rest)

    monkeypatch.setattr(simhash, "_likely", counting)
    assert set(found(spark, texts).values()) == {0}
    assert seen[0] >= 5 and seen[1:] == [0, 0]
