"""Properties of the small helpers that run inside tasks."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa
from pairlab.llm import chat, packing, prefixhash, secrets, simhash

PIECES = st.lists(st.sampled_from(["\\", "[", "/", "INST]", "[INST]", "</s>", "<s>", "<", "s>", "[/REPLY]", "[/", "REPLY]", "é", "\n", " x"]), max_size=14).map("".join)


@given(PIECES)
@settings(max_examples=500, deadline=None)
def test_escapes_are_reversible_and_hide_controls(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "\\n\n[INST]\\"]), PIECES), max_size=5))
@settings(max_examples=200, deadline=None)
def test_conversations_read_back(turns):
    ids, mask, said = chat.assemble(turns)
    assert chat.text_of(ids) == said and chat.read_back(said) == turns
    assert chat.masked_text(ids, mask) == "".join(t for r, t in turns if r == "assistant")


@given(st.integers(1, 5000), st.integers(1, 1024))
@settings(deadline=None)
def test_cuts_cover_a_document(n, capacity):
    cuts = packing.cut(n, capacity)
    assert sum(k for _, k in cuts) == n and all(k == capacity for _, k in cuts[1:]) and [s + k for s, k in cuts[:-1]] == [s for s, _ in cuts[1:]] and cuts[0][0] == 0


@given(st.lists(st.text(alphabet="pasword=:tkenAKI_ghAB0123456789 cdef'\"", max_size=60), max_size=6))
@settings(max_examples=300, deadline=None)
def test_trigram_queries_lose_no_match(texts):
    rules = [r for r in secrets.BASE + secrets.MORE if secrets.trigram_query(r) is not True]
    grams = sorted(set().union(*(secrets.trigrams_in(secrets.trigram_query(r)) for r in rules)))
    postings = secrets.Postings(pa.array(texts, pa.string()), grams)
    for r in rules:
        found = set(postings.meet(secrets.trigram_query(r)).tolist())
        assert {i for i, t in enumerate(texts) if re.search(r.pattern, t, r.flags)} <= found


@given(st.text(max_size=80), st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_span_hashes_agree_with_text(a, b):
    x, y = (prefixhash.PrefixHash(prefixhash.codes_of(s)) for s in (a + b, b))
    assert x.span(len(a), len(a) + len(b)) == y.span(0, len(b)) and x.extension(len(a), y, 0) == len(b)
    assert prefixhash.likeness(x.fingerprint(), x.fingerprint()) == 1.0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=600))
@settings(max_examples=50, deadline=None)
def test_majority_counts_bits(hashes):
    import numpy as np

    got = int(simhash.majority(np.array(hashes, dtype=np.uint64).reshape(-1, 1))[0])
    assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_families_stay_bounded():
    """100 and 200 languages whose means chain: no family has more than twice the root of all, and none is lost."""
    from math import ceil

    import numpy as np

    from pairlab.llm import language

    for n in (1, 2, 4, 5, 100, 200):
        rng = np.random.default_rng(n)
        means = {f"l{i:03d}": np.ones(64) * 2 + rng.normal(size=64) * (0.1 + i / n) for i in range(n)}
        found = language.families(means)
        assert sorted(s for g in found for s in g) == sorted(means) and max(map(len, found)) <= 2 * ceil(n**0.5)
        assert sum(len(g) * (len(g) - 1) // 2 for g in found) <= 2 * n**1.5 + 2
