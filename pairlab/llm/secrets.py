"""Operator 3: secret scans through a trigram inverted index.

The index is partitioned by document, as search engines do it: each Arrow batch
holds its own postings, so no text is shuffled and memory is one batch.  For
every rule a Boolean trigram query is derived from the regex's parse tree
(Cox, 2012): literals give conjunctions, alternations give disjunctions.
Postings of the queries' trigrams are intersected, and the rule's regex runs
over the candidates' whole texts.  A rule without mandatory trigrams (a run of
hex digits) scans every text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    """`least` characters are asked of `group`; shorter matches are found and dropped."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0


# The three base kinds, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 16),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 32),
)
# Public formats of further credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"(?<![a-z])[a-z]{2,}://[A-Za-z0-9._-]+:[^\s:@/]{3,}@[A-Za-z0-9.-]+"),
)
#: Literal sets of a regex part larger than this are cut into trigrams and not extended.
MOST_STRINGS = 64


def _of_strings(strings: set[str]):
    """A query that any text with one of these strings meets; True: every text."""
    options = []
    for s in strings:
        grams = {s[i : i + 3] for i in range(len(s) - 2)}
        if not grams:
            return True
        options.append(("and", *sorted(grams)))
    return options[0] if len(options) == 1 else ("or", *sorted(options))


def _both(a, b):
    return b if a is True else a if b is True else ("and", a, b)


def _walk(items) -> tuple[set[str] | None, object]:
    """(all strings that these items match, or None; a query that every match meets)."""
    query, now, exact = True, {""}, True
    for op, arg in items:
        part, own = None, True
        if op is sre.LITERAL and arg < 128:
            part = {chr(arg).lower()}
        elif op is sre.IN:
            chars = [chr(a).lower() for o, a in arg if o is sre.LITERAL]
            part = set(chars) if len(chars) == len(arg) <= 8 and "".join(chars).isascii() else None
        elif op is sre.AT:
            part = {""}
        elif op is sre.SUBPATTERN:
            part, own = _walk(arg[3])
        elif op is sre.BRANCH:
            found = [_walk(b) for b in arg[1]]
            part = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
            own = True if any(q is True for _, q in found) else ("or", *(q for _, q in found))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            strings, q = _walk(inner)
            if strings is not None and most <= 4:
                part = {"".join(x) for n in range(least, most + 1) for x in product(sorted(strings), repeat=n)}
            elif least:
                own = q
        if part is not None and len(now) * len(part) <= MOST_STRINGS:
            now = {a + b for a in now for b in part}
            continue
        query, exact = _both(query, _of_strings(now)), False
        now, query = (part, query) if part is not None and len(part) <= MOST_STRINGS else ({""}, _both(query, own))
    return (now if exact else None), _both(query, _of_strings(now))


def trigram_query(rule: Rule):
    """("and" | "or", parts…) over lower-case trigrams, or True where the rule has no mandatory ones."""
    return _walk(sre_parse.parse(rule.pattern, rule.flags))[1]


def trigrams_in(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1:]))


class Postings:
    """Trigram → ascending row numbers of one batch, for the trigrams asked for; ASCII case is folded."""

    STEP = 1 << 22

    def __init__(self, texts: pa.Array, trigrams: list[str]):
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        codes = np.array([int.from_bytes(t.encode(), "big") for t in trigrams], dtype=np.int64)
        starts = np.zeros(1 << 16, dtype=bool)
        starts[codes >> 8] = True
        texts = texts.cast(pa.large_string())  # Spark may send either width of offsets
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        found: list[np.ndarray] = []
        first, end = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
        for a in range(first, end, self.STEP):
            part = lower[data[a : min(end, a + self.STEP + 2)]]
            if len(part) < 3:
                break
            at = np.flatnonzero(starts[(part[:-2].astype(np.uint16) << 8) | part[1:-1]])
            code = (part[at].astype(np.int64) << 16) | (part[at + 1].astype(np.int64) << 8) | part[at + 2]
            keep = np.isin(code, codes)
            row = np.searchsorted(offsets, at[keep] + a, side="right") - 1
            inside = at[keep] + a + 3 <= offsets[row + 1]
            found.append(np.unique((code[keep][inside] << 32) | row[inside]))
        all_ = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        self.rows = {t: all_[slice(*np.searchsorted(all_, (c << 32, (c + 1) << 32)))] & 0xFFFFFFFF for t, c in zip(trigrams, codes.tolist())}

    def meet(self, query) -> np.ndarray:
        if isinstance(query, str):
            return self.rows[query]
        op, *parts = query
        out = self.meet(parts[0])
        for p in parts[1:]:
            out = np.intersect1d(out, self.meet(p), assume_unique=True) if op == "and" else np.union1d(out, self.meet(p))
        return out


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


def _fast(rule: Rule) -> re.Pattern:
    """A greedy run of one class that must be long enough is the same as a run of at least that length."""
    if re.fullmatch(r"\[[^]]*\]\+", rule.pattern) and rule.group == 0:
        return re.compile(rule.pattern[:-1] + f"{{{rule.least},}}", rule.flags)
    return re.compile(rule.pattern, rule.flags)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>) of every row, in code points, end exclusive.

    Spans are ordered by start, then rule.  Null texts count as empty, null ids
    stay; repeated rows are scanned once each; an empty table gives no rows; a
    very long text is scanned whole; extra columns are ignored.
    """
    queries = [trigram_query(r) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_in, queries)))

    def work(batches):
        compiled = [_fast(r) for r in rules]
        for batch in batches:
            texts = batch.column(1).fill_null("")
            postings = Postings(texts, trigrams)
            spans: dict[int, list] = {}
            decoded: dict[int, str] = {}
            for k, (rule, query, regex) in enumerate(zip(rules, queries, compiled)):
                rows = range(len(texts)) if query is True else postings.meet(query).tolist()
                for i in rows:
                    text = decoded.get(i)
                    if text is None:
                        text = texts[i].as_py()
                        if query is not True:
                            decoded[i] = text
                    for a, b in matches(rule, regex, text):
                        spans.setdefault(i, []).append((a, k, b))
            out = [[{"kind": rules[k].kind, "start": a, "end": b, "base": k < len(BASE)} for a, k, b in sorted(spans.get(i, ()))] for i in range(len(texts))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, spans array<struct<kind: string, start: bigint, `end`: bigint, base: boolean>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The reference form of a span list in tests: kind:start:end, comma-joined, SHA-256."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
