"""Operator 10: edit-aware token counts over pre-token segment trees.

A document is split into pre-tokens, the units that byte-level BPE never merges
across.  Its segment tree has a slot per pre-token and sums, in every inner
node, the characters and tokens below.  An edit finds its slots by descent,
re-splits from a little before the edit (the pattern looks at most three
characters ahead) until the new boundaries meet old ones again, encodes only
those pre-tokens, and updates the sums on the paths to the root.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import encoding

#: Characters that a pre-token's end can depend on beyond itself.
AHEAD = 3
#: Counts of pre-tokens that a worker keeps; the memo starts anew when it is full.
MEMO = 300_000


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


class _Counts(dict):
    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = len(encoding().encode_ordinary(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


_counts = _Counts()


class TokenTree:
    """Token count of a text under edits.

    A slot holds the pre-tokens that stand in its place; an edit puts its new
    pre-tokens into one slot and empties the others, so the tree keeps its shape.
    """

    def __init__(self, text: str):
        self.slots: list[list[str]] = [[p] for p in _pattern().findall(text)] or [[]]
        self.size = 1 << (len(self.slots) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.size), dtype=np.int64)  # characters, tokens
        flat = [s[0] for s in self.slots if s]
        self.sums[0, self.size : self.size + len(flat)] = np.fromiter(map(len, flat), np.int64, len(flat))
        self.sums[1, self.size : self.size + len(flat)] = np.fromiter(map(_counts.__getitem__, flat), np.int64, len(flat))
        at = self.size
        while at > 1:
            self.sums[:, at // 2 : at] = self.sums[:, at : 2 * at].reshape(2, -1, 2).sum(axis=2)
            at //= 2
        self.encoded = len(flat)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    def find(self, char: int) -> tuple[int, int]:
        """(slot that holds a character, or the last slot; characters before the slot)."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[0, node])
            if char - before >= left and self.sums[0, node + 1]:
                before, node = before + left, node + 1
        return min(node - self.size, len(self.slots) - 1), before

    def _set(self, slot: int, pieces: list[str]) -> None:
        self.slots[slot] = pieces
        node = self.size + slot
        self.sums[:, node] = sum(map(len, pieces)), sum(map(_counts.__getitem__, pieces))
        while node > 1:
            node //= 2
            self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]

    def replace(self, at: int, remove: int, insert: str) -> int:
        """Replace `remove` characters from `at`; how many pre-tokens were encoded anew."""
        at = min(max(at, 0), self.chars)
        remove = min(max(remove, 0), self.chars - at)
        first, before = self.find(max(at - AHEAD, 0))
        more = self.find(at + remove)[0] + 1
        while True:
            old = [p for slot in self.slots[first:more] for p in slot]
            region = "".join(old)
            head = region[: at - before] + insert
            whole = head + region[at - before + remove :]
            ends = np.cumsum([len(p) for p in old]) + len(whole) - len(region)  # old boundaries, as places of the new region
            meet = {int(e): i + 1 for i, e in enumerate(ends) if e >= len(head)}
            pieces, rest, done = [], None, more >= len(self.slots)
            for m in _pattern().finditer(whole):
                if not done and m.end() + AHEAD > len(whole):
                    break  # its end may depend on what follows the region
                pieces.append(m[0])
                if m.end() in meet:
                    rest = old[meet[m.end()] :]  # from here on the old pre-tokens stand
                    break
            if rest is not None or done:
                break
            more = min(more + max(4, more - first), len(self.slots))
        self._set(first, pieces + (rest or []))
        for slot in range(first + 1, more):
            if self.slots[slot]:
                self._set(slot, [])
        self.encoded += len(pieces)
        return len(pieces)

    def text(self) -> str:
        return "".join(p for s in self.slots for p in s)


def count_with_edits(docs: DataFrame, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_tokens_edited, n_chars_edited, n_reencoded) of every row.

    `edits` is array<struct<at, remove, insert>>, applied in order, each to
    the text as the ones before it left it, so edits may overlap; places past
    the end mean the end; null edits are none; a null text is empty; a null id
    stays.  Repeated rows are counted each; an empty table gives no rows; a very
    long text is one tree; extra columns are ignored.  Texts are plain: the
    characters of a special token's name are counted as any others.
    """
    names = ["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_reencoded"]

    def work(batches):
        for b in batches:
            rows = []
            for doc_id, text, edits in zip(*(c.to_pylist() for c in b.columns)):
                tree = TokenTree(text or "")
                n, m, again = tree.tokens, tree.encoded, 0
                for e in edits or ():
                    again += tree.replace(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                rows.append((doc_id, m, n, tree.tokens, tree.chars, again))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [()] * 6)], names)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col(text_col).cast("string"), F.col(edits_col))
    return rows.mapInArrow(work, ", ".join(f"{n} bigint" for n in names))


def three_edits(text) -> F.col:
    """An insertion in the middle, a deletion in the first quarter, a replacement near the end."""
    n = F.length(text)
    edit = lambda at, remove, insert: F.struct(at.cast("bigint").alias("at"), remove.cast("bigint").alias("remove"), insert.alias("insert"))
    return F.array(
        edit(F.floor(n / 2), F.lit(0), F.substring(text, 1, 40)),
        edit(F.floor(n / 4), F.lit(25), F.lit("")),
        edit(F.floor(n * 7 / 8), F.lit(7), F.lit("it's 42 new\n\n words")),
    )


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_with_edits(docs.withColumn("edits", three_edits(F.coalesce("text", F.lit("")))))
