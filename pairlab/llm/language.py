"""Operator 7: hierarchical language identification.

A text becomes a hashed histogram of letter 1- to 3-grams (case folded, other
characters as one blank, square roots, unit length).  A linear SVM per family
decides the family first; inside it one-versus-one linear SVMs vote.  Families
are learned too: languages with the nearest mean vectors are joined until about
the square root of their number is left.  Training data are a bounded sample:
at most `per_lang` labelled documents of a language (those of the least hashes
of id and text) and `total` over all, from at most `total` languages, the most
frequent ones; only their feature vectors reach the driver.  Prediction runs
over whole texts.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

DIM = 1 << 12
#: Bound of the training sample: documents of a language, and of all languages.
PER_LANG, TOTAL = 300, 2400
UNKNOWN = "und"
_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _ALPHA[0]


def features(text: str) -> np.ndarray | None:
    """Unit vector of `DIM` float32, or None for a text without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    alpha = _alpha()[codes]
    if not alpha.any():
        return None
    keep = alpha | np.concatenate([[True], alpha[:-1]])  # a run of other characters is one blank
    codes = np.where(alpha, codes, 32)[keep]
    a = (codes * 40503) & 0xFFFFFFFF
    b = ((a[:-1] * 31) ^ codes[1:]) * 2654435761 & 0xFFFFFFFF
    c = ((b[:-1] * 31) ^ codes[2:]) * 2654435761 & 0xFFFFFFFF
    x = np.bincount((a * 2654435761 & 0xFFFFFFFF) >> 20, minlength=DIM)
    x = x + np.bincount(b >> 20, minlength=DIM) + np.bincount(c >> 20, minlength=DIM)
    x = np.sqrt(x.astype(np.float32))
    return x / np.linalg.norm(x)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Linear SVM (squared hinge, class-balanced, accelerated gradient) with a bias as the last weight."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x1.shape[1], np.float32)
    ahead, t, step = w, 1.0, 1 / (2 * 2.0 + penalty)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        new = ahead - step * (penalty * ahead - 2 * x1.T @ (weight * y * slack))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + (old - 1) / t * (new - w), new
    return w


def families(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages in about √n groups: the two groups of the nearest means (by their average cosine) join first.

    No group grows beyond 2·√n languages, so there are at most some n^1.5 pairs
    to tell apart, however the means lie; groups that may not join stay apart.
    """
    groups = [[s] for s in sorted(means)]
    unit = {s: v / (np.linalg.norm(v) or 1.0) for s, v in means.items()}
    root = ceil(len(means) ** 0.5)
    while len(groups) > root:
        centre = np.array([np.mean([unit[s] for s in g], axis=0) for g in groups])
        near = centre @ centre.T
        sizes = np.array([len(g) for g in groups])
        near[sizes[:, None] + sizes[None, :] > 2 * root] = -2.0
        np.fill_diagonal(near, -2.0)
        i, j = sorted(np.unravel_index(int(np.argmax(near)), near.shape))
        if near[i, j] == -2.0:
            break
        groups[i] += groups.pop(j)
    return groups


class Model:
    """families[i] ↔ column i of `top`; `pairs[family]`: (language, language, weights)."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        y = np.array(langs, dtype=object)
        self.languages = sorted(set(langs))
        groups = families({s: x[y == s].mean(axis=0) for s in self.languages})
        self.members = {"+".join(sorted(g)): sorted(g) for g in groups}
        self.families = sorted(self.members)
        named = {s: f for f, g in self.members.items() for s in g}
        family = np.array([named[s] for s in langs], dtype=object)
        sign = lambda m: np.where(m, 1.0, -1.0).astype(np.float32)
        self.top = [svm(x, sign(family == f)) for f in self.families] if len(self.families) > 1 else [np.zeros(DIM + 1, np.float32)] * len(self.families)
        self.pairs = {
            f: [(a, b, svm(x[(y == a) | (y == b)], sign(y[(y == a) | (y == b)] == a))) for a, b in combinations(ms, 2)]
            for f, ms in self.members.items()
        }

    def predict(self, x: np.ndarray | None) -> tuple[str, float]:
        if x is None or not self.families:
            return UNKNOWN, 0.0
        margin = lambda w: float(x @ w[:-1] + w[-1])
        sure = lambda m: 1 / (1 + np.exp(-4 * min(max(m, -10.0), 10.0)))
        tops = [margin(w) for w in self.top]
        best = int(np.argmax(tops))
        family = self.families[best]
        rest = max((m for i, m in enumerate(tops) if i != best), default=-10.0)
        score = float(sure((tops[best] - rest) / 2))
        members = self.members[family]
        votes = {m: [0, 0.0] for m in members}
        for a, b, w in self.pairs[family]:
            m = margin(w)
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        lang = max(members, key=lambda s: votes[s])
        if len(members) > 1:
            score *= float(sure(votes[lang][1] / (len(members) - 1)))
        return lang, score


def fit(labelled: DataFrame, per_lang: int = PER_LANG, total: int = TOTAL) -> Model:
    """Fit on (doc_id, text, lang); rows with a null text or lang are left out.

    Repeated rows may all be in the sample, up to its bounds; an empty table
    gives a model that knows no language; very long texts are read whole; extra
    columns are ignored.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = labelled.select("lang").filter(F.col("lang").isNotNull())  # counted without reading texts
    counts = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(total).collect()
    each = max(1, min(per_lang, total // max(len(counts), 1)))
    # about twice as many as needed by a threshold on the ticket, then the least tickets of each language
    top = labelled.sparkSession.createDataFrame([(r["lang"], float(min(1 << 30, (1 << 30) * 2 * each / r["count"] + (1 << 15)))) for r in counts], "lang string, below double")
    ticket = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 34)
    few = rows.select("text", "lang", ticket.alias("ticket")).join(top, "lang").filter(F.col("ticket") <= F.col("below"))
    least = Window.partitionBy("lang").orderBy("ticket", "text")  # cut to `each` in every task before the shuffle
    chosen = few.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= each)

    def work(batches):
        for b in batches:
            found = [(v, lang) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (v := features(t)) is not None]
            values = pa.array([v.astype("<f4").tobytes() for v, _ in found], pa.binary())
            yield pa.RecordBatch.from_arrays([values, pa.array([s for _, s in found], pa.string())], ["x", "lang"])

    got = chosen.select("text", "lang").mapInArrow(work, "x binary, lang string").collect() if counts else []
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), "<f4").reshape(-1, DIM)
    return Model(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(_row struct, lang_pred, score) of every row, from the text alone; `und` and 0 for no letter or a null text.

    Of languages with equal votes and margins, and of families with equal margins,
    the first by name is taken.  Repeated rows are predicted alike; an empty table
    gives no rows; a very long text is read whole; the other columns, of any names, are in `_row`.
    """

    def work(batches):
        for b in batches:
            found = [model.predict(features(t)) if t else (UNKNOWN, 0.0) for t in b.column("_text").to_pylist()]
            langs, scores = (list(c) for c in zip(*found)) if found else ([], [])
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["_row", "lang_pred", "score"])

    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(work, schema)


def held_out(doc_id) -> F.col:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("_row.doc_id", held_out(F.col("_row.doc_id")).alias("held_out"), "lang_pred", "score")
