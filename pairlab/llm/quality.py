"""Operator 9: quality rules by distribution divergence (DataFrame functions only).

Base rules: a minimum of words and a limit on words inside repeated 5-word
windows.  The method then compares two histograms of each document with the
reference of its language by Jensen-Shannon distance (base 2, so 0 to 1):
character classes, and common words.  A reference is the pooled histogram of
all documents of that `lang`, counted over the whole table.  Short documents
have noisy histograms, so each comparison has a minimum length below which it
does not judge.

The per-document counts are written once to the shared folder (a few dozen
numbers a row); references are partial aggregates of them, one row a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table, words_of

# Common words of the language references.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "that", "was", "is"),
    "fr": ("de", "la", "le", "et", "les", "des", "que", "un"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das"),
    "es": ("de", "la", "que", "el", "en", "los", "se", "del"),
}
WORDS = tuple(dict.fromkeys(w for ws in COMMON.values() for w in ws))
#: Character classes, taken away one after another; what stays is "other".
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", "[A-Z]+"),
    ("stop", "[.,;:!?'\"()-]+"),
    ("letter", r"\p{L}+"),
    ("digit", "[0-9]+"),
    ("symbol", "[#*$%&|<>]+"),
)
NGRAM, MIN_WORDS, MOST_REPEATED = 5, 10, 20
#: Divergence limits and the least characters and words for which they hold.
MOST_CLASS, MOST_WORDS, LEAST_CHARS, LEAST_WORDS = 0.3, 0.21, 400, 80


def _counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds the counts as columns; every stage reads a column of the stage before, so nothing is computed twice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumn("_words", words_of(F.col(text_col))).withColumn("_t0", text)
    for i, (_, pattern) in enumerate(CLASSES):
        step = step.withColumn(f"_t{i + 1}", F.regexp_replace(f"_t{i}", pattern, ""))
    classes = [(F.length(f"_t{i}") - F.length(f"_t{i + 1}")).cast("bigint") for i in range(len(CLASSES))]
    step = step.withColumn("_classes", F.array(*classes, F.length(f"_t{len(CLASSES)}").cast("bigint"))).withColumn("_n_chars", F.length("_t0").cast("bigint"))
    step = step.withColumn("_common", F.filter("_words", lambda w: w.isin(*WORDS)))
    common = [(F.size("_common") - F.size(F.array_remove("_common", w))).cast("bigint") for w in WORDS]
    step = step.withColumn("_hits", F.array(*common, (F.size("_words") - F.size("_common")).cast("bigint")))
    lines = F.filter(F.split("_t0", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    step = step.withColumn("_lines", lines)
    n = F.size("_words")
    windows = F.when(n >= NGRAM, F.transform(F.sequence(F.lit(1), n - NGRAM + 1), lambda i: F.xxhash64(F.slice("_words", i, NGRAM))))
    step = step.withColumn("_win", windows)
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    step = step.withColumn("_pairs", F.when(repeats, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    flagged = F.expr("""
        sort_array(filter(transform(_pairs, (p, j) -> CASE WHEN p.h = get(_pairs, j - 1).h OR p.h = get(_pairs, j + 1).h THEN p.i END), x -> x IS NOT NULL))
    """)
    step = step.withColumn("_at", flagged)
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-NGRAM).alias("last"))
    cover = F.aggregate("_at", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(NGRAM), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return step.withColumns({
        "_n_words": n.cast("bigint"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_n_repeat_words": F.coalesce(cover, F.lit(0).cast("bigint")),
    })


def _sum(counts: str) -> Column:
    return F.aggregate(F.col(counts), F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")


def _distance(a: str, b: str, sum_a: str, sum_b: str) -> Column:
    """Jensen-Shannon distance of two count arrays with their sums as columns; null if either is empty."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def term(x: Column, y: Column) -> Column:
        p, q = x / F.nullif(F.col(sum_a), F.lit(0.0)), y / F.nullif(F.col(sum_b), F.lit(0.0))
        return part(p, (p + q) / 2) + part(q, (p + q) / 2)

    total = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.col(sum_a) > 0) & (F.col(sum_b) > 0), F.sqrt(F.greatest(total / 2, F.lit(0.0))))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Columns of `docs` (or those of `keep`) in `_row`, then n_words … kept and the two distances, for every row.

    A null text has no words and fails the base rules.  Documents of a null
    `lang` share one reference.  Repeated rows are judged alike; an empty table
    gives no rows; very long texts are judged whole; other columns may have any
    names.
    """
    lang = F.col(lang_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("_row"), F.col(text_col).cast("string").alias("_text"), F.coalesce(lang, F.lit("")).alias("_lk"), lang.isNull().alias("_ln"))
    counted = staged(_counts(rows, "_text").select("_row", "_lk", "_ln", "_classes", "_hits", "_n_chars", "_n_words", "_n_dup_lines", "_n_repeat_words"))
    nc, nw = len(CLASSES) + 1, len(WORDS) + 1
    # a table of known size: Spark broadcasts it under its threshold, and the documents are not dealt by language
    pooled = staged(
        counted.groupBy("_lk", "_ln").agg(
            F.array(*[F.sum(F.col("_classes")[i]) for i in range(nc)]).alias("_ref_classes"),
            F.array(*[F.sum(F.col("_hits")[i]) for i in range(nw)]).alias("_ref_hits"),
        )
    )
    sums = {f"_sum{c}": _sum(c) for c in ("_classes", "_hits", "_ref_classes", "_ref_hits")}
    met = counted.join(pooled, ["_lk", "_ln"]).withColumns(sums)
    space, symbol = 1, len(CLASSES) - 1
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED * F.col("_n_words"))
    strange = ((F.col("_n_chars") >= LEAST_CHARS) & (F.col("js_class") > MOST_CLASS)) | ((F.col("_n_words") >= LEAST_WORDS) & (F.col("js_words") > MOST_WORDS))
    scored = met.withColumns({
        "js_class": _distance("_classes", "_ref_classes", "_sum_classes", "_sum_ref_classes"),
        "js_words": _distance("_hits", "_ref_hits", "_sum_hits", "_sum_ref_hits"),
    })
    return scored.select(
        "_row",
        F.col("_n_words").alias("n_words"),
        (F.col("_n_chars") - F.col("_classes")[space]).alias("word_chars"),
        F.col("_classes")[symbol].alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(strange, F.lit(False))).alias("kept"),
        "js_class",
        "js_words",
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("js_class", 6).alias("js_class"), F.round("js_words", 6).alias("js_words"))


def _sql() -> str:
    replaced = "t0"
    steps = []
    for i, (_, pattern) in enumerate(CLASSES):
        steps.append(f"c{i + 1} AS (SELECT *, regexp_replace(t{i}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS t{i + 1} FROM c{i})")
        replaced = f"t{i + 1}"
    n = len(CLASSES)
    classes = ", ".join(f"length(t{i}) - length(t{i + 1})" for i in range(n)) + f", length({replaced})"
    listed = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    pooled = lambda name, bins: "[" + ", ".join(f"sum({name}[{i + 1}])::double" for i in range(bins)) + "]"
    part = lambda p, m: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END"

    def distance(a: str, b: str) -> str:
        p, q = f"(z[1] / list_sum({a}))", f"(z[2] / list_sum({b}))"
        m = f"(({p} + {q}) / 2)"
        return f"round(CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(list_sum(list_transform(list_zip({a}, {b}), lambda z: {part(p, m)} + {part(q, m)})) / 2, 0)) END, 6)"

    return rf"""
WITH c0 AS (SELECT doc_id, lang, coalesce(text, '') AS t0, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
{", ".join(steps)},
k AS (SELECT doc_id, lang, w, lines, t0, [{classes}]::double[] AS cl,
      list_append(list_transform({listed}, lambda x: len(list_filter(w, lambda y: y = x))), len(list_filter(w, lambda y: NOT list_contains({listed}, y))))::double[] AS hits FROM c{n}),
r AS (SELECT lang, {pooled("cl", n + 1)} AS rc, {pooled("hits", len(WORDS) + 1)} AS rh FROM k GROUP BY lang),
x AS (SELECT doc_id, i, w[i:i + {NGRAM - 1}]::varchar AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {NGRAM - 2})) AS i FROM k)),
y AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {NGRAM})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT k.doc_id, len(w)::bigint AS n_words, (length(t0) - cl[2])::bigint AS word_chars, cl[{n}]::bigint AS n_symbols, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
      coalesce(y.n, 0)::bigint AS n_repeat_words, length(t0) AS n_chars, {distance("cl", "rc")} AS js_class, {distance("hits", "rh")} AS js_words
      FROM k JOIN r ON k.lang IS NOT DISTINCT FROM r.lang LEFT JOIN y ON k.doc_id = y.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((n_chars >= {LEAST_CHARS} AND js_class > {MOST_CLASS}) OR (n_words >= {LEAST_WORDS} AND js_words > {MOST_WORDS}), FALSE) AS kept, js_class, js_words
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b)
"""


OP9_SQL = _sql()
