"""Operator 1: line dedup over a fixed-depth log-template tree (DataFrame functions only).

A line goes down a tree of fixed depth: its token count, then its leading
tokens.  Tokens with a digit or without a letter are variable fields; the other
tokens are words.  The leaf learns its template from its distinct lines: a word
that more than half of them have at a place is constant there, every other
place is a variable field.  A line belongs to the template if most of its words
are the leaf's, so whichever fields vary, lines that differ only there meet.

Lines also recur on their own: lines made mostly of words with their variable
fields as wildcards, all others (short lines, numbers, rows of a table) by
their exact text, so that no template consists of wildcards.  Lines without a
letter or digit have no template.

A template that stands in two or more documents recurs; its first occurrence
(smallest doc_id, then line number) is kept, all later ones are dropped.

Lines are counted by partial aggregation on their hash, so a line that a third
of all documents share is one row per task before the shuffle.  Most leaves
hold one distinct line and are given up after that; tokens are read only for
lines of the others, from their first occurrence.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, TRIMMED, staged, table

LEADING = 3
#: Constant words that a template has at least: a number, a share (numerator, denominator) of the tokens, and of the words.
LEAST_WORDS, OF_TOKENS, OF_WORDS = 3, (1, 2), (3, 4)
_MASK = "<*>"
_BLOCK = 60  # line numbers of one bit mask
_FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*|(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"


def masked(line: Column) -> Column:
    """The line's tokens between single blanks, variable fields masked; most lines pass the quick tests and need no replacement."""
    blank = F.lit(" ")
    quick = [line.rlike(r"[0-9\x09-\x0D]"), line.rlike(r" [^\p{L}]"), line.rlike(r"^\P{L}"), F.endswith(line, blank)]
    even = F.regexp_replace(F.btrim(F.regexp_replace(line, _FIELD, _MASK), F.lit(TRIMMED)), SPACE + "+", " ")
    return F.when(reduce(or_, quick), even).otherwise(line)


def line_keys(lines: DataFrame, leading: int = LEADING) -> DataFrame:
    """Adds k (hash of the line's own template) and node (hash of its leaf, null for few words) to lines that have a template."""
    step = lines.filter(F.col("line").rlike(r"[\p{L}\p{N}]")).withColumn("m", masked(F.col("line")))
    blanks = F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit("")))
    fields = F.when(F.contains("m", F.lit(_MASK)), F.size(F.split("m", " ")) - F.size(F.array_remove(F.split("m", " "), _MASK))).otherwise(0)
    step = step.withColumn("n", blanks + 1).withColumn("words", F.col("n") - fields)
    wordy = (F.col("words") >= LEAST_WORDS) & (OF_TOKENS[1] * F.col("words") >= OF_TOKENS[0] * F.col("n"))
    return step.withColumn("wordy", wordy).select(
        *[c for c in lines.columns if c != "line"],
        F.when(F.col("wordy"), F.xxhash64(F.lit(1), "m")).otherwise(F.xxhash64(F.lit(0), F.btrim("line", F.lit(TRIMMED)))).alias("k"),
        F.when(F.col("wordy"), F.xxhash64("n", F.substring_index("m", " ", leading))).alias("node"),
    )


def learned_templates(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(k, node) of the lines that belong to their leaf's template, for leaves of several lines in several documents.

    `rows` are the documents as (a, d, h, text), `own` has a row per distinct
    line: k, node, the place of its first occurrence, and whether it stands in
    several documents.
    """
    doc = F.struct("first.a", "first.d", "first.u")
    several = own.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("lines"), F.max("many").alias("many"), F.min(doc).alias("lo"), F.max(doc).alias("hi"))
    leaves = several.filter("lines > 1 AND (many OR lo < hi)").select("node", "lines")
    wanted = staged(own.join(leaves, "node").select("k", "node", "lines", "first.a", "first.d", "first.h", "first.p"))
    of_doc = wanted.groupBy("a", "d", "h").agg(F.collect_list(F.struct("p", "k", "node", "lines")).alias("at"))
    found = rows.dropDuplicates(["a", "d", "h"]).join(of_doc, ["a", "d", "h"]).select(F.split("text", "\n").alias("all"), F.explode("at").alias("x"))
    words = F.split(masked(F.get("all", F.col("x.p"))), " ")
    members = staged(found.select("x.k", "x.node", "x.lines", F.transform(words, lambda w: F.when(w != _MASK, w)).alias("t")))
    seen = members.select("node", "lines", F.posexplode("t").alias("p", "w")).filter("w IS NOT NULL").groupBy("node", "p", "w").agg(F.count("*").alias("c"), F.first("lines").alias("lines"))
    constant = seen.filter(2 * F.col("c") > F.col("lines")).groupBy("node").agg(F.collect_list(F.struct("p", "w")).alias("words"))
    met = members.join(constant, "node").withColumn("c", F.expr("size(filter(words, s -> get(t, s.p) = s.w))"))
    enough = (F.col("c") >= LEAST_WORDS) & (OF_TOKENS[1] * F.col("c") >= OF_TOKENS[0] * F.size("t")) & (OF_WORDS[1] * F.col("c") >= OF_WORDS[0] * F.size(F.array_compact("t")))
    return met.filter(enough).select("k", "node")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` with recurring lines taken out of the text, plus _n_lines and _n_dropped.

    Rows that share a doc_id count as one document (their lines never recur
    because of each other), but lines are dropped from the row they stand in.
    A row without a doc_id is a document of its own, before all others, unless
    its text equals another such row's.  A null text stays null and has no
    lines; a text whose lines all go becomes empty; a very long text is one row
    per line while it is parsed.  An empty table gives no rows; repeated rows
    stay.  Other columns may have any names.
    """
    named = F.col(id_col).isNotNull()
    place = (named.alias("a"), F.coalesce(F.col(id_col), F.lit(0)).cast("bigint").alias("d"), F.xxhash64(text_col).alias("h"))
    texts = docs.select(*place, F.col(text_col).alias("text"))
    lines = texts.select("a", "d", "h", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    keyed = staged(line_keys(lines))
    unnamed = F.when(~F.col("a"), F.col("h"))  # tells documents without an id apart
    at = F.struct("a", "d", "p", unnamed.alias("u"), "h")
    doc = F.xxhash64("a", "d", unnamed)
    own = keyed.groupBy("k").agg(F.min(at).alias("first"), F.first("node").alias("node"), F.min(doc).alias("lo"), F.max(doc).alias("hi"))
    own = staged(own.select("k", "first", "node", (F.col("lo") != F.col("hi")).alias("many")))
    learned = staged(learned_templates(texts, own))
    who = F.struct("first.a", "first.d", "first.u")
    leaf = own.drop("node").join(learned, "k").groupBy("node").agg(F.min("first").alias("first"), F.max("many").alias("many"), F.min(who).alias("lo"), F.max(who).alias("hi"))
    recurring = own.filter("many").select("k", "first").union(leaf.filter("many OR lo < hi").select("node", "first").join(learned, "node").select("k", "first"))
    same = (F.col("a") == F.col("first.a")) & (F.col("d") == F.col("first.d")) & (F.col("p") == F.col("first.p")) & unnamed.eqNullSafe(F.col("first.u"))
    dropped = keyed.drop("node").join(recurring, "k").filter(~same)
    masks = (
        dropped.groupBy("a", "d", "h", F.floor(F.col("p") / _BLOCK).cast("int").alias("b"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, p % {_BLOCK})")).alias("m"))
        .groupBy(F.col("a").alias("_ld_a"), F.col("d").alias("_ld_d"), F.col("h").alias("_ld_h"))
        .agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("_ld_masks"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_ld_row"), *[c.alias(n) for c, n in zip(place, ("_ld_a", "_ld_d", "_ld_h"))])
    joined = rows.join(masks, ["_ld_a", "_ld_d", "_ld_h"], "left")
    text = F.col(f"_ld_row.`{text_col}`")
    stay = F.expr(f"filter(split(_ld_row.`{text_col}`, '\\n'), (x, i) -> (coalesce(_ld_masks[cast(floor(i / {_BLOCK}) as int)], 0L) & shiftleft(1L, i % {_BLOCK})) = 0)")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    out = joined.select("_ld_row", n_lines.alias("_n_lines"), F.when(F.col("_ld_masks").isNotNull(), stay).alias("_ld_kept"))
    new = F.when(F.col("_ld_kept").isNull(), text).otherwise(F.array_join("_ld_kept", "\n"))
    columns = [new.alias(c) if c == text_col else F.col(f"_ld_row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns, "_n_lines", F.when(F.col("_ld_kept").isNull(), 0).otherwise(F.col("_n_lines") - F.size("_ld_kept")).cast("bigint").alias("_n_dropped"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS p, unnest(string_split(text, chr(10))) AS line FROM documents
), tokens AS (
  SELECT doc_id, p, line, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR NOT regexp_matches(x, '\p{L}') THEN '<*>' ELSE x END) AS w
  FROM lines WHERE regexp_matches(line, '[\p{L}\p{N}]')
), counted AS (
  SELECT *, len(w) AS n, len(list_filter(w, lambda x: x <> '<*>')) AS words FROM tokens
), keyed AS (
  SELECT doc_id, p, w, n, words, words >= 3 AND 2 * words >= n AS wordy,
         CASE WHEN words >= 3 AND 2 * words >= n THEN '1' || w::varchar ELSE '0' || trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS k FROM counted
), own AS (
  SELECT k, any_value(wordy) AS wordy, any_value(w) AS w, any_value(n) AS n, any_value(words) AS words, min({'d': doc_id, 'p': p}) AS first, min(doc_id) AS lo, max(doc_id) AS hi FROM keyed GROUP BY k
), leaves AS (
  SELECT n, w[1:3] AS l, count(*) AS lines FROM own WHERE wordy GROUP BY n, w[1:3] HAVING count(*) > 1 AND min(lo) < max(hi)
), members AS (
  SELECT k, o.n, leaves.l, lines, w, words, first, lo, hi FROM own o JOIN leaves ON o.wordy AND o.n = leaves.n AND o.w[1:3] = leaves.l
), places AS (
  SELECT k, n, l, lines, unnest(range(1, n + 1)) AS p, unnest(w) AS x FROM members
), constant AS (
  SELECT n, l, p, x FROM places WHERE x <> '<*>' GROUP BY n, l, p, x HAVING 2 * count(*) > any_value(lines)
), met AS (
  SELECT k, count(*) AS c FROM places JOIN constant USING (n, l, p, x) GROUP BY k
), learned AS (
  SELECT m.k, n, l, first, lo, hi FROM members m JOIN met USING (k) WHERE c >= 3 AND 2 * c >= n AND 4 * c >= 3 * words
), templates AS (
  SELECT k, first FROM own WHERE lo < hi
  UNION ALL SELECT k, f FROM learned JOIN (SELECT n, l, min(first) AS f FROM learned GROUP BY n, l HAVING min(lo) < max(hi)) USING (n, l)
), dropped AS (
  SELECT DISTINCT doc_id, keyed.p FROM keyed JOIN templates USING (k) WHERE doc_id <> first.d OR keyed.p <> first.p
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM lines ANTI JOIN dropped USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(len(string_split(d.text, chr(10))), 0)::bigint AS n_lines, coalesce(x.n, 0)::bigint AS n_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM dropped GROUP BY doc_id) x USING (doc_id)
"""
