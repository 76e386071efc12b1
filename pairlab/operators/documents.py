"""JSON documents as rows of typed leaves.

A document is parsed to a variant, which keeps the types and all digits of its
values, and walked one level at a time: every level is an explode of the
containers' children, leaves pass through, and no level shuffles.  As many
levels are planned as the deepest document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonmaps import VOLATILE_KEYS, VOLATILE_SUFFIX, fields_of, is_stable
from ..sources.publish import staged

#: A step of a path: a name, or a place in an array.
_STEP = "struct<name:string,at:int>"


def brackets_of(text: Column) -> Column:
    """The brackets of a JSON text outside of strings."""
    return F.regexp_replace(text, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++', "")


def nesting(brackets: Column) -> Column:
    """How deep brackets nest."""
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def _scalar(v: Column) -> Column:
    """JSON text of a leaf; a whole number in exponent form is written like any other."""
    d = F.try_variant_get(v, "$", "double")
    whole = (F.schema_of_variant(v) == "DOUBLE") & (F.abs(d) < 9e15) & (d == F.floor(d))
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(F.to_json(v))


def leaves(df: DataFrame, key: list[str], document: str, suffix: str = VOLATILE_SUFFIX, keys: tuple[str, ...] = VOLATILE_KEYS, levels: int | None = None) -> DataFrame:
    """(key, path, value): every scalar and every empty container of a document, at any depth, without volatile fields.

    path is an array of steps, value the leaf's JSON text: `1`, `"1"`, `true`
    and `"true"` are four values, and integers keep all their digits (38 at
    most).  An object left without fields is `{}`.  A null or blank document is
    `{}`; a text that is no JSON is one leaf, its own text after `malformed:`.
    """
    df = df.select(*key, F.col(document).cast("string").alias("_x"))
    df = df.select(*key, F.when(F.coalesce(F.trim("_x"), F.lit("")) == "", "{}").otherwise(F.col("_x")).alias("_x"))
    if levels is None:  # read twice
        df = staged(df)
    given = F.col("_x")
    if levels is None:
        shapes = df.select(brackets_of(given).alias("b")).distinct()  # far fewer than documents
        levels = shapes.agg(F.max(nesting(F.col("b"))).alias("n")).first()["n"] or 0
    none = F.array().cast(f"array<{_STEP}>")
    rows = df.select(*key, F.struct(none.alias("path"), F.try_parse_json(given).alias("v"), F.lit(False).alias("bare"), F.lit(False).alias("done"), given.alias("t")).alias("_n"))
    null = lambda kind: F.lit(None).cast(kind)
    for _ in range(levels):
        # one step a select: what is used twice is computed once
        child = lambda name, at, x: F.struct(F.concat(F.col("_n.path"), F.array(F.struct(name.alias("name"), at.alias("at")))).alias("path"), x.alias("v"), F.lit(False).alias("bare"), F.lit(False).alias("done"), null("string").alias("t"))
        opened = rows.select(*key, "_n", F.when(~F.col("_n.done"), fields_of(F.col("_n.v"))).alias("_m"))
        listed = opened.select(*key, "_n", F.map_filter("_m", lambda k, v: is_stable(k, suffix, keys)).alias("_m"), F.when(F.col("_m").isNull() & ~F.col("_n.done"), F.try_variant_get("_n.v", "$", "array<variant>")).alias("_a"))
        fields = F.transform(F.map_entries("_m"), lambda e: child(e["key"], null("int"), e["value"]))
        items = F.transform("_a", lambda x, i: child(null("string"), i, x))
        kids = listed.select(*key, "_n", F.coalesce(F.size("_m") == 0, F.lit(False)).alias("_bare"), F.coalesce(fields, items).alias("_k"))
        self = F.struct(F.col("_n.path").alias("path"), F.col("_n.v").alias("v"), (F.col("_n.bare") | F.col("_bare")).alias("bare"), F.lit(True).alias("done"), F.col("_n.t").alias("t"))
        rows = kids.select(*key, F.explode(F.when(F.size("_k") > 0, F.col("_k")).otherwise(F.array(self))).alias("_n"))
    value = F.when(F.col("_n.v").isNull(), F.concat(F.lit("malformed:"), F.col("_n.t"))).when(F.col("_n.bare"), "{}").otherwise(_scalar(F.col("_n.v")))
    return rows.select(*key, F.col("_n.path").alias("path"), value.alias("value"))


def path_text(path: Column) -> Column:
    """A path as text: plain names after dots, places and all other names in brackets, so different paths differ."""
    plain = lambda s: s["name"].rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    quoted = lambda s: F.concat(F.lit("["), F.substring(F.to_json(F.array(s["name"])), 2, 1 << 30))
    step = lambda s: F.when(s["name"].isNull(), F.concat(F.lit("["), s["at"].cast("string"), F.lit("]"))).when(plain(s), F.concat(F.lit("."), s["name"])).otherwise(quoted(s))
    return F.regexp_replace(F.array_join(F.transform(path, step), ""), r"^\.", "")


def document_diff(expected: DataFrame, actual: DataFrame, key: list[str], document: str, columns: list[str] = ()) -> DataFrame:
    """(key, field, expected, actual): rows of one side alone (field `row`), differing columns, and differing leaves of the JSON documents.

    Values of leaves are JSON texts and so differ by type too; numbers are equal
    if they are the same number.  Both sides are exploded and meet in one shuffle
    on the key.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        plain = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]) if columns else F.array().cast("array<struct<field:string,value:string>>")
        cells = df.select(*key, F.explode_outer(plain).alias("_c"))
        found = leaves(df, key, document).select(*key, F.struct(F.concat(F.lit("\0"), path_text(F.col("path"))).alias("field"), "value").alias("_c"))
        return cells.unionByName(found).withColumn("_s", F.lit(name))

    of = lambda n: F.collect_list(F.when(F.col("_s") == n, F.col("_c"))).alias(n)
    met = side(expected, "e").unionByName(side(actual, "a")).groupBy(*key).agg(of("e"), of("a"), F.bool_or(F.col("_s") == "e").alias("_in_e"), F.bool_or(F.col("_s") == "a").alias("_in_a"))
    there = lambda c: F.when(F.col(c), "present").otherwise("absent")
    cell = lambda field, e, a: F.struct(field.alias("field"), e.alias("expected"), a.alias("actual"))
    more, less = F.array_except("e", "a"), F.array_except("a", "e")
    value = lambda cells, f: F.get(F.filter(cells, lambda c: c["field"] == f), F.lit(0))["value"]
    names = F.array_union(F.transform(more, lambda c: c["field"]), F.transform(less, lambda c: c["field"]))
    differing = F.transform(names, lambda f: cell(F.ltrim(f, F.lit("\0")), value(F.col("_more"), f), value(F.col("_less"), f)))
    rows = F.array(cell(F.lit("row"), there("_in_e"), there("_in_a")))
    unequal = met.withColumns({"_more": more, "_less": less}).filter(~F.col("_in_e") | ~F.col("_in_a") | (F.size("_more") > 0) | (F.size("_less") > 0))
    found = F.when(F.col("_in_e") & F.col("_in_a"), differing).otherwise(rows)
    return unequal.select(*key, F.explode(found).alias("d")).select(*key, "d.*")
