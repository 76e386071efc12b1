"""Numeric and JSON coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def lenient_number(text: Column) -> Column:
    """a finite number, or null for null, blank, boolean text, non-numbers, NaN and infinities."""
    x = text.try_cast("double")
    return F.when(finite(x), x)


def strict_number_fault(text: Column, nonnegative: bool = False) -> Column:
    """null if the cell is a finite number (and not negative), else the reason."""
    x = text.try_cast("double")
    bad_sign = (x < 0) if nonnegative else F.lit(False)
    return (
        F.when(text.isNull() | (text == ""), "missing")
        .when(x.isNull(), "not_numeric")
        .when(~finite(x) | bad_sign, "out_of_range")
    )


def integer_fault(text: Column) -> Column:
    """Null if the cell parses as an integer, else the reason."""
    return F.when(text.isNull() | (F.trim(text) == ""), "missing").when(F.trim(text).try_cast("bigint").isNull(), "not_integer")


def json_object(text: Column) -> Column:
    """the text as variant if it is a JSON object, else null."""
    v = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), v)


def json_number(variant: Column, path: str) -> Column:
    """A finite number at a path of a variant; text and booleans give null."""
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    x = F.try_variant_get(variant, path, "double")
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.when(finite(x), x))


def round_trips(text: Column) -> Column:
    """the text is Spark's own shortest form of the double it names."""
    return F.coalesce(text.try_cast("double").cast("string") == text, F.lit(False))


def nine_digits(x: Column) -> Column:
    """nine significant digits for exports, trailing zeros cut (plain notation)."""
    digits = F.lit(8) - F.floor(F.log10(F.abs(x))).cast("int")
    rounded = F.when(x == 0, F.lit("0")).otherwise(F.format_string("%.9f", F.expr("double(0)") + _round_to(x, digits)))
    return F.regexp_replace(F.regexp_replace(rounded, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _round_to(x: Column, digits: Column) -> Column:
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    return F.round(x * scale) / scale
