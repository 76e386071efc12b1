"""Keys and names: anchored regex groups, padded ids, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex_groups(text: Column, pattern: str, names: list[str]) -> list[Column]:
    """Groups of a full match, null where the whole text does not match."""
    anchored = f"^(?:{pattern})$"
    hit = text.rlike(anchored)
    return [F.when(hit, F.regexp_extract(text, anchored, i + 1)).alias(n) for i, n in enumerate(names)]


def pair_id(dataset: Column, protocol: Column, subject: Column, slot: Column) -> Column:
    """`{dataset}_{protocol}_{subject}_{slot:02d}`."""
    return F.format_string("%s_%s_%s_%02d", dataset, protocol, subject, slot)


def logical_key(pair: Column, dataset: Column) -> Column:
    """The pair id without its dataset prefix; null (a refusal) where the prefix is absent."""
    prefix = F.concat(dataset, F.lit("_"))
    return F.when(F.startswith(pair, prefix), F.substr(pair, F.length(prefix) + 1))


def pair_kind(protocol: Column, kinds: dict[str, str]) -> Column:
    """Pair kind of a protocol name by its suffix; null for an unknown one."""
    out = F.lit(None).cast("string")
    for suffix, kind in kinds.items():
        out = F.when(F.endswith(protocol, F.lit(suffix)), kind).otherwise(out)
    return out


def zero_padded(number: Column, width: int) -> Column:
    """F2."""
    return F.lpad(number.cast("string"), width, "0")


def alias_of(value: Column, aliases: dict[str, str]) -> Column:
    """canonical name of an enum alias, case and blanks ignored; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return table[F.lower(F.trim(value))]
