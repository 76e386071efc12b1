"""JSON documents as maps of typed values (P18, O6); documents as rows of leaves are in `operators.documents`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that differ between equal runs.
VOLATILE_SUFFIX, VOLATILE_KEYS = "_ms", ("timestamp", "created_at_utc", "temporary_path", "pid", "process_id")


def fields_of(v: Column) -> Column:
    """The fields of a variant object as map<string, variant>; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def is_stable(name: Column, suffix: str = VOLATILE_SUFFIX, keys: tuple[str, ...] = VOLATILE_KEYS) -> Column:
    """Whether a field of that exact name is the same in equal runs."""
    return ~F.endswith(name, F.lit(suffix)) & ~name.isin(*keys)


def stable_map(text: Column, suffix: str = VOLATILE_SUFFIX, keys: tuple[str, ...] = VOLATILE_KEYS) -> Column:
    """The top-level fields without volatile ones, values as variants: types, digits and nesting stay."""
    return F.map_filter(fields_of(F.try_parse_json(text)), lambda k, v: is_stable(k, suffix, keys))


def sorted_json(m: Column) -> Column:
    """A map as JSON text with sorted keys, at every depth of variant values; null values are kept."""
    keys = F.array_sort(F.map_keys(m))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: m[k])), {"ignoreNullFields": "false"})
