"""Result contract: every rule gives rows (key, rule), none raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import is_sha256
from ..functions.jsonmaps import fields_of
from ..functions.numbers import finite, json_object
from .records import under_root
from .scoring import FAIL_A, FAIL_COMPARE, OK, STATUSES

TOLERANCE_MS = 0.001
STAGES = ("prepare_a", "prepare_b", "compare")


def _bad_time(x: Column) -> Column:
    return x.isNull() | ~F.coalesce(finite(x), F.lit(False)) | (x < 0)


def row_rules() -> dict[str, Column]:
    """V4-V6: rule id → a row breaks it, over typed columns."""
    status, score = F.col("status"), F.col("raw_score")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    ran = {"prepare_a": F.lit(True), "prepare_b": status != FAIL_A, "compare": status.isin(OK, FAIL_COMPARE)}
    rules = {
        "unknown_status": ~F.coalesce(status.isin(*STATUSES), F.lit(False)),
        "ok_without_score": (status == OK) & ~F.coalesce(finite(score), F.lit(False)),
        "ok_with_error": (status == OK) & (~blank("error_code") | ~blank("error_message")),
        "failure_with_score": (status != OK) & score.isNotNull(),
        "failure_without_error": (status != OK) & (blank("error_code") | blank("error_message")),
    }
    for s in STAGES:
        wall, own = F.col(f"{s}_ms"), F.col(f"method_{s}_ms")
        rules[f"{s}_after_failure"] = ~ran[s] & (wall.isNotNull() | own.isNotNull() | F.col(f"{s}_diagnostics").isNotNull())
        rules[f"{s}_bad_time"] = ran[s] & (_bad_time(wall) | (own.isNotNull() & _bad_time(own)))
        rules[f"{s}_bad_diagnostics"] = ran[s] & json_object(F.col(f"{s}_diagnostics")).isNull()
    parts = [F.col(f"{p}{s}_ms") for s in STAGES for p in ("", "method_")]
    total = F.col("total_ms")
    rules["bad_total"] = _bad_time(total)
    rules["total_below_part"] = total + TOLERANCE_MS < F.greatest(*parts)
    rules["total_below_sum"] = (status == OK) & (total + TOLERANCE_MS < reduce(lambda a, b: a + b, [F.col(f"{s}_ms") for s in STAGES]))
    return rules


def row_faults(results: DataFrame, key: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """(key, rule) of every broken rule; one scan, no shuffle."""
    flags = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in (rules or row_rules()).items()]
    return results.select(key, F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("rule"))


def order_faults(results: DataFrame, manifest: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, rule) for ids that repeat, are missing, are not in the manifest, or stand elsewhere."""
    m = manifest.select(F.col(ordinal).alias("_mo"), key)
    r = results.groupBy(key).agg(F.min(ordinal).alias("_ro"), F.count("*").alias("_n"))
    j = m.join(r, key, "full_outer")
    rule = F.when(F.col("_ro").isNull(), "missing_id").when(F.col("_mo").isNull(), "extra_id").when(F.col("_n") > 1, "repeated_id").when(F.col("_ro") != F.col("_mo"), "wrong_order")
    return j.select(key, rule.alias("rule")).filter("rule IS NOT NULL")


def header_faults(columns: list[str], expected: list[str]) -> list[str]:
    """V1: missing, extra and misplaced columns."""
    if columns == expected:
        return []
    faults = [f"missing:{c}" for c in expected if c not in columns] + [f"extra:{c}" for c in columns if c not in expected]
    return faults or ["column_order"]


def bundle_faults(results: DataFrame, metadata: DataFrame, key: list[str], constants: tuple[str, ...] = (), current: DataFrame | None = None) -> DataFrame:
    """(key, rule) of bundles whose metadata row does not hold.

    `metadata` has n_rows and n_ok, the run constants (versions, hashes) that
    every result row must repeat, and the columns of `current`: what holds now
    by key, such as the digest of the rows, the manifest's path, digest and
    number of rows, or the digest of a stored preflight.
    """
    varies = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"_v_{c}") for c in constants]
    shown = [F.max(c).alias(f"_c_{c}") for c in constants]
    actual = results.groupBy(*key).agg(F.count("*").alias("_rows"), F.count_if(F.col("status") == OK).alias("_ok"), *varies, *shown)
    j = metadata.join(actual, key, "full_outer")
    named = [c for c in (current.columns if current is not None else []) if c not in key]
    if current is not None:
        j = j.join(current.select(*key, *[F.col(c).alias(f"_n_{c}") for c in named]), key, "left")
    both = F.col("_rows").isNotNull() & F.col("n_rows").isNotNull()
    rules = {"no_results": F.col("_rows").isNull(), "no_metadata": F.col("n_rows").isNull(), "row_count": both & (F.col("n_rows") != F.col("_rows")), "status_count": both & (F.col("n_ok") != F.col("_ok"))}
    for c in constants:
        rules[f"{c}_varies"] = both & (F.col(f"_v_{c}") > 1)
        rules[f"{c}_differs"] = both & (F.col(f"_v_{c}") == 1) & ~F.col(f"_c_{c}").eqNullSafe(F.col(c))
    for c in named:
        rules[f"stale_{c}"] = both & ~F.col(f"_n_{c}").eqNullSafe(F.col(c))
    flags = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]
    return j.select(*key, F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("rule"))


def preflight_faults(stored: DataFrame, rebuilt: DataFrame, root: Column | None = None) -> DataFrame:
    """(artifact, rule) of a stored preflight (artifact, sha256, path) against a rebuild (artifact, sha256).

    Artifacts may be missing, additional, of another digest, without a proper
    digest, or lie outside the root.
    """
    s = stored.select("artifact", F.col("sha256").alias("_s"), F.col("path").alias("_p"), F.lit(True).alias("_in"))
    j = s.join(rebuilt.select("artifact", F.col("sha256").alias("_r"), F.lit(True).alias("_new")), "artifact", "full_outer")
    there = F.col("_in").isNotNull() & F.col("_new").isNotNull()
    rules = {
        "missing_artifact": F.col("_in").isNull(), "extra_artifact": F.col("_new").isNull(),
        "malformed_digest": F.col("_in").isNotNull() & ~is_sha256(F.col("_s")), "digest_mismatch": there & is_sha256(F.col("_s")) & (F.col("_s") != F.col("_r")),
        "outside_root": F.lit(False) if root is None else F.col("_in").isNotNull() & ~F.coalesce(under_root(F.col("_p"), root), F.lit(False)),
    }
    flags = [F.when(bad, F.lit(name)) for name, bad in rules.items()]
    return j.select("artifact", F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("rule"))


def binding_faults(requested: DataFrame, preflight: DataFrame) -> DataFrame:
    """(run, rule) of requested runs (run, artifact, sha256) that the stored preflight (artifact, sha256) does not bind."""
    p = preflight.select("artifact", F.col("sha256").alias("_p"))
    rule = F.when(F.col("_p").isNull(), "not_in_preflight").when(~F.col("_p").eqNullSafe(F.col("sha256")), "changed_after_preflight")
    return requested.join(p, "artifact", "left").select("run", rule.alias("rule")).filter("rule IS NOT NULL")


def unpivoted(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, field, value) with values as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*key, F.explode(pairs).alias("f")).select(*key, "f.*")


def drift(frozen: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Fields that differ, or that one side lacks; inputs are (key, field, value)."""
    f = frozen.select(*key, "field", F.col("value").alias("frozen"), F.lit(True).alias("_f"))
    c = current.select(*key, "field", F.col("value").alias("current"), F.lit(True).alias("_c"))
    j = f.join(c, [*key, "field"], "full_outer")
    kind = F.when(F.col("_f").isNull(), "added").when(F.col("_c").isNull(), "removed").when(~F.col("frozen").eqNullSafe(F.col("current")), "changed")
    return j.withColumn("kind", kind).filter("kind IS NOT NULL").drop("_f", "_c")


def rederived_faults(stored: DataFrame, derived: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Stored rows that differ from their re-derivation, field by field."""
    return drift(unpivoted(derived, key, columns), unpivoted(stored, key, columns), key)


def allowed_values(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key combination is not in the (small) rule table."""
    return rows.join(allowed, keys, "left_anti")


def document_faults(items: DataFrame, key: str, exact: list[str], types: dict[str, str], truths: dict[str, Column], document: str = "document") -> DataFrame:
    """(key, rule) of JSON documents: exact keys, field types (SQL names as of schema_of_variant), derived truths."""
    v = items.withColumn("_v", json_object(F.col(document))).withColumns({"_k": F.json_object_keys(document), "_m": fields_of(F.col("_v"))})
    wanted = F.array(*[F.lit(k) for k in sorted(exact)])
    rules = {"not_an_object": F.col("_v").isNull(), "keys": ~F.array_sort("_k").eqNullSafe(wanted)}
    for name, kind in types.items():
        rules[f"type:{name}"] = ~F.coalesce(F.schema_of_variant(F.col("_m")[name]).rlike(f"^{kind}"), F.lit(False))
    rules |= {f"truth:{n}": ~F.coalesce(t, F.lit(False)) for n, t in truths.items()}
    return row_faults(v, key, rules)


def flags(**checks: DataFrame) -> DataFrame:
    """One row a check: its violations and whether it holds."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("holds")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)
