"""Whole jobs: protocol build and screening report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests, numbers, scores
from ..functions.keys import logical_key, pair_id
from ..operators import affine, aggregates, cohort, contract, matching, pairs, records, screening
from ..sources import readers

SIDES = ["capture"]


KEYS = ["subject", "stratum"]


def _manifest(a: DataFrame, b: DataFrame, selected: DataFrame, pairing: DataFrame, strata: list[str], k: int, dataset: str) -> DataFrame:
    """The four kinds of pairs of one dataset for a cohort."""
    keys = KEYS
    rank = selected.select(*keys, F.col("selection_rank").alias("pair_rank"))
    identity = lambda df, kind: df.join(rank, keys).withColumn("pair_kind", F.lit(kind))
    kinds = [
        identity(pairs.self_pairs(a, keys, SIDES), "self_a"),
        identity(pairs.self_pairs(b, keys, SIDES), "self_b"),
        identity(pairs.genuine_pairs(a, b, keys, SIDES), "genuine"),
        pairs.impostor_manifest(pairing, a, b, "stratum", SIDES).select(F.col("probe").alias("subject"), "stratum", "capture_a", "capture_b", F.col("rank_probe").alias("pair_rank"), F.lit("impostor").alias("pair_kind")),
    ]
    rows = reduce(DataFrame.unionByName, [df.select("subject", "stratum", "capture_a", "capture_b", "pair_rank", "pair_kind") for df in kinds])
    place = F.create_map(*[F.lit(x) for i, s in enumerate(strata) for x in (s, i)])[F.col("stratum")]
    return rows.select(
        F.lit(dataset).alias("dataset"), "pair_kind", (place * k + F.col("pair_rank") - 1).cast("bigint").alias("pair_ordinal"),
        pair_id(F.lit(dataset), F.col("pair_kind"), F.col("subject").cast("string"), place + 1).alias("pair_id"), "subject", "stratum", "capture_a", "capture_b",
    )


def protocol_checks(selected: DataFrame, pairing: DataFrame, manifest: DataFrame, k: int, protocol: DataFrame) -> DataFrame:
    """The cohort's, the manifests' and the metadata's invariants as flags; stored tables may be held against them as well as built ones."""
    kind = lambda n: manifest.filter(F.col("pair_kind") == n).select(*KEYS).distinct()
    return contract.flags(
        bijection=cohort.bijection_report(pairing).filter("NOT is_bijection"),
        ranks=cohort.cohort_faults(selected, k).filter("NOT ranks_exact"),
        same_identities=pairs.set_differences(kind("self_a"), kind("genuine")),
        unique_ids=records.duplicate_values(manifest, ["pair_id"]),
        self_sides=manifest.filter(F.col("pair_kind").isin("self_a", "self_b") & ~records.side_rule(F.col("capture_a"), F.col("capture_b"), same=True)),
        no_result_dependency=protocol.filter("size(method_references) + size(score_references) + size(result_references) > 0"),
    )


def dataset_preflight(base: DataFrame, stored: DataFrame, rebuilt: DataFrame, derived: DataFrame, files: DataFrame, root: str, columns: list[str]) -> DataFrame:
    """(artifact, rule, violations) of every broken rule of a dataset, in one job; no row means that it may be run.

    `base` are the rows of all base manifests (artifact, pair_id, `columns` with
    path_a and path_b), `stored` what the protocol holds of them (artifact,
    sha256, path), `rebuilt` their digests now, `derived` the rows of the derived
    manifests (artifact, pair_id, path_a, path_b), `files` the paths that exist.
    Base rows must have all cells and ids of their own, digests must hold, and a
    derived path must lie under the root, exist, and be some base row's.
    """
    keyed = base.withColumn("_id", F.struct("artifact", "pair_id"))
    rows = readers.manifest_faults(keyed, columns, "_id").select("_id.artifact", "rule")
    sums = contract.preflight_faults(stored, rebuilt, F.lit(root))
    sides = records.unpivot_sides(derived.select("artifact", "pair_id", "path_a", "path_b"), ["artifact", "pair_id"], ["path"])
    known = records.unpivot_sides(base.select("artifact", "path_a", "path_b"), ["artifact"], ["path"]).select("path").distinct().withColumn("_base", F.lit(True))
    there = files.select("path").distinct().withColumn("_file", F.lit(True))
    met = sides.join(known, "path", "left").join(there, "path", "left")
    rules = {
        "empty_path": F.col("path").isNull(), "outside_root": F.col("path").isNotNull() & ~F.coalesce(records.under_root(F.col("path"), F.lit(root)), F.lit(False)),
        "missing_file": F.col("path").isNotNull() & F.col("_file").isNull(), "not_in_base": F.col("path").isNotNull() & F.col("_base").isNull(),
    }
    paths = contract.row_faults(met, "artifact", rules)
    return rows.unionByName(sums).unionByName(paths).groupBy("artifact", "rule").agg(F.count("*").alias("violations"))


def build_joint_protocol(sources: dict[str, DataFrame], views: dict[str, tuple[str, str]], strata: list[str], k: int, version: str, seed: str) -> dict[str, DataFrame]:
    """Eligibility → selection → pairing → manifests of all datasets → digests.

    `sources` map a name to (subject, stratum, capture) tables; an identity is
    eligible if it is exactly once in each.  `views` name the sources of both
    sides of each dataset; all share one cohort and pairing.  Tables: selected,
    pairing, manifest (all datasets and kinds), digests (per dataset and kind),
    artifacts (name, sha256 of everything built), protocol (one row: digest over
    the artifacts and the parameters, and reference lists that must be empty),
    checks.
    """
    eligible = pairs.eligible(sources, KEYS)
    selected = cohort.select_cohort(eligible.select("stratum", "subject"), strata, k, version, seed)
    pairing = cohort.circular_pairs(selected)
    sides = {s: pairs.once_only(sources[s], KEYS, ["capture"]) for v in views.values() for s in v}
    manifest = reduce(DataFrame.unionByName, [_manifest(sides[a], sides[b], selected, pairing, strata, k, d) for d, (a, b) in views.items()])
    sums = digests.ordered_digest(manifest, "pair_ordinal", ["pair_id", "capture_a", "capture_b"], ["dataset", "pair_kind"])
    place = F.create_map(*[F.lit(x) for i, s in enumerate(strata) for x in (s, i)])[F.col("stratum")] * k
    cohort_sums = [
        digests.ordered_digest(df.withColumn("_o", (place + F.col(rank) - 1).cast("bigint")), "_o", [c for c in df.columns]).select(F.lit(name).alias("artifact"), F.col("digest").alias("sha256"))
        for name, df, rank in (("selected_identities", selected, "selection_rank"), ("impostor_pairing", pairing, "rank_probe"))
    ]
    artifacts = reduce(DataFrame.unionByName, [sums.select(F.concat_ws("/", "dataset", "pair_kind").alias("artifact"), F.col("digest").alias("sha256")), *cohort_sums])
    listed = digests.list_digest(artifacts, [], "artifact", "sha256")
    core = {"artifacts": F.col("digest"), "version": F.lit(version), "seed": F.lit(seed), "cohort_size": F.lit(k * len(strata))}
    none = F.array().cast("array<string>")
    protocol = listed.select(F.col("n_files").alias("n_artifacts"), digests.config_digest(core).alias("protocol_sha256"), *[none.alias(f"{x}_references") for x in ("method", "score", "result")])
    checks = protocol_checks(selected, pairing, manifest, k, protocol)
    return {"selected": selected, "pairing": pairing, "manifest": manifest, "digests": sums, "artifacts": artifacts, "protocol": protocol, "checks": checks}


def build_protocol(sources: dict[str, DataFrame], side_a: str, side_b: str, strata: list[str], k: int, version: str, seed: str, dataset: str) -> dict[str, DataFrame]:
    """X10 for one dataset."""
    return build_joint_protocol(sources, {dataset: (side_a, side_b)}, strata, k, version, seed)


# Metric → path in the diagnostics; prepare diagnostics count twice, once a side.
PREPARE_METRICS = {"detector_point_count": "$.detector_point_count", "descriptor_count": "$.representation_descriptor_count", "detector_time_ms": "$.detector_time_ms"}
COMPARE_METRICS = {
    "mutual_matches": "$.mutual_match_count", "geometric_inliers": "$.geometric_inlier_count", "inlier_ratio": "$.inlier_ratio",
    "inliers_over_minimum_keypoint_count": "$.score_components.inliers_over_min_keypoints",
}


def _number(column: str, path: str):
    return numbers.json_number(numbers.json_object(F.col(column)), path)


def group_summaries(results: DataFrame, groups: list[str]) -> DataFrame:
    """Status counts, error codes, and five-number summaries of scores, times and diagnostics per group.

    Both sides' preparation values are unpivoted, so a group is aggregated once
    for values of a row and once for values of a side.
    """
    ok = F.col("status") == "ok"
    row_metrics = {"raw_score": F.when(ok & numbers.finite(F.col("raw_score")), F.col("raw_score")), "comparison_time_ms": F.col("compare_ms")}
    row_metrics |= {n: F.when(ok, _number("compare_diagnostics", p)) for n, p in COMPARE_METRICS.items()}
    per_row = results.groupBy(*groups).agg(*aggregates.failure_counts(F.col("status"))).join(aggregates.five_numbers(results, groups, row_metrics), groups)
    sided = records.unpivot_sides(
        results.select(*groups, "status", *[F.col(f"prepare_{s}_{c}").alias(f"{c}_{s}") for s in "ab" for c in ("ms", "diagnostics")]), [*groups, "status"], ["ms", "diagnostics"]
    )
    per_side = aggregates.five_numbers(sided, groups, {"preparation_time_ms": F.col("ms")} | {n: F.when(ok, _number("diagnostics", p)) for n, p in PREPARE_METRICS.items()})
    codes = aggregates.histogram_text(results.withColumn("error_code", F.nullif("error_code", F.lit(""))), groups, "error_code", "failure_codes")
    return per_row.join(per_side, groups).join(codes, groups, "left")


def screening_report(results: DataFrame, method: str = "method", dataset: str = "dataset", kind: str = "pair_kind", view_a: str = "", view_b: str = "") -> dict[str, DataFrame]:
    """X11: group_summary, roc, screening and paired tables of result rows with a `pair_kind`.

    `genuine` and `impostor` kinds are screened; a group without a successful
    score of both is in the summary with its `reason` and has no curve; `view_a` and `view_b` are the
    dataset names compared pair by pair on the logical id.
    """
    groups = [method, dataset]
    rows = results.filter(F.col(kind).isin("genuine", "impostor")).withColumns({"_g": F.col(kind) == "genuine", "_ok": F.col("status") == "ok"})
    hist = screening.score_histogram(rows.filter("_ok"), groups, "raw_score", F.col("_g"))
    curve = screening.roc(hist, groups)
    summary = screening.screened_summary(rows, groups, "raw_score", F.col("_g"), F.col("_ok"))
    failed = lambda p: 1 - F.try_divide(F.col(f"{p}_successful"), F.col(f"{p}_requested"))
    summary = summary.withColumns({"genuine_failure_rate": failed("genuine"), "impostor_failure_rate": failed("impostor")})
    out = {"group_summary": group_summaries(results, [method, dataset, kind]), "roc": curve, "screening": summary}
    if view_a and view_b:
        out["paired"] = paired_report(results, method, dataset, kind, view_a, view_b)
    return out


METRICS = ("score", "point_count", "descriptor_count", "mutual_matches", "geometric_inliers")


def paired_report(results: DataFrame, method: str, dataset: str, kind: str, view_a: str, view_b: str) -> DataFrame:
    """Per method and kind, deltas (b − a) of score and diagnostics over pairs that succeed in both views.

    `one_sided` counts logical pairs that only one view has; it must be zero.
    """
    both = lambda p: aggregates.mean_of_available(_number("prepare_a_diagnostics", p), _number("prepare_b_diagnostics", p))
    metrics = {
        "score": F.col("raw_score"), "point_count": both("$.detector_point_count"), "descriptor_count": both("$.representation_descriptor_count"),
        "mutual_matches": _number("compare_diagnostics", "$.mutual_match_count"), "geometric_inliers": _number("compare_diagnostics", "$.geometric_inlier_count"),
    }
    base = results.select(F.col(method).alias("method"), F.col(kind).alias("pair_kind"), F.col(dataset).alias("_d"), logical_key(F.col("pair_id"), F.col(dataset)).alias("key"), "status", *[c.alias(n) for n, c in metrics.items()])
    side = lambda v, s: base.filter(F.col("_d") == v).select("method", "pair_kind", "key", *[F.col(c).alias(f"{c}_{s}") for c in ("status", *METRICS)])
    keys = ["method", "pair_kind"]
    joined = side(view_a, "a").join(side(view_b, "b"), [*keys, "key"], "full_outer")
    ok = (F.col("status_a") == "ok") & (F.col("status_b") == "ok")
    delta = lambda m: F.when(ok, F.col(f"{m}_b") - F.col(f"{m}_a"))
    one_sided = F.count_if(F.col("status_a").isNull() | F.col("status_b").isNull())
    out = joined.groupBy(*keys).agg(F.count("*").alias("logical_pairs"), one_sided.alias("one_sided"), F.count_if(ok).alias("paired_success"))
    out = out.join(aggregates.delta_summary(joined, keys, {m: delta(m) for m in METRICS}), keys)
    moves = joined.withColumn("_move", F.concat_ws("->", F.coalesce("status_a", F.lit("absent")), F.coalesce("status_b", F.lit("absent"))))
    out = out.join(aggregates.histogram_text(moves, keys, "_move", "transitions"), keys)
    return out.join(aggregates.pearson(joined.filter(ok), "score_a", "score_b", keys), keys, "left")


def score_features(a: DataFrame, b: DataFrame, pair: str, ratio: float, matching_mode: str = "mutual", score_mode: str = scores.COMPOSITE, model: str = "partial", threshold: float = 3.0) -> DataFrame:
    """K8: scores of pairs from prepared features (pair, idx, v, x, y) of both sides: match, fit, components, chosen score.

    A pair without enough matches is a valid zero with a reason (K5).
    """
    matches = matching.match(matching.both_ways(a, b, [pair]), [pair], ratio).filter(F.col("mode") == matching_mode)
    placed = (
        matches.join(a.select(pair, F.col("idx").alias("ia"), "x", "y"), [pair, "ia"])
        .join(b.select(pair, F.col("idx").alias("ib"), F.col("x").alias("u"), F.col("y").alias("v")), [pair, "ib"])
        .select(pair, F.col("ia").alias("idx"), "x", "y", "u", "v")
    )
    fits = affine.robust_affine(placed, pair, model, threshold).select(pair, "matches", "inliers", "reason")
    points = a.groupBy(pair).agg(F.count("*").alias("points_a")).join(b.groupBy(pair).agg(F.count("*").alias("points_b")), pair)
    out = points.join(fits, pair, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("matches", "inliers")})
    out = out.withColumn("reason", F.when(F.col("matches") == 0, "insufficient_geometry_matches").otherwise(F.col("reason")))
    parts = scores.score_components(F.col("inliers"), F.col("matches"), F.col("points_a"), F.col("points_b"))
    return out.withColumn("_s", scores.score_of_mode(parts, F.lit(score_mode))).select(pair, "points_a", "points_b", "matches", "inliers", "reason", F.col("_s.score").alias("raw_score"))
