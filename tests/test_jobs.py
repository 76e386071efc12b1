"""Synthetic result matrix: 2 methods × 2 views × 4 kinds, with planted failures."""

import pytest
from pyspark.sql import functions as F

from pairlab.operators import pairs
from pairlab.plans.jobs import build_protocol, screening_report

N = 100


@pytest.fixture(scope="module")
def results(spark):
    rows = spark.range(N).crossJoin(spark.createDataFrame([("m1",), ("m2",)], "method string")).crossJoin(spark.createDataFrame([("va",), ("vb",)], "dataset string"))
    rows = rows.crossJoin(spark.createDataFrame([("genuine",), ("impostor",), ("self_a",), ("self_b",)], "pair_kind string"))
    i = F.col("id").cast("double")
    score = F.when(F.col("pair_kind") == "genuine", 10 - i / 1000).when(F.col("pair_kind") == "impostor", 1 + i / 10000).otherwise(12 - i / 1000)
    failed = ((F.col("pair_kind") == "genuine") & (F.col("id") == 0)) | ((F.col("pair_kind") == "impostor") & (F.col("id") < 2))
    keep = lambda c: F.when(~failed, c)
    return rows.select(
        "method", "dataset", "pair_kind", F.concat_ws("_", "dataset", "pair_kind", F.col("id").cast("string")).alias("pair_id"),
        F.when(failed, "prepare_a_failure").otherwise("ok").alias("status"), keep(score).alias("raw_score"), F.when(failed, "synthetic").otherwise("").alias("error_code"),
        F.lit(1.0).alias("prepare_a_ms"), keep(F.lit(1.0)).alias("prepare_b_ms"), keep(F.lit(1.0)).alias("compare_ms"),
        F.lit('{"detector_point_count": 50, "representation_descriptor_count": 40, "detector_time_ms": 0.5}').alias("prepare_a_diagnostics"),
        keep(F.lit('{"detector_point_count": 60, "representation_descriptor_count": 40}')).alias("prepare_b_diagnostics"),
        keep(F.lit('{"mutual_match_count": 20, "geometric_inlier_count": 12.0, "inlier_ratio": 0.6, "geometry_failure_reason": null}')).alias("compare_diagnostics"),
    )


def test_report(results):
    report = screening_report(results, view_a="va", view_b="vb")
    for r in report["screening"].collect():
        assert r["auc"] > 0.5 and r["genuine_failure_rate"] == pytest.approx(1 / N) and r["impostor_failure_rate"] == pytest.approx(2 / N)
        assert r["operational_tar"] <= r["tar_at_far"] and r["operational_far"] <= r["actual_far"]
    groups = report["group_summary"].collect()
    assert len(groups) == 16
    g = next(r for r in groups if r["pair_kind"] == "impostor")
    assert (g["requested_rows"], g["prepare_failures"], g["failure_codes"]) == (N, 2, "synthetic:2")
    assert (g["detector_point_count_n"], g["detector_point_count_p50"], g["detector_time_ms_n"]) == (2 * (N - 2), 55.0, N - 2)
    p = report["paired"].collect()
    assert len(p) == 8 and all(r["one_sided"] == 0 and r["score_median_delta"] == 0 and r["point_count_mean_delta"] == 0 for r in p)
    assert {r["transitions"] for r in p if r["pair_kind"] == "genuine"} == {f"ok->ok:{N - 1},prepare_a_failure->prepare_a_failure:1"}


def test_missing_bundle_is_a_gap(results):
    dims = [results.select(c).distinct() for c in ("method", "dataset", "pair_kind")]
    part = results.filter("NOT (method = 'm1' AND dataset = 'vb' AND pair_kind = 'genuine')")
    assert [tuple(r) for r in pairs.matrix_gaps(dims, part).collect()] == [("m1", "vb", "genuine")]


def test_protocol_is_balanced_and_rebuilds_equally(spark):
    base = spark.range(60).crossJoin(spark.createDataFrame([("1",), ("2",)], "stratum string")).select(F.format_string("%04d", "id").alias("subject"), "stratum", (F.col("id") * 10).alias("capture"))
    shifted = base.withColumn("capture", F.col("capture") + 1)
    build = lambda a, b: build_protocol({"a": a, "b": b}, "a", "b", ["1", "2"], 8, "v", "s", "d")
    p = build(base, shifted)
    assert all(r["holds"] for r in p["checks"].collect())
    assert p["manifest"].count() == 4 * 16 and p["selected"].select("subject").distinct().count() == 16
    again = build(base.repartition(5), shifted.orderBy(F.rand(1)))
    assert sorted(map(tuple, p["digests"].collect())) == sorted(map(tuple, again["digests"].collect()))
    twice = shifted.unionByName(shifted.filter("subject = '0001'"))
    assert build(base, twice)["selected"].filter("subject = '0001'").count() == 0
