"""Closed forms, one defect → one rule, and independence of the input's order."""

import random

import pytest
from pyspark.sql import functions as F

from pairlab.operators import affine, aggregates, cohort, contract, documents, matching, orientation, pairs, parity, records, sampling, scoring, screening, selection

from pairlab.sources import publish, reconcile

from .helpers import rows_of


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_affine_with_one_outlier(spark):
    a = [(0, 0), (10, 0), (0, 10), (10, 10), (40, 40)]
    b = [(5, 7), (15, 7), (5, 17), (15, 17), (5, 50)]
    rows = [(1, i, float(x), float(y), float(u), float(v)) for i, ((x, y), (u, v)) in enumerate(zip(a, b))] + [(2, 0, 0.0, 0.0, 1.0, 1.0), (2, 1, 1.0, 1.0, 2.0, 2.0)] + [(3, i, 1.0, 1.0, 2.0, 2.0) for i in range(4)]
    for model in ("partial", "full"):
        got = {r["pair"]: r for r in affine.robust_affine(frame(spark, rows, "pair int, idx int, x double, y double, u double, v double"), model=model).collect()}
        r = got[1]
        assert (r["inliers"], r["outliers"], r["inlier_ratio"]) == (4, 1, 0.8) and r["residual_max"] < 1e-4 and r["scale"] == pytest.approx(1)
        assert got[2]["inliers"] == 0 and got[2]["outliers"] == 2 and got[2]["reason"] == "insufficient_geometry_matches"
        assert got[3]["reason"] == "model_estimation_failure" and got[3]["inliers"] == 0


def test_mutual_matches(spark):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(5)]
    a = frame(spark, [(1, i, unit(k)) for i, k in enumerate((0, 1, 2))], "g int, idx int, v array<double>")
    b = frame(spark, [(1, i, unit(k)) for i, k in enumerate((0, 1, 3, 4))], "g int, idx int, v array<double>")
    d = matching.both_ways(a, b, ["g"])
    m = matching.match(d, ["g"], 0.75)
    assert rows_of(m.filter("mode = 'mutual'"), ["ia", "ib"]) == [(0, 0), (1, 1)]
    c = matching.match_counts(d, m, ["g"], 0.75).first()
    assert (c["knn_a_to_b"], c["knn_b_to_a"], c["mutual"]) == (3, 4, 2)


def test_lone_neighbour_fails_the_ratio_test(spark):
    a = frame(spark, [(1, 0, [0.0])], "g int, idx int, v array<double>")
    assert matching.ratio_kept(matching.two_nearest(a, a, ["g"]), 0.9).count() == 0


def test_curve_against_brute_force(spark):
    random.seed(3)
    rows = [(g, float(random.randint(0, 12)), random.random() < 0.4) for g in "xy" for _ in range(120)]
    df = frame(spark, rows, "grp string, s double, genuine boolean")
    hist = screening.score_histogram(df, ["grp"], "s", F.col("genuine"))
    auc = {r["grp"]: r["auc"] for r in screening.auc(hist, ["grp"]).collect()}
    points = {r["grp"]: r for r in screening.operating_points(screening.roc(hist, ["grp"]), ["grp"]).collect()}
    other = screening.score_histogram(df, ["grp"], "s", F.col("genuine"))
    prefix = {(r["grp"], r["score"]): (r["g_sum"], r["i_sum"]) for r in screening.range_prefix(other, ["grp"], 3).collect()}
    for g in "xy":
        gen = [s for k, s, t in rows if k == g and t]
        imp = [s for k, s, t in rows if k == g and not t]
        assert auc[g] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in gen for b in imp) / len(gen) / len(imp))
        ts = sorted(set(gen + imp), reverse=True)
        curve = [(t, sum(s >= t for s in imp) / len(imp), sum(s >= t for s in gen) / len(gen)) for t in ts]
        top = (max(ts) + 1, 0.0, 0.0)
        e = min([top, *curve], key=lambda p: abs(p[1] - (1 - p[2])))
        assert points[g]["eer"] == pytest.approx((e[1] + 1 - e[2]) / 2)
        best = max((p for p in [top, *curve] if p[1] <= 0.01), key=lambda p: (p[2], p[1], -p[0]))
        assert points[g]["tar_at_far"] == pytest.approx(best[2]) and points[g]["actual_far"] == pytest.approx(best[1])
        for t in ts:
            assert prefix[g, t] == (sum(s >= t for s in gen), sum(s >= t for s in imp))


def test_failed_rows_count_against_the_operator(spark):
    df = frame(spark, [("a", 5.0, True, True), ("a", None, True, False), ("a", 1.0, False, True)], "g string, s double, genuine boolean, ok boolean")
    points = frame(spark, [("a", 2.0)], "g string, far_threshold double")
    r = screening.operational(df, points, ["g"], "s", F.col("genuine"), F.col("ok")).first()
    assert (r["operational_tar"], r["operational_far"]) == (0.5, 0.0)


def test_cohort_is_greedy_and_order_free(spark):
    random.seed(1)
    rows = [(s, f"{p:04d}") for s in "ABC" for p in range(40) if random.random() < 0.8]
    df = frame(spark, rows, "stratum string, subject string")
    got = cohort.select_cohort(df, ["A", "B", "C"], 8, "v", "s")
    assert rows_of(got) == rows_of(cohort.select_cohort(df.repartition(5).orderBy(F.rand(2)), ["A", "B", "C"], 8, "v", "s"))
    import hashlib

    used, expected = set(), []
    for s in "ABC":
        c = sorted((hashlib.sha256("\n".join(("v", "s", s, p)).encode()).hexdigest(), p) for k, p in rows if k == s and p not in used)[:8]
        used |= {p for _, p in c}
        expected += [(s, p, i + 1) for i, (_, p) in enumerate(c)]
    assert sorted((r["stratum"], r["subject"], r["selection_rank"]) for r in got.collect()) == sorted(expected)
    pairing = cohort.circular_pairs(got)
    assert all(r["is_bijection"] for r in cohort.bijection_report(pairing).collect())
    broken = pairing.withColumn("candidate", F.when(F.col("rank_probe") == 1, F.col("probe")).otherwise(F.col("candidate")))
    assert not any(r["is_bijection"] for r in cohort.bijection_report(broken).collect())
    assert all(r["ranks_exact"] for r in cohort.cohort_faults(got, 8).collect()) and not any(r["ranks_exact"] for r in cohort.cohort_faults(got, 9).collect())


def test_records(spark):
    df = frame(spark, [(1, "x", 5), (2, "y", None), (3, "x", -1)], "id int, k string, v int")
    bad = records.with_failure(df, [(F.col("k") == "x", "side"), (F.col("v") >= 0, "value")])
    assert [r["error_message"] for r in bad.orderBy("id").collect()] == [None, "side", "value"]
    slots = frame(spark, [("x", 1), ("y", None)], "k string, slot int")
    got = {r["id"]: (r["is_valid"], r["is_single"], r["is_multi"]) for r in records.slotted(df, slots, ["k"]).collect()}
    assert got == {1: (True, True, False), 2: (True, False, True), 3: (True, True, False)}
    paths = frame(spark, [("/r/a/b",), ("/r/../x",), ("/ra/b",), ("\\r\\a",)], "p string")
    assert [r[0] for r in paths.select(records.under_root(F.col("p"), F.lit("/r"))).collect()] == [True, False, False, True]
    assert rows_of(records.constant_violations(df, {"k": "x"}, "id"), ["id", "field"]) == [(2, "k")]
    assert rows_of(records.pairable(records.slotted(df, slots, ["k"]), F.lit(True)), ["id"]) == [(1,), (3,)]
    assert records.duplicate_values(df, ["k"]).first()["n_rows"] == 2
    dup = records.duplicate_keys(df, ["k"], "id").first()
    assert (dup["k"], dup["n_rows"], dup["samples"]) == ("x", 2, "1,3")


def test_pair_reconciliation(spark):
    a = frame(spark, [(1,), (2,)], "k int")
    b = frame(spark, [(2,), (3,)], "k int")
    assert rows_of(pairs.reconcile(a, b, ["k"]), ["k", "presence"]) == [(1, "a_only"), (2, "both"), (3, "b_only")]
    assert rows_of(pairs.set_differences(a, b), ["k", "side"]) == [(1, "a"), (3, "b")]
    s = frame(spark, [(i, i * 10, i * 10 + 1) for i in range(5)], "k int, c_a int, c_b int")
    m = frame(spark, [(0, 0, 1), (1, 11, 10), (2, 99, 21), (3, 30, 99), (7, 1, 1)], "k int, c_a int, c_b int")
    got = {r["k"]: r["verdict"] for r in pairs.consistency(m, s, ["k"], ["c"]).collect()}
    assert got == {0: "consistent", 1: "swapped", 2: "a_mismatch", 3: "b_mismatch", 4: "missing", 7: "extra"}
    ordered = s.select(F.col("k").alias("o"), F.col("k").cast("string").alias("id"))
    assert pairs.in_order(ordered, ordered, "o", "id").count() == 0
    assert pairs.in_order(ordered.filter("o > 0"), ordered, "o", "id").count() == 1


GOOD = dict(pair_id=1, status="ok", raw_score=1.0, error_code=None, error_message=None, prepare_a_ms=1.0, prepare_b_ms=1.0, compare_ms=1.0, method_prepare_a_ms=None, method_prepare_b_ms=None, method_compare_ms=None, total_ms=3.0, prepare_a_diagnostics="{}", prepare_b_diagnostics="{}", compare_diagnostics="{}")
FAILED = GOOD | dict(status="prepare_a_failure", raw_score=None, error_code="e", error_message="m", prepare_b_ms=None, compare_ms=None, prepare_b_diagnostics=None, compare_diagnostics=None)
TYPES = "pair_id int, status string, raw_score double, error_code string, error_message string, prepare_a_ms double, prepare_b_ms double, compare_ms double, method_prepare_a_ms double, method_prepare_b_ms double, method_compare_ms double, total_ms double, prepare_a_diagnostics string, prepare_b_diagnostics string, compare_diagnostics string"
DEFECTS = [
    (GOOD, dict(status="odd"), {"unknown_status", "failure_with_score", "failure_without_error", "compare_after_failure"}),
    (GOOD, dict(raw_score=float("nan")), {"ok_without_score"}),
    (GOOD, dict(error_code="x"), {"ok_with_error"}),
    (GOOD, dict(prepare_a_ms=-1.0), {"prepare_a_bad_time"}),
    (GOOD, dict(prepare_b_ms=None), {"prepare_b_bad_time"}),
    (GOOD, dict(compare_diagnostics="[1]"), {"compare_bad_diagnostics"}),
    (GOOD, dict(total_ms=2.5), {"total_below_sum"}),
    (GOOD, dict(total_ms=float("inf")), {"bad_total"}),
    (GOOD, dict(method_compare_ms=3.5), {"total_below_part"}),
    (FAILED, dict(raw_score=1.0), {"failure_with_score"}),
    (FAILED, dict(error_message=" "), {"failure_without_error"}),
    (FAILED, dict(compare_ms=1.0), {"compare_after_failure"}),
    (FAILED, dict(), set()),
    (GOOD, dict(), set()),
]


def test_contract_rules_fire_once(spark):
    df = frame(spark, [tuple((base | change | {"pair_id": i}).values()) for i, (base, change, _) in enumerate(DEFECTS)], TYPES)
    got = {i: set() for i in range(len(DEFECTS))}
    for r in contract.row_faults(df, "pair_id").collect():
        got[r["pair_id"]].add(r["rule"])
    assert got == {i: rules for i, (_, _, rules) in enumerate(DEFECTS)}


def test_order_bundle_header_and_documents(spark):
    m = frame(spark, [(0, "a"), (1, "b"), (2, "c")], "o int, id string")
    r = frame(spark, [(0, "a"), (1, "c"), (2, "c"), (3, "z")], "o int, id string")
    assert dict(rows_of(contract.order_faults(r, m, "id", "o"), ["id", "rule"])) == {"b": "missing_id", "c": "repeated_id", "z": "extra_id"}
    assert contract.header_faults(["a", "b"], ["b", "a"]) == ["column_order"] and contract.header_faults(["a"], ["a"]) == [] and contract.header_faults(["x"], ["a"]) == ["missing:a", "extra:x"]
    res = frame(spark, [("k", "ok"), ("k", "comparison_failure")], "b string, status string")
    meta = frame(spark, [("k", 2, 2), ("j", 1, 1)], "b string, n_rows int, n_ok int")
    assert dict(rows_of(contract.bundle_faults(res, meta, ["b"]), ["b", "rule"])) == {"k": "status_count", "j": "no_results"}
    docs = frame(spark, [(1, '{"a": 1, "b": "x"}'), (2, '{"a": 1}'), (3, '{"a": "1", "b": "x"}'), (4, "[]")], "id int, document string")
    faults = contract.document_faults(docs, "id", ["a", "b"], {"a": "BIGINT"}, {"a_is_one": F.get_json_object("document", "$.a") == "1"})
    got = rows_of(faults, ["id", "rule"])
    assert (2, "keys") in got and (3, "type:a") in got and (4, "not_an_object") in got and not any(i == 1 for i, _ in got)
    checks = {r["check"]: r["holds"] for r in contract.flags(fine=docs.limit(0), bad=docs).collect()}
    assert checks == {"fine": True, "bad": False}
    allowed = frame(spark, [(1,), (2,)], "id int")
    assert rows_of(contract.allowed_values(docs, allowed, ["id"]), ["id"]) == [(3,), (4,)]


def test_scoring_stages(spark):
    captures = frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0])], "capture int, vector array<double>")
    p = frame(spark, [(1, 2), (3, 1), (1, 3), (1, 9)], "capture_a int, capture_b int")
    got = {(r["capture_a"], r["capture_b"]): (r["status"], r["raw_score"], r["error_code"]) for r in scoring.run_pairs(p, captures, scoring.DotProduct(2)).collect()}
    assert got == {(1, 2): ("ok", 1.0, None), (3, 1): ("prepare_a_failure", None, "wrong_length"), (1, 3): ("prepare_b_failure", None, "wrong_length"), (1, 9): ("prepare_b_failure", None, "missing_capture")}
    stored = scoring.DotProduct(2).prepare(captures).withColumns({"method": F.lit("dot"), "version": F.lit("0"), "format": F.lit("vector")})
    assert {r["error"] for r in scoring.authorised(stored, scoring.DotProduct(2)).collect()} == {"payload_not_authorised"}
    assert scoring.run_matrix([frame(spark, [(1,), (2,)], "a int"), frame(spark, [("x",), ("y",)], "b string")], F.col("a") == 1).count() == 2


def test_result_rows_hold_their_contract(spark):
    """Every outcome, with and without reports: no row rule is broken, and what did not run leaves nothing."""
    captures = frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 1.0])], "capture int, vector array<double>")
    p = frame(spark, [(1, 1, 2), (2, 3, 1), (3, 1, 3), (4, 1, 9), (5, 9, 1), (6, 4, 1), (7, 5, 1), (8, 2, 1)], "pair_id int, capture_a int, capture_b int")
    a = F.col("capture_a")
    plain = scoring.DotProduct(2)
    told = scoring.Telling(plain, F.when(a == 5, "refused"))
    for method in (plain, told, scoring.Timed(told, F.when(F.col("capture") == 2, -1.0).otherwise(0.25), F.lit(float("nan"))), scoring.Timed(plain, F.lit(0.5), F.lit(None))):
        rows = scoring.run_pairs(p, captures, method)
        assert contract.row_faults(rows, "pair_id").collect() == []
        got = {r["pair_id"]: r for r in rows.collect()}
        assert got[2]["prepare_b_ms"] is None and got[2]["compare_diagnostics"] is None and got[2]["error_message"]
        assert got[5]["error_code"] == "missing_capture" and got[5]["prepare_a_diagnostics"] == "{}" or got[5]["status"] == "prepare_a_failure"
    timed = {r["pair_id"]: r for r in scoring.run_pairs(p, captures, scoring.Timed(told, F.when(F.col("capture") == 2, -1.0).otherwise(0.25), F.lit(3.0))).collect()}
    assert (timed[8]["status"], timed[8]["error_code"], timed[8]["method_prepare_a_ms"], timed[8]["total_ms"]) == ("prepare_a_failure", "invalid_method_timing", None, 0.0)
    assert (timed[7]["status"], timed[7]["error_message"], timed[7]["total_ms"], timed[7]["compare_diagnostics"]) == ("comparison_failure", "method said: refused", 3.5, '{"length":2}')


@pytest.mark.parametrize("few", [1, 30])
def test_pivots_find_the_two_nearest(spark, few):
    """Clusters, ties, repeated points, tiny and empty sets: the same rows as comparing all, in any group."""
    r = random.Random(few)
    def points(g, n, side):  # noqa: E306
        centres = [[r.uniform(0, 50) for _ in range(3)] for _ in range(6)]
        kinds = {0: lambda: [r.gauss(c, 0.5) for c in r.choice(centres)], 1: lambda: [float(r.randint(0, 2)) for _ in range(3)], 2: lambda: [1.0, 2.0, 3.0]}
        return [(g, i * 2 + side, kinds[g % 3]()) for i in range(n)]
    sizes = [(150, 200), (120, 90), (60, 70), (5, 1), (3, 0), (0, 4), (40, 2)]
    a = frame(spark, [p for g, (n, _) in enumerate(sizes) for p in points(g, n, 0)], "g int, idx int, v array<double>").repartition(3)
    b = frame(spark, [p for g, (_, n) in enumerate(sizes) for p in points(g, n, 1)], "g int, idx int, v array<double>").repartition(4)
    cols = ["g", "ia", "ib", "d1", "d2"]
    want = rows_of(matching.nearest_two(matching.distances(a, b, ["g"], 6), ["g"], "ia", "ib"), cols)
    assert rows_of(matching.two_nearest(a, b, ["g"], 6, few), cols) == want and len(want) == 150 + 120 + 60 + 5 + 40


def test_pivots_spare_most_distances(spark):
    """A set of 10,000 points: distances to pivots and to candidates together are a small part of all pairs, and cells are many."""
    df = spark.range(10_000).selectExpr("1 AS g", "id AS idx", "array(double(xxhash64(id) % 1000) / 1000, double(xxhash64(id, 1) % 1000) / 1000, double(xxhash64(id, 2) % 1000) / 1000) AS v")
    a, b = df.filter("idx % 2 = 0"), df.filter("idx % 2 = 1")
    k = min(71, matching.PIVOTS)
    pairs = matching.pruned_pairs(a, b, ["g"])
    spread = matching._placed(b, matching.pivots_of(b, ["g"]), ["g"]).groupBy("cell").count()
    # exact pairs of the own cells are counted whole, though only two of each are kept
    inside = sum(r["n"] * r["m"] for r in matching._placed(a, matching.pivots_of(b, ["g"]), ["g"]).groupBy("cell").agg(F.count("*").alias("n")).join(spread.select("cell", F.col("count").alias("m")), "cell").collect())
    evaluated = 10_000 * k + inside + pairs.count()
    assert evaluated < 0.15 * 5_000 * 5_000 and spread.count() == k and spread.agg(F.max("count")).first()[0] < 5_000 / 8


def big_pair(spark, n=60_000):
    a = spark.range(n).selectExpr("id", "id % 7 AS g", "CASE WHEN id % 11 > 0 THEN double(id) / 3 END AS x", "array(id, NULL) AS l", "named_struct('a', id % 5) AS s")
    k = F.col("id")
    b = a.filter("id <> 40321").withColumns({"x": F.when(k == 22, 1.0).when(k == 777, None).otherwise(F.col("x")), "g": F.when(k == 5000, 9).otherwise(F.col("g"))})
    return a, b.unionByName(a.filter("id = 3").withColumn("id", F.lit(n + 5).cast("bigint"))).repartition(6)


def test_reconciling_joins_only_what_differs(spark, monkeypatch):
    """Six planted differences in 60,000 rows: the join sees a few leaves, and finds all of them."""
    a, b = big_pair(spark)
    cols = ["g", "x", "l", "s"]
    want = rows_of(parity.row_diff(a, b, ["id"], cols), ["id", "field", "expected", "actual"])
    assert [(r[0], r[1]) for r in want] == [(22, "x"), (40321, "row"), (5000, "g"), (60005, "row"), (777, "x")]
    monkeypatch.setattr(reconcile, "LEAF", 64)
    left, right = reconcile.reconciled(a, b, ["id"], cols, small=100)
    assert left.count() < 60 * 5 and right.count() < 60 * 5 and left.columns == a.columns
    monkeypatch.setattr(reconcile, "SMALL", 100)
    assert rows_of(parity.row_diff(a, b, ["id"], cols), ["id", "field", "expected", "actual"]) == want
    assert [x.count() for x in reconcile.reconciled(a, a.repartition(3), ["id"], cols)] == [0, 0]
    found = publish.build_differences(a.select("id", "g", "x"), b.select("id", "g", "x"))
    assert rows_of(found, ["side", "id"]) == sorted([("rebuilt", i) for i in (22, 777, 5000, 40321)] + [("stored", i) for i in (22, 777, 5000, 60005)], key=repr)


def test_reconciling_repeated_rows_and_other_types(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "SMALL", 10)
    monkeypatch.setattr(reconcile, "LEAF", 8)
    a = spark.range(300).selectExpr("id % 100 AS k", "int(id % 100) AS v")
    b = spark.range(300).selectExpr("id % 100 AS k", "bigint(id % 100) AS v").filter("k <> 4").unionByName(spark.range(2).selectExpr("4L AS k", "4L AS v"))
    assert rows_of(publish.build_differences(a, b.selectExpr("k", "int(v) AS v")), ["side", "k"]) == [("rebuilt", 4)]
    same, _ = reconcile.reconciled(a, a.selectExpr("k", "bigint(v) AS v"), ["k"], ["v"])
    assert same.count() == 0
    other, _ = reconcile.reconciled(a, a.selectExpr("string(k) AS k", "v"), ["k"], ["v"])
    assert other.count() == 300
    nulls = spark.sql("SELECT CAST(NULL AS bigint) AS k, CAST(NULL AS int) AS v FROM range(40)")
    assert publish.build_differences(a.union(nulls), a.union(nulls).repartition(3)).count() == 0


@pytest.mark.parametrize("n, share, k", [(200, 40, 5), (6, 1, 9), (12, 3, 4)])
def test_strata_choose_at_once_as_in_turn(spark, monkeypatch, n, share, k):
    """As many rounds for 200 strata as for a few; the cohort is that of the sequential choice."""
    import hashlib

    r = random.Random(n)
    names = [f"s{i:03d}" for i in range(n)]
    rows = sorted({(s, r.randrange(n * k)) for s in names for _ in range(3 * k if share > 1 else n * k)})
    taken, want = set(), []
    for s in names:
        ranked = sorted((hashlib.sha256(f"v\n1\n{s}\n{x}".encode()).hexdigest(), x) for t, x in rows if t == s and x not in taken)
        want += [(s, x, i + 1) for i, (_, x) in enumerate(ranked[:k])]
        taken |= {x for _, x in ranked[:k]}
    rounds, ask = [], cohort.proposals
    monkeypatch.setattr(cohort, "proposals", lambda *a: rounds.append(1) or ask(*a))
    got = cohort.select_cohort(frame(spark, rows, "stratum string, subject int"), names, k, "v", "1")
    assert rows_of(got, ["stratum", "subject", "selection_rank"]) == sorted(want, key=repr)
    assert len(rounds) <= 12


def test_distinct_totals_by_bitmaps(spark):
    """Negative, large and repeated integers, null ones and texts; no row is multiplied for the total."""
    rows = [("a", 1), ("a", 1), ("a", 32768), ("b", 32769), ("b", -5), ("b", 5), ("b", 1), ("c", None), (None, 10**12)]
    df = frame(spark, rows, "g string, s bigint")
    want = [("a", 3, 2), ("b", 4, 4), ("c", 1, 0), ("total", 9, 6), (None, 1, 1)]
    for d in (df, df.withColumn("s", F.col("s").cast("string"))):
        out = aggregates.totals(d, "g", "s")
        assert rows_of(out, ["g", "rows", "subjects"]) == sorted(want, key=repr)
        assert "Expand" not in out._jdf.queryExecution().toString()


def test_large_pairs_try_a_part_first(spark):
    """4,000 matches, a third of them outliers: the transform is found, and a tenth of the tests are made; a small pair beside it is as before."""
    r = random.Random(9)
    true = (1.02, -0.2, 11.0, 0.2, 1.02, -7.0)
    rows = []
    for pair, n in (("big", 4000), ("small", 60)):
        for i in range(n):
            x, y = r.uniform(0, 400), r.uniform(0, 400)
            u, v = true[0] * x + true[1] * y + true[2] + r.gauss(0, 0.3), true[3] * x + true[4] * y + true[5] + r.gauss(0, 0.3)
            rows.append((pair, i, x, y, *((u, v) if i % 3 else (r.uniform(0, 400), r.uniform(0, 400)))))
    df = frame(spark, rows, "pair string, idx int, x double, y double, u double, v double").repartition(3)
    got = {g["pair"]: g for g in affine.robust_affine(df).collect()}
    for pair, n in (("big", 4000), ("small", 60)):
        assert abs(got[pair]["inliers"] - n * 2 / 3) < 0.02 * n + 2
        assert all(abs(got[pair][m] - t) < e for m, t, e in zip(affine.MODEL, true, (0.01, 0.01, 1, 0.01, 0.01, 1)))
    sizes = df.groupBy("pair").agg(F.count("*").alias("n"))
    part = affine.part_of(df.join(sizes, "pair")).groupBy("pair").count().collect()
    part = {p["pair"]: p["count"] for p in part}
    hypotheses = df.select("pair").distinct().crossJoin(spark.range(200).selectExpr("string(id) AS h", "id AS hits")).selectExpr("pair", "h", *[f"0.0 AS {m}" for m in affine.MODEL], "hits")
    rest = affine.going_on(hypotheses, sizes).groupBy("pair").count().collect()
    assert part["small"] == 60 and [(p["pair"], p["count"]) for p in rest] == [("big", affine.GO_ON)]
    assert 200 * part["big"] + affine.GO_ON * 4000 < 200 * 4000 / 10


def test_constant_column_has_no_correlation(spark):
    df = frame(spark, [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0)], "g string, x double, y double")
    assert dict(rows_of(aggregates.pearson(df, "x", "y", ["g"]), ["g", "pearson"])) == {"a": None, "b": None, "c": 1.0}


def test_nearest_rank(spark):
    sizes = [1, 7, 19, 20, 21, 40, 100]
    df = frame(spark, [(n, float(i)) for n in sizes for i in range(n)], "n int, x double")
    got = {r["n"]: r["x_p"] for r in aggregates.nearest_rank(df, ["n"], {"x": F.col("x")}, {"p": 0.95}).collect()}
    assert got == {n: sorted(range(n))[min(n - 1, -(-95 * n // 100) - 1)] for n in sizes}
    assert aggregates.nearest_rank(df, [], {"x": F.col("x")}, {"p": 0.5}).first()["x_p"] is not None


def test_sampling(spark):
    df = frame(spark, [(i * 3, i) for i in range(25)], "key int, s int")
    d = sampling.with_ordinals(df.orderBy(F.rand(1)), "key")
    assert [r["key"] for r in d.orderBy("ordinal").collect()] == [i * 3 for i in range(25)]
    assert [r["ordinal"] for r in sampling.stride_ordinals(d).orderBy("ordinal").collect()] == [i * 25 // 10 for i in range(10)]
    assert sampling.highest(d.withColumn("s", F.lit(1)), "s").first()["ordinal"] == 24
    got = {r["case_name"]: r["ordinal"] for r in sampling.distinct_cases(d, {"a": F.col("s") > 3, "b": F.col("s") > 3, "c": F.col("s") > 4, "none": F.col("s") > 99}).collect()}
    assert got == {"a": 4, "b": 5, "c": 6, "none": None}
    assert sampling.capped(d, "ordinal", 3).count() == 3
    assert sampling.refused_over(d.withColumn("g", F.col("s") % 2), ["g"], 12).first()["n_rows"] == 13


def test_parity(spark):
    a = frame(spark, [(1, "x", '{"n": 1, "t_ms": 5}'), (2, "y", "{}"), (3, "z", "{}")], "id int, v string, d string")
    b = frame(spark, [(1, "x", '{"n": 2, "t_ms": 9}'), (2, None, "{}"), (4, "q", "{}")], "id int, v string, d string")
    oa, ob = (parity.outcome(x, ["id"], ["v"], ["d"]) for x in (a, b))
    assert sorted((r["id"], r["field"]) for r in parity.row_diff(oa, ob, ["id"], ["v", "d"]).collect()) == [(1, "d"), (2, "v"), (3, "row"), (4, "row")]
    assert rows_of(documents.document_diff(a, b, ["id"], "d"), ["id", "field"]) == [(1, "n"), (3, "row"), (4, "row")]
    assert parity.row_diff(oa, oa.repartition(3), ["id"], ["v", "d"]).count() == 0


def test_dominant_bin_matches_brute_force(spark):
    import math

    random.seed(2)
    s = [(1, x, y, random.uniform(-1, 1), random.uniform(-1, 1)) for x in range(24) for y in range(24)]
    p = [(1, i, random.uniform(0, 23), random.uniform(0, 23), random.choice([1.0, 3.0, 6.0])) for i in range(6)] + [(1, 9, 500.0, 500.0, 2.0)]
    got = {r["pid"]: r["bin"] for r in orientation.dominant_angle(frame(spark, p, "k int, pid int, x double, y double, support double"), frame(spark, s, "k int, x int, y int, gx double, gy double"), ["k"]).collect()}
    for _, i, px, py, sup in p:
        r, sig, h = max(1, math.floor(2.25 * sup + 0.5)), 0.75 * sup, [0.0] * 36
        for _, x, y, gx, gy in s:
            d2 = (x - px) ** 2 + (y - py) ** 2
            if d2 <= r * r:
                h[int(math.degrees(math.atan2(gy, gx)) % 360 * 36 / 360) % 36] += math.exp(-d2 / (2 * sig * sig)) * math.hypot(gx, gy)
        assert got[i] == (h.index(max(h)) if any(h) else None)


# ---- bundles, preflights, times, quantiles


def test_bundle_rules_name_each_difference(spark):
    res = frame(spark, [("k", "ok", "1"), ("k", "ok", "2"), ("j", "ok", "1"), ("i", "ok", "1")], "b string, status string, version string")
    meta = frame(spark, [("k", 2, 2, "1", "d"), ("j", 1, 1, "9", "d"), ("i", 1, 1, "1", "old")], "b string, n_rows int, n_ok int, version string, digest string")
    now = frame(spark, [("k", "d"), ("j", "d"), ("i", "d")], "b string, digest string")
    found = contract.bundle_faults(res, meta, ["b"], ("version",), now)
    assert rows_of(found, ["b", "rule"]) == [("i", "stale_digest"), ("j", "version_differs"), ("k", "version_varies")]


def test_quantiles_are_exact_for_any_partitioning(spark):
    import random

    import numpy as np

    rng = random.Random(1)
    rows = [(g, float(rng.choice([1, 2, 5, rng.random()])), None if rng.random() < 0.2 else rng.random()) for g in "ab" for _ in range(rng.randint(50, 99))] + [("c", None, None)]
    df = frame(spark, rows, "g string, x double, y double")
    for parts in (1, 5):
        out = selection.summaries(df.repartition(parts), ["g"], {"x": F.col("x"), "y": F.col("y")}, {"p25": 0.25, "p50": 0.5}, {"p95": 0.95}, ())
        got = {r["g"]: r for r in out.collect()}
        assert set(got) == {"a", "b", "c"} and set(got.pop("c")[1:]) == {None}  # a group without values has nulls
        for g, r in got.items():
            for i, c in ((1, "x"), (2, "y")):
                v = sorted(row[i] for row in rows if row[0] == g and row[i] is not None)
                assert r[f"{c}_p25"] == pytest.approx(np.quantile(v, 0.25)) and r[f"{c}_p50"] == pytest.approx(np.median(v)) and r[f"{c}_p95"] == v[-(-95 * len(v) // 100) - 1]
    files = frame(spark, [("a", "f" * 64)], "g string, sha256 string")
    summed = aggregates.file_summary(df.withColumns({"raw_score": F.col("x"), "status": F.lit("ok")}), "g", ["y"], ["ok"], files)
    assert {r["g"]: r["sha256"] for r in summed.collect()} == {"a": "f" * 64, "b": None, "c": None}


def test_histograms_are_exact_or_absent(spark, monkeypatch):
    """A code named `other` is a code like any; a group with too many codes has no text, and its counts are rows."""
    monkeypatch.setattr(aggregates, "MOST_CODES", 2)
    df = frame(spark, [("g", c) for c in "aaabb"] + [("h", c) for c in ("a", "other", "other", "z", None)], "g string, code string")
    assert rows_of(aggregates.histogram_text(df, ["g"], "code", "t"), ["g", "t"]) == [("g", "a:3,b:2"), ("h", None)]
    assert rows_of(aggregates.code_counts(df, ["g"], "code"), ["g", "code", "n"]) == [("g", "a", 3), ("g", "b", 2), ("h", "a", 1), ("h", "other", 2), ("h", "z", 1)]


@pytest.mark.parametrize("few", [1, 50, selection.FEW])
def test_selection_of_hard_values(spark, few):
    """Nearly equal values, huge ranges, both zeros, infinities, subnormals and ties: every rank as sorting gives it, whatever the number of passes."""
    r = random.Random(8)
    tiny = 5e-324
    near = [1.0 + i * 2.0**-52 for i in r.sample(range(4000), 700)]
    wide = [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(500)]
    odd = [0.0, -0.0, tiny, -tiny, 2 * tiny, float("inf"), float("-inf"), 1.0, 1.0, 1.0]
    groups = {"near": near, "wide": wide, "odd": odd, "ties": [7.0] * 40 + [7.5], None: [3.0, 1.0, 2.0], "one": [2.5], "skew": [1.0] * 90 + [1.0 + 2.0**-50] * 3 + [1.003]}
    df = frame(spark, [(g, x) for g, xs in groups.items() for x in xs] + [("none", None), ("near", None)], "g string, x double").repartition(7)
    fractions = {f"r{i}": i / 16 for i in range(17)}
    got = {x["g"]: x for x in selection.summaries(df, ["g"], {"x": F.col("x")}, {"mid": 0.5, "q": 0.3}, fractions, few=few).collect()}
    assert set(got) == {*groups, "none"} and got["none"]["x_mid"] is None and got["none"]["x_n"] == 0
    for g, xs in groups.items():
        xs = sorted(xs)
        assert [got[g][f"x_{s}"] for s in fractions] == [xs[max(-(-i * len(xs) // 16), 1) - 1] for i in range(17)]
        if g != "odd":
            for s, f in (("mid", 0.5), ("q", 0.3)):
                h = f * (len(xs) - 1)
                assert got[g][f"x_{s}"] == pytest.approx(xs[int(h)] + (xs[min(int(h) + 1, len(xs) - 1)] - xs[int(h)]) * (h - int(h)), rel=1e-12)
        assert (got[g]["x_n"], got[g]["x_min"], got[g]["x_max"]) == (len(xs), xs[0], xs[-1])


def test_selection_counts_buckets_not_values(spark):
    """The first pass leaves a bounded number of cells a group for the shuffle, and the second only values of the cells asked for."""
    df = spark.range(200_000).selectExpr("'g' AS g", "double(id) * 0.37 + 1 AS x")
    cells = df.groupBy("g", selection.coarse(F.col("x"))).agg(F.count("*").alias("n"), F.max("x").alias("hi"))
    assert cells.count() < 4500 and cells.agg(F.max("n")).first()[0] < 700
    assert selection.summaries(df, ["g"], {"x": F.col("x")}, {"m": 0.5}).first()["x_m"] == pytest.approx(99999.5 * 0.37 + 1)


@pytest.mark.parametrize("model, size", [("partial", 2), ("full", 3)])
def test_as_many_hypotheses_are_tried_as_asked(spark, model, size):
    """Draws are distinct samples in ascending order, as many as asked or there are."""
    from math import comb

    rows = [(p, i, float(i), float(i * i % 7), 2.0 * i, 1.0) for p, n in ((1, 5), (2, 40), (3, 3)) for i in range(n)]
    df = frame(spark, rows, "pair int, idx int, x double, y double, u double, v double")
    samples = affine.drawn_samples(df.groupBy("pair").agg(F.count("*").alias("n")), size, 200)
    got = {}
    for r in samples.collect():
        got.setdefault(r["pair"], []).append(tuple(r[f"k{i}"] for i in range(size)))
    for p, n in ((1, 5), (2, 40), (3, 3)):
        assert len(got[p]) == len(set(got[p])) == min(200, comb(n, size))
        assert all(list(s) == sorted(set(s)) and s[-1] < n and s[0] >= 0 for s in got[p])


def test_short_strata_are_refused_on_demand(spark):
    df = frame(spark, [("s", i) for i in range(3)], "stratum string, subject int")
    assert cohort.select_cohort(df, ["s"], 5, "v", "1").count() == 3
    with pytest.raises(ValueError):
        cohort.select_cohort(df, ["s"], 5, "v", "1", whole=True)


def leaves_of(spark, *docs, **kw):
    df = frame(spark, list(enumerate(docs)), "id int, j string")
    out = {i: [] for i in range(len(docs))}
    for r in documents.leaves(df, ["id"], "j", **kw).select("id", documents.path_text(F.col("path")).alias("p"), "value").collect():
        out[r["id"]].append((r["p"], r["value"]))
    return [sorted(x) for x in out.values()]


def test_leaves_go_to_any_depth(spark):
    deep = '{"a":' * 30 + '{"x": 1, "pid": 2}' + "}" * 30
    got = leaves_of(spark, '{"b": [1, {"c": null, "t_ms": 3}], "a": {"d": {"e": {"f": {"g": 1.50}}}}}', deep, "[1", None, " ", "7", '[[], {"pid": 1}]')
    assert got[0] == [("a.d.e.f.g", "1.5"), ("b[0]", "1"), ("b[1].c", "null")]
    assert got[1] == [("a." * 30 + "x", "1")] and got[2] == [("", "malformed:[1")]
    assert got[3] == got[4] == [("", "{}")] and got[5] == [("", "7")] and got[6] == [("[0]", "[]"), ("[1]", "{}")]


def test_leaves_keep_types_digits_and_names(spark):
    doc = r'{"k": 9007199254740993, "t": true, "s": "tr\"ue]", "c.d": 1, "c": {"d": 2, "0": [5]}, "x.pid": {"y": {}}, "": 1e2, "p": {"a_ms": 1}, "h": 1e-3, "i": 0.1}'
    assert leaves_of(spark, doc)[0] == sorted(
        [("k", "9007199254740993"), ("t", "true"), ("s", r'"tr\"ue]"'), ('["c.d"]', "1"), ("c.d", "2"), ('c["0"][0]', "5"), ('["x.pid"].y', "{}"), ('[""]', "100"), ("p", "{}"), ("h", "0.001"), ("i", "0.1")]
    )


def test_nesting_ignores_strings(spark):
    texts = ['{"a": "[[[", "b\\"{": [1]}', "[]", "1", '"{"', "[" * 9 + "]" * 9]
    assert [r[0] for r in frame(spark, [(x,) for x in texts], "t string").select(documents.nesting(documents.brackets_of(F.col("t")))).collect()] == [2, 1, 0, 0, 9]


def test_documents_differ_by_type_and_digit(spark):
    """Every planted difference is found once, and equal numbers in other forms are none."""
    a = frame(spark, [(1, '{"k":9007199254740993,"t":true,"s":"1"}', "x"), (2, '{"c.d":1,"c":{"d":2},"x.pid":1}', "x"), (3, '{"a":{},"b":[]}', "x"), (4, '{"n":[1,2.0,1e2]}', None)], "id int, d string, v string")
    b = frame(spark, [(1, '{"k":9007199254740992,"t":"true","s":1}', "x"), (2, '{"c.d":2,"c":{"d":2},"x.pid":2}', "y"), (3, '{"b":{},"p_ms":1}', "x"), (4, '{"n":[1.0,2,100]}', None)], "id int, d string, v string")
    got = documents.document_diff(a, b, ["id"], "d", ["v"]).collect()
    assert sorted(((r["id"], r["field"], r["expected"], r["actual"]) for r in got), key=repr) == [
        (1, "k", "9007199254740993", "9007199254740992"),
        (1, "s", '"1"', "1"),
        (1, "t", "true", '"true"'),
        (2, '["c.d"]', "1", "2"),
        (2, '["x.pid"]', "1", "2"),
        (2, "v", "x", "y"),
        (3, "a", "{}", None),
        (3, "b", "[]", "{}"),
    ]


def test_documents_need_no_python(spark):
    plan = documents.leaves(frame(spark, [(1, '{"a": [1]}')], "id int, j string"), ["id"], "j")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 0
