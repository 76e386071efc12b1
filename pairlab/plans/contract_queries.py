"""Queries over sinks, readers, run contracts and plug-ins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, keys, numbers
from ..operators import cohort, contract, pairs, parity, records, sampling, scoring
from ..sources import publish, readers, scan
from .jobs import build_joint_protocol, build_protocol, score_features
from .jobs import dataset_preflight as dataset_preflight_of
from .jobs import protocol_checks as protocol_checks_of
from .records_queries import A_SQL, B_SQL, ELIGIBLE_COHORT_SQL, GENUINE_SQL, HASH_SQL, LAST, PROTOCOL_SQL, SEED, STRATA, VERSION, K, genuine, side, t
from .score_queries import PAIRS_SQL, next_pairs, point_set, scored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{publish.staging_dir(spark)}/{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered CSV export and a strict read of it."""
    c = t(spark, sf, "customer")
    path = scratch(spark)
    publish.write_csv(c, path, ["c_custkey"])
    return readers.strict_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("SELECT p_partkey, p_brand, p_size, 2 AS n_tags FROM part")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Nested columns flattened to text, JSON lines with sorted keys, read with a schema."""
    p = t(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.array("p_type", "p_name").alias("tags"))
    path = scratch(spark)
    publish.write_json(publish.flattened(p), path)
    back = spark.read.schema("p_partkey bigint, p_brand string, p_size int, tags string").json(path)
    return back.select("p_partkey", "p_brand", "p_size", F.size(F.from_json("tags", "array<string>")).alias("n_tags"))


@query("SELECT o_orderstatus, count(*) AS rows, sum(o_custkey)::bigint AS keys, 2::bigint AS refused FROM orders GROUP BY o_orderstatus")
def committed_table(spark: SparkSession, sf: str) -> DataFrame:
    """S9-S11 without renames: a table beside the files of a killed writer, and two further writers that are refused, one for a broken rule."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path, unique = scratch(spark), lambda df: records.duplicate_values(df, ["o_orderkey"])
    o.limit(5).write.parquet(f"{path}/data-killed")
    refused = 0
    for df in (o.unionByName(o.limit(1)), o, o.limit(3)):
        try:
            publish.commit_table(df, path, unique)
        except publish.PublishError:
            refused += 1
    return publish.live_table(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.sum("o_custkey").alias("keys")).withColumn("refused", F.lit(refused).cast("bigint"))


@query("""
SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 89 <> 0) AS rebuilt,
       count(*) FILTER (WHERE o_orderkey % 89 = 0) + 2 * count(*) FILTER (WHERE o_orderkey % 89 <> 0 AND o_orderkey % 97 = 0) AS differences FROM orders GROUP BY o_orderstatus
""")
def published_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Validate, publish in partitions, reuse, compare with a rebuild that lacks rows and has others changed."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch(spark)
    checks = lambda df: records.duplicate_values(df, ["o_orderkey"]).select("o_orderkey")
    publish.publish(o, path, checks, ["o_orderstatus"])
    stored = publish.publish_or_reuse(o, path, checks)
    again = o.filter("o_orderkey % 89 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    differences = publish.build_differences(again, stored).groupBy("o_orderstatus").agg(F.count("*").alias("differences"))
    rebuilt = again.groupBy("o_orderstatus").agg(F.count("*").alias("rebuilt"))
    out = stored.groupBy("o_orderstatus").agg(F.count("*").alias("rows")).join(rebuilt, "o_orderstatus").join(differences, "o_orderstatus", "left")
    return out.select("o_orderstatus", "rows", "rebuilt", F.coalesce("differences", F.lit(0)).alias("differences"))


@query("""
WITH f AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, year(o_orderdate) % 2 AS half FROM orders) GROUP BY ALL)
SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown_partition' WHEN n > 1 THEN 'duplicate_partition' END AS rule FROM f WHERE o_orderpriority = '5-LOW' OR n > 1
""")
def partition_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown and repeated partitions of a results folder."""
    found = t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", (F.year("o_orderdate") % 2).alias("half")).distinct()
    dims = [spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("o_orderstatus", "FOP"), ("o_orderpriority", STRATA[:-1]))]
    return publish.partition_faults(found, scoring.run_matrix(dims), ["o_orderstatus", "o_orderpriority"])


@query("""
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '/data/../' WHEN o_orderkey % 13 = 0 THEN '/database/' WHEN o_orderkey % 17 = 0 THEN '/data/./' ELSE '/data//' END || o_orderstatus || '/' ||
           (CASE WHEN o_orderkey % 19 = 0 THEN o_custkey + 1 ELSE o_custkey END)::varchar || '.png' AS path, o_custkey, o_orderstatus FROM orders)
SELECT o_orderkey, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS contained, CASE WHEN o_orderkey % 19 = 0 THEN 'subject' END AS field FROM p
""")
def path_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Containment under a root, and agreement of a path's parts with the row."""
    k = F.col("o_orderkey")
    root = F.when(k % 11 == 0, "/data/../").when(k % 13 == 0, "/database/").when(k % 17 == 0, "/data/./").otherwise("/data//")
    named = F.when(k % 19 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    o = t(spark, sf, "orders").withColumn("path", F.concat(root, "o_orderstatus", F.lit("/"), named.cast("string"), F.lit(".png")))
    o = o.select(k, F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("side"), "path", F.regexp_extract("path", r"([A-Z])/(\d+)\.png$", 1).alias("path_side"), F.regexp_extract("path", r"([A-Z])/(\d+)\.png$", 2).cast("bigint").alias("path_subject"))
    wrong = records.disagreements(o, [("subject", "path_subject"), ("side", "path_side")], "o_orderkey").select("o_orderkey", "field")
    return o.select("o_orderkey", records.under_root(F.col("path"), F.lit("/data")).alias("contained")).join(wrong, "o_orderkey", "left")


@query("""
SELECT s_suppkey, 'ppi' AS field, '1000' AS expected, (CASE WHEN s_suppkey % 9 = 0 THEN 2000 ELSE 1000 END)::varchar AS actual FROM supplier WHERE s_suppkey % 9 = 0
UNION ALL SELECT s_suppkey, 'dataset', 'd', NULL FROM supplier WHERE s_suppkey % 14 = 0
""")
def run_constants(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that must equal the run's constants."""
    k = F.col("s_suppkey")
    s = t(spark, sf, "supplier").select("s_suppkey", F.when(k % 9 == 0, 2000).otherwise(1000).alias("ppi"), F.when(k % 14 != 0, "d").alias("dataset"))
    return records.constant_violations(s, {"ppi": 1000, "dataset": "d"}, "s_suppkey")


@query(f"""
WITH {PAIRS_SQL}, a AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok FROM s GROUP BY label),
m AS (SELECT label, CASE WHEN label = 3 THEN n + 1 ELSE n END AS n_rows, CASE WHEN label = 5 THEN ok - 1 ELSE ok END AS n_ok FROM a WHERE label <> 7 UNION ALL SELECT 99, 1, 1)
SELECT coalesce(m.label, a.label)::int AS label, CASE WHEN a.n IS NULL THEN 'no_results' WHEN m.n_rows IS NULL THEN 'no_metadata' WHEN n_rows <> n THEN 'row_count' WHEN n_ok <> ok THEN 'status_count' END AS rule
FROM m FULL JOIN a ON m.label = a.label WHERE a.n IS NULL OR m.n_rows IS NULL OR n_rows <> n OR n_ok <> ok
UNION ALL SELECT label, 'method_version_differs' FROM a WHERE label = 2
UNION ALL SELECT label, 'method_version_varies' FROM s WHERE label = 4 GROUP BY label HAVING count(DISTINCT capture_a % 2) > 1
UNION ALL SELECT label, 'method_version_differs' FROM s WHERE label = 4 GROUP BY label HAVING count(DISTINCT capture_a % 2) = 1 AND min(capture_a % 2) = 1
UNION ALL SELECT label, 'stale_manifest_sha256' FROM a WHERE label = 6 UNION ALL SELECT label, 'stale_manifest_path' FROM a WHERE label = 8 UNION ALL SELECT label, 'stale_preflight_sha256' FROM a WHERE label = 1
UNION ALL SELECT label, 'stale_digest' FROM s WHERE label = 9 GROUP BY label HAVING count(*) FILTER (WHERE capture_a % 3 = 0) > 0
""")
def bundle_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles against their metadata (counts, versions, digest, manifest, preflight), with a planted fault of each kind."""
    s, label = scored(spark, sf), F.col("label")
    s = s.withColumn("method_version", F.when((label == 4) & (F.col("capture_a") % 2 == 1), "1b").otherwise(F.col("method_version")))
    digest = lambda df, name: digests.ordered_digest(sampling.ranked_in_groups(df.select("label", "capture_a", "status"), ["label"], ["capture_a"], "o"), "o", ["capture_a", "status"], ["label"]).select("label", F.col("digest").alias(name))
    shown = lambda fault, c: F.when(label == fault, F.concat(c, F.lit("~"))).otherwise(c)
    path, sha, pre = F.format_string("manifests/%d.csv", label), F.sha2(label.cast("string"), 256), F.sha2(F.concat(F.lit("p"), label.cast("string")), 256)
    current = s.select("label").distinct().select("label", path.alias("manifest_path"), sha.alias("manifest_sha256"), pre.alias("preflight_sha256")).join(digest(s, "digest"), "label")
    meta = s.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "ok").alias("n_ok")).filter("label <> 7")
    meta = meta.withColumns({"n_rows": F.when(F.col("label") == 3, F.col("n_rows") + 1).otherwise(F.col("n_rows")), "n_ok": F.when(F.col("label") == 5, F.col("n_ok") - 1).otherwise(F.col("n_ok"))})
    meta = meta.unionByName(spark.createDataFrame([(99, 1, 1)], "label int, n_rows bigint, n_ok bigint"))
    meta = meta.withColumns({"method_version": F.when(label == 2, "2").otherwise("1"), "manifest_path": shown(8, path), "manifest_sha256": shown(6, sha), "preflight_sha256": shown(1, pre)})
    meta = meta.join(digest(s.filter(~((label == 9) & (F.col("capture_a") % 3 == 0))), "digest"), "label", "left")
    return contract.bundle_faults(s, meta, ["label"], ("method_version",), current)


@query("""
WITH d AS (SELECT DISTINCT o_orderstatus AS s, substring(o_orderpriority, 1, 1) AS k, 'm' || (o_custkey % 2) AS m, CASE WHEN substring(o_orderpriority, 1, 1) = '5' AND o_orderkey % 2 = 0 THEN 'c2' ELSE 'c1' END AS c FROM orders),
f AS (SELECT *, 'dataset=' || s || '/kind=' || k || '/method=' || m || '/contract=v1/config=' || c AS folder, count(*) OVER (PARTITION BY s, k, m) AS n FROM d)
SELECT folder, 'unknown_dataset' AS rule FROM f WHERE s = 'P' UNION ALL SELECT folder, 'unknown_kind' FROM f WHERE k = '4' UNION ALL SELECT folder, 'duplicate' FROM f WHERE n > 1 UNION ALL SELECT 'dataset=F/kind=1', 'misplaced' UNION ALL SELECT 'dataset=F/kind=1/stray', 'misplaced'
""")
def bundle_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles in a tree of five levels, and a walk of it that names misplaced, unknown and duplicate ones."""
    levels = ["dataset", "kind", "method", "contract", "config"]
    kind = F.substring("o_orderpriority", 1, 1)
    config = F.when((kind == "5") & (F.col("o_orderkey") % 2 == 0), "c2").otherwise("c1")
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("dataset"), kind.alias("kind"), F.concat(F.lit("m"), (F.col("o_custkey") % 2).cast("string")).alias("method"), F.lit("v1").alias("contract"), config.alias("config"))
    path = scratch(spark)
    publish.publish(o.repartition(*levels), path, lambda df: records.duplicate_values(df, ["o_orderkey"]), levels)
    o.filter("dataset = 'F'").limit(1).select("o_orderkey").write.parquet(f"{path}/dataset=F/kind=1/stray")
    spark.range(1).write.parquet(f"{path}/dataset=F/kind=1", mode="append")
    folders = publish.bundle_folders(scan.scan_files(spark, path, "*.parquet"), path, levels)
    return publish.bundle_folder_faults(folders, levels, {"dataset": ["F", "O"], "kind": ["1", "2", "3", "5"]}, levels[:3])


@query("""
WITH a AS (SELECT s_suppkey AS i, 'a' || s_suppkey AS artifact FROM supplier)
SELECT artifact, 'missing_artifact' AS rule FROM a WHERE i % 11 = 0 AND i % 10 <> 9
UNION ALL SELECT artifact, 'extra_artifact' FROM a WHERE i % 11 <> 0 AND i % 10 = 9
UNION ALL SELECT artifact, 'malformed_digest' FROM a WHERE i % 11 <> 0 AND i % 13 = 0
UNION ALL SELECT artifact, 'digest_mismatch' FROM a WHERE i % 11 <> 0 AND i % 10 <> 9 AND i % 13 <> 0 AND i % 7 = 0
UNION ALL SELECT artifact, 'outside_root' FROM a WHERE i % 11 <> 0 AND i % 17 = 0
UNION ALL SELECT 'run_' || artifact, 'not_in_preflight' FROM a WHERE i % 11 = 0
UNION ALL SELECT 'run_' || artifact, 'changed_after_preflight' FROM a WHERE i % 11 <> 0 AND i % 19 = 0
""")
def preflight_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A stored preflight against a rebuild of its artifacts, and runs bound to it, with planted faults."""
    i = F.col("s_suppkey")
    name, sha = F.concat(F.lit("a"), i.cast("string")), F.sha2("s_name", 256)
    s = t(spark, sf, "supplier").select(i, name.alias("artifact"), sha.alias("sha256"))
    rebuilt = s.filter(i % 10 != 9).select("artifact", "sha256")
    kept = s.filter(i % 11 != 0)
    stored_sha = F.when(i % 13 == 0, F.upper("sha256")).when(i % 7 == 0, F.sha2(F.reverse("sha256"), 256)).otherwise(F.col("sha256"))
    path = F.concat(F.when(i % 17 == 0, "/protocol/../").otherwise("/protocol/"), "artifact")
    stored = kept.select("artifact", stored_sha.alias("sha256"), path.alias("path"))
    faults = contract.preflight_faults(stored, rebuilt, F.lit("/protocol"))
    now = s.join(stored.select("artifact", F.col("sha256").alias("_s")), "artifact", "left")
    wanted = now.select(F.concat(F.lit("run_"), "artifact").alias("run"), "artifact", F.when(i % 19 == 0, "changed").otherwise(F.coalesce("_s", "sha256")).alias("sha256"))
    return faults.unionByName(contract.binding_faults(wanted, stored).select(F.col("run").alias("artifact"), "rule"))


_MS = "CASE WHEN {0} % 61 = 7 THEN -1.0 ELSE ({0} % 7) * 0.5 END::double"


_TIMED_SQL = f"""
WITH {PAIRS_SQL}, x AS (SELECT capture_a, capture_b, {_MS.format('capture_a')} AS ma, {_MS.format('capture_b')} AS mb FROM s),
y AS (SELECT *, CASE WHEN ma < 0 THEN 'prepare_a_failure' WHEN mb < 0 THEN 'prepare_b_failure' WHEN capture_a % 41 = 3 OR capture_a % 37 = 5 THEN 'comparison_failure' ELSE 'ok' END AS status FROM x),
z AS (SELECT capture_a, capture_b, status, CASE WHEN status = 'comparison_failure' AND capture_a % 37 = 5 THEN 'refused_pair' WHEN status <> 'ok' THEN 'invalid_method_timing' END AS error_code,
      greatest(ma, 0) AS prepare_a_ms, CASE WHEN status <> 'prepare_a_failure' THEN greatest(mb, 0) END AS prepare_b_ms, CASE WHEN ma >= 0 THEN ma END AS method_prepare_a_ms,
      CASE WHEN status <> 'prepare_a_failure' AND mb >= 0 THEN mb END AS method_prepare_b_ms, CASE WHEN status IN ('ok', 'comparison_failure') THEN CASE WHEN capture_a % 41 = 3 THEN 0.0 ELSE 2.0 END END AS compare_ms,
      CASE WHEN status IN ('ok', 'comparison_failure') AND capture_a % 41 <> 3 THEN 2.0 END AS method_compare_ms FROM y)
"""


def timed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows of a method that reports times, some of them refused, refuses some pairs, and says how long vectors are."""
    v = t(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    captures = v.select(F.col("vec_id").alias("capture"), F.col("embedding").alias("vector"))
    c, a = F.col("capture"), F.col("capture_a")
    ms = F.when(c % 61 == 7, -1.0).otherwise((c % 7) * 0.5)
    slow = F.when(a % 41 == 3, float("inf")).otherwise(2.0)
    return scoring.run_pairs(next_pairs(v), captures, scoring.Timed(scoring.Telling(scoring.DotProduct(64), F.when(a % 37 == 5, "refused_pair")), ms, slow))


@query(_TIMED_SQL + """
SELECT capture_a, capture_b, status, error_code, prepare_a_ms, prepare_b_ms, method_prepare_a_ms, method_prepare_b_ms, compare_ms, method_compare_ms, prepare_a_ms + coalesce(prepare_b_ms, 0) + coalesce(compare_ms, 0) AS total_ms FROM z
""")
def timed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Times of stages, null where a stage did not run; times that are not finite or negative fail their stage and are not kept."""
    stages = ("prepare_a", "prepare_b", "compare")
    return timed_rows(spark, sf).select("capture_a", "capture_b", "status", "error_code", *[f"{p}{s}_ms" for s in stages for p in ("", "method_")], "total_ms")


@query(_TIMED_SQL + """
SELECT status, coalesce(error_code, '') AS error_code, CASE error_code WHEN 'refused_pair' THEN 'method said: refused_pair' WHEN 'invalid_method_timing' THEN 'a reported time is not finite or is negative' ELSE '' END AS error_message,
       count(*) AS rows, count(method_compare_ms) AS compared, CASE WHEN status IN ('ok', 'comparison_failure') THEN '{"length":64}' ELSE '' END AS compare_diagnostics, 0::bigint AS faults, '' AS broken FROM z GROUP BY ALL
""")
def scored_run_holds(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a scored run, by outcome, and the row rules that they break: none."""
    rows = timed_rows(spark, sf)
    faults = contract.row_faults(rows, "capture_a").groupBy("capture_a").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.join(faults, "capture_a", "left").groupBy("status", text("error_code"), text("error_message"), text("compare_diagnostics")).agg(
        F.count("*").alias("rows"), F.count("method_compare_ms").alias("compared"), F.coalesce(F.sum("n"), F.lit(0)).alias("faults"), F.coalesce(F.max("rules"), F.lit("")).alias("broken")
    )


@query(f"""
WITH {PAIRS_SQL}, m AS (SELECT a.label, a.vec_id AS capture_a, a.e AS x, b.e AS y FROM v a JOIN v b ON a.nxt = b.vec_id)
SELECT 'dot' AS method, label, capture_a, round(list_dot_product(x, y), 6) AS raw_score FROM m WHERE label < 5
UNION ALL SELECT 'first_half', label, capture_a, round(list_dot_product(x[1:32], y[1:32]), 6) FROM m WHERE label % 2 = 0 AND label >= 5
""")
def filtered_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The wanted part of a run matrix over one checked table of pairs."""
    v = t(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    pairs_ = next_pairs(v)
    methods = spark.createDataFrame([("dot",), ("first_half",)], "method string")
    wanted = scoring.run_matrix([methods, v.select("label").distinct()], F.when(F.col("method") == "dot", F.col("label") < 5).otherwise((F.col("label") % 2 == 0) & (F.col("label") >= 5)))
    captures = v.select(F.col("vec_id").alias("capture"), F.col("embedding").alias("vector"))
    known = {"dot": scoring.DotProduct(64), "first_half": scoring.DotProduct(64, first=32)}
    faults = records.duplicate_values(pairs_, ["capture_a"])
    out = scoring.run_filtered(pairs_, captures, known, wanted, faults, "label")
    return out.select("method", "label", "capture_a", F.round("raw_score", 6).alias("raw_score"))


def _joint_sql() -> str:
    """The manifests of one view, and of one with the sides exchanged."""
    one = PROTOCOL_SQL.replace("'tpch_", "'one_")
    two = PROTOCOL_SQL.replace("'tpch_", "'two_").replace("a.capture AS ca, b.capture AS cb", "b.capture AS ca, a.capture AS cb").replace("rank_probe, a.capture, b.capture FROM q JOIN a ON a.subject = probe AND a.stratum = q.stratum JOIN b ON b.subject = candidate AND b.stratum = q.stratum", "rank_probe, b.capture, a.capture FROM q JOIN b ON b.subject = probe AND b.stratum = q.stratum JOIN a ON a.subject = candidate AND a.stratum = q.stratum")
    return f"SELECT 'one' AS dataset, * FROM ({one}) UNION ALL SELECT 'two', * FROM ({two})"


@query(_joint_sql())
def joint_protocol(spark: SparkSession, sf: str) -> DataFrame:
    """Eight manifests of two datasets over one cohort, as digests; the protocol digest must bind all ten artifacts."""
    sources = {s: side(spark, sf, s).select("subject", "stratum", "capture") for s in "FOP"}
    built = build_joint_protocol(sources, {"one": ("F", "O"), "two": ("O", "F")}, STRATA, K, VERSION, SEED)
    bound = built["protocol"].filter(digests.is_sha256(F.col("protocol_sha256")) & (F.col("n_artifacts") == 10)).select(F.lit(True).alias("bound"))
    return built["digests"].join(bound, F.col("bound")).drop("bound")


@query("""
SELECT event_id, 'keys' AS rule FROM events WHERE event_id % 17 = 0 UNION ALL SELECT event_id, 'type:k' FROM events WHERE event_id % 19 = 0
UNION ALL SELECT event_id, 'truth:k_is_small' FROM events WHERE event_id % 19 <> 0 AND json_extract_string(props, '$.k')::bigint >= 90
UNION ALL SELECT event_id, 'truth:no_references' FROM events WHERE event_id % 23 = 0
""")
def document_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Exact keys, field types, derived truths and empty reference lists of JSON documents."""
    i = F.col("event_id")
    e = t(spark, sf, "events").select("event_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"))
    k = F.when(i % 19 == 0, F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('"'))).otherwise(F.col("k").cast("string"))
    refs = F.when(i % 23 == 0, '["m"]').otherwise("[]")
    extra = F.when(i % 17 == 0, ', "more": 1').otherwise("")
    e = e.select("event_id", F.concat(F.lit('{"k": '), k, F.lit(', "method_references": '), refs, extra, F.lit("}")).alias("document"))
    small = (F.get_json_object("document", "$.k").try_cast("bigint") < 90) | (i % 19 == 0)
    none = F.get_json_object("document", "$.method_references") == "[]"
    return contract.document_faults(e, "event_id", ["k", "method_references"], {"k": "BIGINT"}, {"k_is_small": small, "no_references": none})


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def allowed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows outside the rule table, which is a filtered run matrix."""
    dims = [spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("o_orderstatus", "FOP"), ("o_orderpriority", STRATA))]
    rules = scoring.run_matrix(dims, F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return contract.allowed_values(t(spark, sf, "orders"), rules, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey")


@query(f"""
WITH a AS (SELECT o_custkey AS subject, o_orderpriority AS stratum FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL HAVING count(*) = 1),
b AS (SELECT o_custkey AS subject, o_orderpriority AS stratum FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL HAVING count(*) = 1),
e AS (SELECT stratum, subject, row_number() OVER (PARTITION BY stratum ORDER BY {HASH_SQL}, subject) AS selection_rank FROM a JOIN b USING (subject, stratum))
SELECT stratum, subject, selection_rank, view, side FROM e, (VALUES ('v1'), ('v2')) v(view), (VALUES ('a'), ('b')) s(side) WHERE selection_rank <= 2
""")
def smoke_cohort(spark: SparkSession, sf: str) -> DataFrame:
    """First two of each stratum for both views and both sides."""
    first = cohort.hash_ranked(genuine(spark, sf).select("stratum", "subject"), VERSION, SEED, k=2).drop("selection_hash")
    views = spark.createDataFrame([("v1",), ("v2",)], "view string")
    sides = spark.createDataFrame([("a",), ("b",)], "side string")
    return scoring.run_matrix([first, views, sides])


@query("""
WITH p AS (SELECT p_partkey, p_retailprice AS x, CASE p_partkey % 4 WHEN 0 THEN p_retailprice::varchar WHEN 1 THEN p_retailprice::varchar || '00' WHEN 2 THEN 'nan' ELSE '' END AS s FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'out_of_range' WHEN 3 THEN 'missing' END AS fault, CASE WHEN p_partkey % 4 < 2 THEN x END AS lenient, p_partkey % 4 = 0 OR p_partkey % 4 = 2 AND FALSE AS canonical,
       regexp_replace(printf('%.2f', x), '\\.?0+$', '') AS exported, CASE WHEN p_partkey % 4 = 3 THEN 'missing' ELSE 'not_integer' END AS integer_fault FROM p
""".replace("\\\\", "\\"))
def number_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Text cells as numbers, and nine-digit exports."""
    k, x = F.col("p_partkey") % 4, F.col("p_retailprice")
    s = F.when(k == 0, x.cast("string")).when(k == 1, F.concat(x.cast("string"), F.lit("00"))).when(k == 2, "nan").otherwise("")
    p = t(spark, sf, "part").withColumn("s", s)
    c = F.col("s")
    return p.select("p_partkey", numbers.strict_number_fault(c).alias("fault"), numbers.lenient_number(c).alias("lenient"), numbers.round_trips(c).alias("canonical"), numbers.nine_digits(x).alias("exported"), numbers.integer_fault(c).alias("integer_fault"))


@query("""
WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rank, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, count(*) FILTER (WHERE rank < 20) AS kept, any_value(CASE WHEN n > 50 THEN 'too_many_points' END) AS error FROM r GROUP BY label
""")
def point_caps(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 points of a label, and a refusal of labels with more than 50."""
    from pyspark.sql import Window

    e = t(spark, sf, "embeddings").select("label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("rank"))
    kept = sampling.capped(e, "rank", 20).groupBy("label").agg(F.count("*").alias("kept"))
    return kept.join(sampling.refused_over(e, ["label"], 50).select("label", "error"), "label", "left")


@query(f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN '0' ELSE '1' END AS version, CASE WHEN vec_id % 10 = 0 THEN 'template' ELSE 'vector' END AS format FROM embeddings)
SELECT vec_id AS capture, CASE WHEN version = '1' AND format = 'vector' THEN NULL ELSE 'payload_not_authorised' END AS error FROM v
""")
def payload_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Stored payloads of another version or format."""
    method = scoring.DotProduct(64)
    k = F.col("capture")
    p = method.prepare(t(spark, sf, "embeddings").select(F.col("vec_id").alias("capture"), F.col("embedding").alias("vector")))
    p = p.withColumns({"method": F.lit("dot"), "version": F.when(k % 6 == 0, "0").otherwise("1"), "format": F.when(k % 10 == 0, "template").otherwise("vector")})
    return scoring.authorised(p, method).select("capture", "error")


@query("""
WITH x AS (SELECT vec_id AS capture, unnest(range(64))::int AS x, unnest(embedding) AS response FROM embeddings)
SELECT capture, rank::int AS rank, x, round(response::double, 6) AS response FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY response DESC, x) - 1 AS rank FROM x) WHERE rank < 3
""")
def detector_points(spark: SparkSession, sf: str) -> DataFrame:
    """A detector plug-in, here the three largest dimensions of a vector as ranked points."""

    def detect(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            v = np.array(b["content"].tolist(), dtype=np.float32).reshape(len(b), -1)
            top = np.argsort(-v, axis=1, kind="stable")[:, :3]
            rows = np.repeat(np.arange(len(b)), top.shape[1])
            yield pd.DataFrame({"capture": b["capture"].to_numpy()[rows], "rank": np.tile(np.arange(top.shape[1]), len(b)), "x": top.reshape(-1), "response": v[rows, top.reshape(-1)].astype(float)})

    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("capture"), F.col("embedding").alias("content"))
    return scoring.detect(e, detect, "capture bigint, rank int, x int, response double").withColumn("response", F.round("response", 6))


@query()
def table_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two tables and a missing folder; names and digests depend on the store, so there is no SQL."""
    found = scan.scan_all(spark, {"d": {"documents": f"{sf}/documents.parquet", "orders": f"{sf}/orders.parquet", "absent": f"{sf}/no_such_table"}}, "*.parquet")
    sums = digests.file_digests(spark, f"{sf}/supplier.parquet").agg(F.count_if(~digests.is_sha256(F.col("sha256"))).alias("bad_digests"))
    n = found.groupBy("dataset", "side").agg(F.count_if(F.col("error_message").isNull()).alias("files"), F.max("error_message").alias("error_message"))
    return n.crossJoin(sums)


@query("SELECT event_id::varchar AS event_id, props, event_type || chr(10) || 'x' AS note FROM events")
def text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Cells as text, with quotes and newlines inside."""
    e = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), "props", F.concat("event_type", F.lit("\n"), F.lit("x")).alias("note"))
    path = scratch(spark)
    publish.write_csv(records.declared(e, ["event_id", "props", "note"]), path, ["event_id"])
    return readers.text_csv(spark, path, ["event_id", "props", "note"])


@query("SELECT s_suppkey AS id, s_nationkey AS n, 'supplier' AS tag, TRUE AS bound FROM supplier UNION ALL SELECT c_custkey, c_nationkey, 'customer', TRUE FROM customer")
def tagged_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Several manifests in one read, each row with its file's tag and digest."""
    base = scratch(spark)
    for name, key, nation in (("supplier", "s_suppkey", "s_nationkey"), ("customer", "c_custkey", "c_nationkey")):
        publish.write_csv(t(spark, sf, name).select(F.col(key).alias("id"), F.col(nation).alias("n")), f"{base}/{name}", ["id"])
    rows = scan.load_tagged(spark, [f"{base}/supplier", f"{base}/customer"], "id bigint, n int", "/([a-z]+)/[^/]*$", digests=True)
    return rows.select("id", "n", "tag", digests.is_sha256(F.col("sha256")).alias("bound"))


@query("""
SELECT event_id, 'value' AS field, value::varchar AS expected, (value + 1)::varchar AS actual FROM events WHERE event_id % 31 = 0
UNION ALL SELECT event_id, 'props', '{"k":' || json_extract_string(props, '$.k') || '}', '{"k":' || (json_extract_string(props, '$.k')::bigint + 1)::varchar || '}' FROM events WHERE event_id % 37 = 0
""")
def outcome_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of two runs whose JSON also differs in volatile fields."""
    e = t(spark, sf, "events").select("event_id", "event_type", "value", "props")
    i = F.col("event_id")
    k = F.from_json("props", "map<string,bigint>")["k"]
    k = F.when(i % 37 == 0, k + 1).otherwise(k)
    again = e.withColumns({"value": F.when(i % 31 == 0, F.col("value") + 1).otherwise(F.col("value")), "props": F.format_string('{"compare_ms": 3.5, "k": %d, "pid": 7}', k)})
    one, two = (parity.outcome(x, ["event_id"], ["event_type", "value"], ["props"]) for x in (e, again))
    return parity.row_diff(one, two, ["event_id"], ["event_type", "value", "props"])


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 29 = 0 THEN 'missing_id' WHEN p_partkey % 31 = 0 THEN 'repeated_id' WHEN p_partkey % 37 = 0 THEN 'wrong_order' END AS rule
FROM part WHERE p_partkey % 29 = 0 OR p_partkey % 31 = 0 OR p_partkey % 37 = 0
UNION ALL SELECT -p_partkey - 1, 'extra_id' FROM part WHERE p_partkey % 41 = 0
""")
def order_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A result table against its manifest's ids and order, with planted faults."""
    k = F.col("p_partkey")
    m = t(spark, sf, "part").select(k.alias("id"), k.alias("o"))
    r = m.filter("id % 29 <> 0")
    r = r.withColumn("o", F.when((F.col("id") % 31 != 0) & (F.col("id") % 37 == 0), F.col("o") + 1).otherwise(F.col("o")))
    r = r.unionByName(r.filter("id % 31 = 0")).unionByName(m.filter("id % 41 = 0").select((-F.col("id") - 1).alias("id"), "o"))
    return contract.order_faults(r, m, "id", "o")


@query(f"""
WITH {A_SQL}, {B_SQL}, {GENUINE_SQL}
SELECT subject, stratum, 'a' AS side FROM g WHERE capture_a % 53 = 0 UNION ALL SELECT subject + 1000000000, stratum, 'b' FROM g WHERE capture_a % 53 = 0
""")
def manifest_rederived(spark: SparkSession, sf: str) -> DataFrame:
    """A stored manifest's identities against those that the captures imply."""
    both = side(spark, sf, "F").withColumn("s", F.lit("F")).unionByName(side(spark, sf, "O").withColumn("s", F.lit("O")))
    fresh = pairs.rederived_pairs(both, F.col("s") == "F", F.col("s") == "O", ["subject", "stratum"], ["capture"])
    moved = F.when(F.col("capture_a") % 53 == 0, F.col("subject") + 1000000000).otherwise(F.col("subject"))
    stored = genuine(spark, sf).select(moved.alias("subject"), "stratum")
    return pairs.set_differences(fresh.select("subject", "stratum"), stored)


@query("""
SELECT o_orderkey, lpad(o_custkey::varchar, 8, '0') AS subject_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS level FROM orders
""")
def code_names(spark: SparkSession, sf: str) -> DataFrame:
    """padded ids and canonical names of aliases."""
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", keys.zero_padded(F.col("o_custkey"), 8).alias("subject_id"), keys.alias_of(F.col("o_orderpriority"), {"1-urgent": "high", "2-high": "high", "5-low": "low"}).alias("level"))


@query(f"""
WITH {ELIGIBLE_COHORT_SQL}, n AS (SELECT stratum, count(*) AS n FROM {LAST} GROUP BY stratum),
v AS (SELECT 'bijection' AS c, count(*) FILTER (WHERE n = 1) AS v FROM n UNION ALL SELECT 'ranks', count(*) FILTER (WHERE n <> {K}) FROM n
      UNION ALL SELECT 'same_identities', count(*) FROM {LAST} WHERE subject % 7 = 3 UNION ALL SELECT 'unique_ids', 4 * count(*) FROM {LAST} WHERE subject % 5 = 2 AND subject % 7 <> 3
      UNION ALL SELECT 'self_sides', 2 * count(*) + 2 * count(*) FILTER (subject % 5 = 2 AND subject % 7 <> 3) FROM {LAST} WHERE subject % 3 = 1 UNION ALL SELECT 'no_result_dependency', 1)
SELECT c AS "check", v AS violations, v = 0 AS holds FROM v
""")
def protocol_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The checks of a whole protocol whose stored manifest lost pairs, repeats ids and has other sides."""
    sources = {s: side(spark, sf, s).select("subject", "stratum", "capture") for s in "FOP"}
    built = build_protocol(sources, "F", "O", STRATA, K, VERSION, SEED, "tpch")
    m, i = built["manifest"], F.col("subject")
    m = m.withColumn("capture_b", F.when((i % 3 == 1) & F.col("pair_kind").startswith("self"), -F.col("capture_b")).otherwise(F.col("capture_b")))
    m = m.filter(~((i % 7 == 3) & (F.col("pair_kind") == "genuine")))
    m = m.unionByName(m.filter((i % 5 == 2) & (i % 7 != 3)))
    known = built["protocol"].withColumn("method_references", F.array(F.lit("method-1")))
    return protocol_checks_of(built["selected"], built["pairing"], m, K, known)


@query(f"""
WITH {ELIGIBLE_COHORT_SQL}, n AS (SELECT stratum, count(*) AS n FROM {LAST} GROUP BY stratum),
v AS (SELECT 'bijection' AS c, count(*) FILTER (WHERE n = 1) AS v FROM n UNION ALL SELECT 'ranks', count(*) FILTER (WHERE n <> {K}) FROM n
      UNION ALL SELECT unnest(['same_identities', 'unique_ids', 'self_sides', 'no_result_dependency', 'same_protocol']), 0)
SELECT c AS "check", v AS violations, v = 0 AS holds, TRUE AS bound, 6::bigint AS n_artifacts FROM v
""")
def protocol_holds(spark: SparkSession, sf: str) -> DataFrame:
    """The checks of a protocol as built, bound by its digest, which a second build repeats and another seed changes."""
    sources = {s: side(spark, sf, s).select("subject", "stratum", "capture") for s in "FOP"}
    one, two, other = (build_protocol(sources, "F", "O", STRATA, K, VERSION, seed, "tpch") for seed in (SEED, SEED, SEED + "x"))
    sha = lambda b: b["protocol"].select("protocol_sha256", "n_artifacts")
    found = sha(one).join(sha(two), ["protocol_sha256", "n_artifacts"]).join(sha(other).select("protocol_sha256"), "protocol_sha256", "left_anti")
    bound = found.select(digests.is_sha256(F.col("protocol_sha256")).alias("bound"), "n_artifacts")
    same = contract.flags(same_protocol=sha(one).exceptAll(found.select("protocol_sha256", "n_artifacts")))
    return one["checks"].unionByName(same).crossJoin(bound)  # one row


@query("""
WITH o AS (SELECT 'base/' || o_orderstatus AS artifact, o_orderkey AS i FROM orders WHERE o_orderstatus <> 'P'), d AS (SELECT * FROM o WHERE i % 3 = 0),
f AS (SELECT artifact, 'empty:path_b' AS rule, count(*) AS n FROM o WHERE i % 101 = 0 GROUP BY artifact
UNION ALL SELECT artifact, 'repeated_id', count(*) FROM o WHERE i % 97 = 0 GROUP BY artifact
UNION ALL SELECT 'base/O', 'digest_mismatch', 1 UNION ALL SELECT 'base/gone', 'extra_artifact', 1 UNION ALL SELECT 'base/F', 'outside_root', 1
UNION ALL SELECT replace(artifact, 'base', 'derived'), 'outside_root', count(*) FROM d WHERE i % 53 = 0 GROUP BY ALL
UNION ALL SELECT replace(artifact, 'base', 'derived'), 'missing_file', count(*) FILTER (WHERE i % 53 = 0 OR i % 59 = 0) FROM d GROUP BY ALL
UNION ALL SELECT replace(artifact, 'base', 'derived'), 'not_in_base', count(*) FILTER (WHERE i % 53 = 0) FROM d GROUP BY ALL
UNION ALL SELECT replace(artifact, 'base', 'derived'), 'empty_path', count(*) FROM d WHERE i % 101 = 0 GROUP BY ALL)
SELECT artifact, rule, n AS violations FROM f WHERE n > 0
""")
def dataset_preflight(spark: SparkSession, sf: str) -> DataFrame:
    """Base manifests, their stored digests and all derived paths against the files there are, with planted faults."""
    i = F.col("o_orderkey")
    o = t(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(i, F.concat(F.lit("base/"), "o_orderstatus").alias("artifact"))
    path = lambda side: F.concat(F.lit("/data/"), "artifact", F.lit(f"/{side}"), i.cast("string"), F.lit(".png"))
    base = o.select("artifact", i, i.cast("string").alias("pair_id"), path("a").alias("path_a"), F.when(i % 101 != 0, path("b")).alias("path_b"))
    base = base.unionByName(base.filter(i % 97 == 0).withColumn("path_b", path("b")))
    sums = digests.ordered_digest(base.dropDuplicates(["artifact", "o_orderkey"]), "o_orderkey", ["pair_id", "path_a"], ["artifact"]).select("artifact", F.col("digest").alias("sha256"))
    held = sums.withColumns({"sha256": F.when(F.col("artifact") == "base/O", F.sha2("sha256", 256)).otherwise(F.col("sha256")), "path": F.concat(F.when(F.col("artifact") == "base/F", "/elsewhere/").otherwise("/data/"), "artifact")})
    held = held.unionByName(spark.createDataFrame([("base/gone", "0" * 64, "/data/base/gone")], "artifact string, sha256 string, path string"))
    derived = base.filter((i % 3 == 0)).dropDuplicates(["artifact", "o_orderkey"]).select(i, F.replace("artifact", F.lit("base"), F.lit("derived")).alias("artifact"), "pair_id", F.when(i % 53 == 0, "/data/../x.png").otherwise(F.col("path_a")).alias("path_a"), F.when(i % 101 != 0, path("b")).alias("path_b"))
    files = o.select(F.explode(F.array(F.when(i % 59 != 0, path("a")), path("b"))).alias("path")).filter("path IS NOT NULL")
    return dataset_preflight_of(base, held, sums, derived.drop("o_orderkey"), files, "/data", ["path_a", "path_b"])


@query("""
SELECT label, vec_id, rank::int AS rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY floor(embedding[1] * 4), floor(embedding[2] * 4), vec_id % 2, vec_id % 3, vec_id) - 1 AS rank FROM embeddings) WHERE vec_id <= 99
ORDER BY vec_id LIMIT 100
""")
def ordered_points(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks by five keys, and the first hundred rows."""
    e = t(spark, sf, "embeddings")
    part = lambda i: F.floor(F.col("embedding")[i] * 4)
    p = e.select("label", "vec_id", part(0).alias("y"), part(1).alias("x"), (F.col("vec_id") % 2).alias("type"), (F.col("vec_id") % 3).alias("direction"), F.col("vec_id").alias("idx"))
    return sampling.first_rows(sampling.ranked_points(p, ["label"]).select("label", "vec_id", "rank"), ["vec_id"], 100)


@query()
def feature_scores(spark: SparkSession, sf: str) -> DataFrame:
    """K8: even against odd vectors of a point set as features; the fit is iterative, so there is no SQL."""
    v = t(spark, sf, "embeddings").select(point_set(), F.col("vec_id").alias("idx"), F.col("embedding").alias("v"), (F.col("embedding")[0] * 100.0).alias("x"), (F.col("embedding")[1] * 100.0).alias("y"))
    out = score_features(v.filter("idx % 2 = 0"), v.filter("idx % 2 = 1"), "label", 0.98)
    return out.withColumn("raw_score", F.round("raw_score", 6))
