"""Queries over scored pairs, curves, matching, contracts and parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, geometry, jsonmaps, numbers, scores, vectors
from ..operators import affine, aggregates, contract, documents, matching, orientation, parity, sampling, scoring, screening
from .jobs import screening_report
from .records_queries import t

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- scored pairs: each vector with the next one of its label

PAIRS_SQL = """
v AS (SELECT vec_id, label, embedding::double[] AS e, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
s AS (SELECT a.label, a.vec_id AS capture_a, b.vec_id AS capture_b,
      CASE WHEN a.vec_id % 50 = 0 THEN 'prepare_a_failure' WHEN b.vec_id % 50 = 0 THEN 'prepare_b_failure' ELSE 'ok' END AS status,
      CASE WHEN a.vec_id % 50 <> 0 AND b.vec_id % 50 <> 0 THEN list_dot_product(a.e, b.e) END AS raw_score,
      CASE WHEN a.vec_id % 50 = 0 OR b.vec_id % 50 = 0 THEN 'refused' END AS error_code
      FROM v a JOIN v b ON a.nxt = b.vec_id)
"""


def next_pairs(v: DataFrame) -> DataFrame:
    """(label, capture_a, capture_b): each vector and the next of its label, by ranks taken in ranges."""
    ranked = sampling.ranked_in_groups(v.select("label", "vec_id"), ["label"], ["vec_id"], "r")
    after = ranked.select("label", F.col("vec_id").alias("capture_b"), (F.col("r") - 1).alias("r"))
    return ranked.withColumnRenamed("vec_id", "capture_a").join(after, ["label", "r"]).select("label", "capture_a", "capture_b")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    v = t(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    pairs = next_pairs(v)
    captures = v.select(F.col("vec_id").alias("capture"), F.col("embedding").alias("vector"))
    return scoring.run_pairs(pairs, captures, scoring.DotProduct(64, refuse=F.col("capture") % 50 == 0), {"method": "dot", "method_version": "1"})


@query(f"WITH {PAIRS_SQL} SELECT label, capture_a, capture_b, status, round(raw_score, 6) AS raw_score, error_code, 'dot' AS method, '1' AS method_version FROM s")
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """X1-X3, X6, F15."""
    return scored(spark, sf).withColumn("raw_score", F.round("raw_score", 6)).select("label", "capture_a", "capture_b", "status", "raw_score", "error_code", "method", "method_version")


_HALF = "list_transform({x}[{a}:{b}], lambda z: z / sqrt(list_sum(list_transform({x}[{a}:{b}], lambda q: q * q))))"


@query(f"""
WITH {PAIRS_SQL}
SELECT a.vec_id AS capture_a, b.vec_id AS capture_b,
       round(list_dot_product({_HALF.format(x='a.e', a=1, b=32)}, {_HALF.format(x='b.e', a=1, b=32)}) + list_dot_product({_HALF.format(x='a.e', a=33, b=64)}, {_HALF.format(x='b.e', a=33, b=64)}), 6) AS raw_score
FROM v a JOIN v b ON a.nxt = b.vec_id
""")
def two_branch_score(spark: SparkSession, sf: str) -> DataFrame:
    """A second adapter of the same job."""
    v = t(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    pairs = next_pairs(v).drop("label")
    out = scoring.run_pairs(pairs, v.select(F.col("vec_id").alias("capture"), F.col("embedding").alias("vector")), scoring.DotProduct(64, halves=True))
    return out.select("capture_a", "capture_b", F.round("raw_score", 6).alias("raw_score"))


@query("""
WITH a AS (SELECT vec_id, embedding::double[] AS e, list_sum(list_transform(embedding::double[], lambda x: abs(x))) AS l1 FROM embeddings)
SELECT vec_id, unnest(range(64))::int AS dim, round(unnest(list_transform(e, lambda x: sqrt(abs(x) / l1))), 6) AS value FROM a
""")
def rootsift(spark: SparkSession, sf: str) -> DataFrame:
    """F15, F16."""
    v = t(spark, sf, "embeddings").filter(vectors.vector_fault(F.col("embedding"), 64).isNull())
    return v.select("vec_id", F.posexplode(vectors.root_normalised(F.col("embedding"))).alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(f"""
WITH {PAIRS_SQL}, h AS (SELECT label, string_agg(error_code || ':' || n, ',' ORDER BY error_code) AS failure_codes FROM (SELECT label, error_code, count(*) AS n FROM s WHERE error_code IS NOT NULL GROUP BY ALL) GROUP BY label)
SELECT s.label, count(*) AS requested_rows, count(*) FILTER (WHERE status = 'ok') AS successful_rows,
       count(*) FILTER (WHERE status IN ('prepare_a_failure', 'prepare_b_failure')) AS prepare_failures, count(*) FILTER (WHERE status = 'comparison_failure') AS comparison_failures,
       count(raw_score) AS score_n, round(min(raw_score), 6) AS score_min, round(quantile_cont(raw_score, 0.25), 6) AS score_p25, round(quantile_cont(raw_score, 0.5), 6) AS score_p50,
       round(quantile_cont(raw_score, 0.75), 6) AS score_p75, round(max(raw_score), 6) AS score_max, round(avg(raw_score), 6) AS score_mean,
       round(median(raw_score), 6) AS score_median, round(quantile_disc(raw_score, 0.95), 6) AS score_p95, any_value(failure_codes) AS failure_codes
FROM s LEFT JOIN h ON s.label = h.label GROUP BY s.label
""")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A10-A15, A30."""
    s = scored(spark, sf)
    x = F.col("raw_score")
    found = aggregates.five_numbers(s, ["label"], {"score": x}, {"median": 0.5}, {"p95": 0.95}, ("n", "min", "max", "mean"))
    out = s.groupBy("label").agg(*aggregates.failure_counts(F.col("status"))).join(found, "label")
    out = out.join(aggregates.histogram_text(s, ["label"], "error_code", "failure_codes"), "label", "left")
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("score_") and c != "score_n" else c for c in out.columns])


@query("""
WITH e AS (SELECT event_type, value, try_cast(json_extract_string(props, '$.k') AS double) AS k FROM events)
SELECT event_type, count(*) AS rows, count(k) AS k_n, min(k) AS k_min, quantile_cont(k, 0.25) AS k_p25, quantile_cont(k, 0.5) AS k_p50, quantile_cont(k, 0.75) AS k_p75, max(k) AS k_max,
       round(avg(CASE WHEN k IS NULL THEN value ELSE (k + value) / 2 END), 6) AS mean_available,
       count(*) FILTER (WHERE value < 0) AS out_of_range
FROM e GROUP BY event_type
""")
def json_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """F5-F8, A14, A29."""
    e = t(spark, sf, "events").withColumn("k", numbers.json_number(numbers.json_object(F.col("props")), "$.k"))
    fault = numbers.strict_number_fault(F.col("value").cast("string"), nonnegative=True)
    mean = aggregates.mean_of_available(F.col("k"), numbers.lenient_number(F.col("value").cast("string")))
    out = e.withColumns({"fault": fault, "m": mean})
    plain = out.groupBy("event_type").agg(F.count("*").alias("rows"), F.round(F.avg("m"), 6).alias("mean_available"), F.count_if(F.col("fault") == "out_of_range").alias("out_of_range"))
    return plain.join(aggregates.five_numbers(out, ["event_type"], {"k": F.col("k")}), "event_type")


_NESTED = ("CASE WHEN user_id % 2 = 0 THEN 'a.b[0].more=\"x\";' ELSE '' END", "'a.b[0].c.d=' || user_id || ';'")


@query(f"""
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, user_id FROM events)
SELECT event_id, '{{"big":' || (9007199254740993 + event_id) || ',"k":' || k || ',"s":"' || k || '"}}' AS stable,
       '["c.d"]=1;["x.pid"]=7;' || {_NESTED[1]} || {_NESTED[0]} || 'a.u=' || user_id || ';big=' || (9007199254740993 + event_id) || ';c.d=2;e={{}};k=' || k || ';l=[];t={{}};y=true;z="true"' AS leaves FROM e
""")
def drop_volatile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with planted volatile keys, flat and five levels deep, inside an array; keys with dots,
    empty containers, integers beyond 2^53, and values that differ in type only."""
    big = F.lit(9007199254740993) + F.col("event_id")
    e = t(spark, sf, "events").select("event_id", "user_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"), big.alias("big"))
    flat = F.to_json(F.struct(F.col("k").cast("string").alias("s"), "k", "big", F.col("event_id").alias("detector_time_ms"), F.col("user_id").alias("pid")))
    deep = F.struct(F.struct(F.col("user_id").alias("d"), F.lit(2.5).alias("deep_ms")).alias("c"), F.when(F.col("user_id") % 2 == 0, "x").alias("more"))  # null fields are left out
    inner = F.struct(F.array(deep).alias("b"), F.col("user_id").alias("u"), F.lit(1.5).alias("wall_ms"))
    nested = F.to_json(F.struct("k", "big", inner.alias("a"), F.lit("now").alias("timestamp"), F.lit(7).alias("x.pid"), F.lit(1).alias("c.d"), F.struct(F.lit(2).alias("d")).alias("c"), F.lit(True).alias("y"), F.lit("true").alias("z")))
    nested = F.concat(F.lit('{"e": {}, "l": [], "t": {"run_ms": 3, "pid": 4}, '), F.substring(nested, 2, 1 << 20))
    e = e.select("event_id", flat.alias("flat"), nested.alias("nested"))
    found = documents.leaves(e, ["event_id"], "nested")
    text = F.concat_ws("=", documents.path_text(F.col("path")), "value")
    leaves = found.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("leaves"))
    return e.select("event_id", jsonmaps.sorted_json(jsonmaps.stable_map(F.col("flat"))).alias("stable")).join(leaves, "event_id")


# ---- screening: score n_chars, genuine is quality 1, group lang

SCREEN_SQL = """
l AS (SELECT doc_id, lang, n_chars::double AS score, quality = 1 AS genuine, doc_id % 29 <> 0 AS ok FROM documents JOIN labels USING (doc_id)),
r AS (SELECT lang, score, genuine, ok FROM l UNION ALL SELECT 'genuine only', score, genuine, ok FROM l WHERE genuine UNION ALL SELECT 'all failed', score, genuine, FALSE FROM l),
h AS (SELECT lang, score, count(*) FILTER (WHERE genuine) AS g, count(*) FILTER (WHERE NOT genuine) AS i FROM r WHERE ok GROUP BY ALL),
n AS (SELECT lang, sum(g) AS ng, sum(i) AS ni, max(score) AS top FROM h GROUP BY lang HAVING sum(g) > 0 AND sum(i) > 0),
c AS (SELECT lang, score AS threshold, (sum(i) OVER w / ni)::double AS far, (sum(g) OVER w / ng)::double AS tar FROM h JOIN n USING (lang) WINDOW w AS (PARTITION BY lang ORDER BY score DESC)
      UNION ALL SELECT lang, nextafter(top, 'infinity'::double), 0, 0 FROM n)
"""


def screened(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    rows = d.join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    rows = rows.select("lang", "score", (F.col("quality") == 1).alias("genuine"), (F.col("doc_id") % 29 != 0).alias("ok"))
    refused = [rows.filter("genuine").withColumn("lang", F.lit("genuine only")), rows.withColumns({"lang": F.lit("all failed"), "ok": F.lit(False)})]
    return rows.unionByName(refused[0]).unionByName(refused[1])


@query(f"WITH {SCREEN_SQL} SELECT lang, threshold, round(far, 9) AS far, round(tar, 9) AS tar FROM c")
def screening_roc(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship query."""
    hist = screening.score_histogram(screened(spark, sf).filter("ok"), ["lang"], "score", F.col("genuine"))
    return screening.roc(hist, ["lang"]).select("lang", "threshold", F.round("far", 9).alias("far"), F.round("tar", 9).alias("tar"))


@query(f"""
WITH {SCREEN_SQL},
a AS (SELECT lang, sum(g * (lower + 0.5 * i)) / (sum(g) * sum(i)) AS auc FROM (SELECT *, coalesce(sum(i) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM h) GROUP BY lang),
e AS (SELECT lang, (far + 1 - tar) / 2 AS eer, threshold AS eer_threshold FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY abs(far - (1.0 - tar)), threshold DESC) AS k FROM c) WHERE k = 1),
b AS (SELECT lang, tar AS tar_at_far, far AS actual_far, threshold AS far_threshold FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tar DESC, far DESC, threshold) AS k FROM c WHERE far <= 0.01) WHERE k = 1),
o AS (SELECT lang, count(*) FILTER (WHERE genuine) AS genuine_requested, count(*) FILTER (WHERE genuine AND ok) AS genuine_successful, count(*) FILTER (WHERE NOT genuine) AS impostor_requested,
      count(*) FILTER (WHERE NOT genuine AND ok) AS impostor_successful, count(*) FILTER (WHERE genuine AND ok AND score >= far_threshold) / count(*) FILTER (WHERE genuine) AS operational_tar,
      CASE WHEN count(*) FILTER (WHERE NOT genuine) > 0 THEN count(*) FILTER (WHERE NOT genuine AND ok AND score >= far_threshold) / count(*) FILTER (WHERE NOT genuine) END AS operational_far FROM r LEFT JOIN b USING (lang) GROUP BY lang),
q AS (SELECT lang, CASE WHEN genuine_successful = 0 THEN 'no_successful_genuine_score' WHEN impostor_successful = 0 THEN 'no_successful_impostor_score' END AS reason FROM o)
SELECT lang, round(auc, 9)::double AS auc, round(eer, 9)::double AS eer, eer_threshold, round(tar_at_far, 9)::double AS tar_at_far, round(actual_far, 9)::double AS actual_far, far_threshold,
       genuine_requested, genuine_successful, impostor_requested, impostor_successful, CASE WHEN reason IS NULL THEN round(operational_tar, 9)::double END AS operational_tar, CASE WHEN reason IS NULL THEN round(operational_far, 9)::double END AS operational_far, reason
FROM o JOIN q USING (lang) LEFT JOIN (SELECT a.* FROM a JOIN n USING (lang)) a USING (lang) LEFT JOIN e USING (lang) LEFT JOIN b USING (lang)
""")
def screening_summary(spark: SparkSession, sf: str) -> DataFrame:
    """With a group of genuine rows alone and one where all failed, which keep their counts and a reason."""
    out = screening.screened_summary(screened(spark, sf), ["lang"], "score", F.col("genuine"), F.col("ok"))
    exact = {"lang", "eer_threshold", "far_threshold", "genuine_requested", "genuine_successful", "impostor_requested", "impostor_successful", "reason"}
    return out.select(*[c if c in exact else F.round(c, 9).alias(c) for c in out.columns])


# ---- two views of one key: first and second half of the time span

VIEWS_SQL = """
x AS (SELECT user_id, event_type, value, ts < TIMESTAMP '2024-01-16' AS first FROM events),
k AS (SELECT DISTINCT user_id, event_type FROM events),
w AS (SELECT user_id, event_type, first, count(*) AS n, avg(value) AS m FROM x GROUP BY ALL),
j AS (SELECT k.event_type, CASE WHEN coalesce(a.n, 0) >= 5 THEN 'ok' ELSE 'comparison_failure' END AS sa, CASE WHEN coalesce(b.n, 0) >= 5 THEN 'ok' ELSE 'comparison_failure' END AS sb, a.m AS ma, b.m AS mb
      FROM k LEFT JOIN w a ON k.user_id = a.user_id AND k.event_type = a.event_type AND a.first LEFT JOIN w b ON k.user_id = b.user_id AND k.event_type = b.event_type AND NOT b.first)
"""


@query(f"""
WITH {VIEWS_SQL}, d AS (SELECT event_type, mb - ma AS d, ma, mb FROM j WHERE sa = 'ok' AND sb = 'ok'),
p AS (SELECT event_type, string_agg(tr || ':' || n, ',' ORDER BY tr) AS transitions FROM (SELECT event_type, sa || '->' || sb AS tr, count(*) AS n FROM j GROUP BY ALL) GROUP BY event_type)
SELECT event_type, count(d) AS n, round(median(d), 6) AS median_delta, round(median(abs(d)), 6) AS median_abs_delta, round(avg(d), 6) AS mean_delta, round(corr(ma, mb), 6) AS pearson, any_value(transitions) AS transitions
FROM d JOIN p USING (event_type) GROUP BY event_type
""")
def paired_views(spark: SparkSession, sf: str) -> DataFrame:
    """J11, A16, A17, A18, J12."""
    e = t(spark, sf, "events").select("user_id", "event_type", "value", (F.col("ts") < F.expr("TIMESTAMP '2024-01-16'")).alias("first"))
    first, second = F.col("first"), ~F.col("first")
    mean = lambda p: F.avg(F.when(p, F.col("value")))
    status = lambda p: F.when(F.count_if(p) >= 5, "ok").otherwise("comparison_failure")
    # both views come from one table, so one aggregation is the full outer join of the views
    j = e.groupBy("user_id", "event_type").agg(status(first).alias("sa"), status(second).alias("sb"), mean(first).alias("ma"), mean(second).alias("mb"))
    both = j.filter("sa = 'ok' AND sb = 'ok'").withColumn("d", F.col("mb") - F.col("ma"))
    deltas = aggregates.delta_summary(both, ["event_type"], {"d": F.col("d")})
    deltas = deltas.select("event_type", F.col("d_n").alias("n"), *[F.col(f"d_{c}").alias(c) for c in ("median_delta", "median_abs_delta", "mean_delta")])
    moves = aggregates.histogram_text(j.withColumn("move", F.concat_ws("->", "sa", "sb")), ["event_type"], "move", "transitions")
    out = deltas.join(aggregates.pearson(both, "ma", "mb", ["event_type"], 6), "event_type").join(moves, "event_type")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median_delta", "median_abs_delta", "mean_delta")], "pearson", "transitions")


# ---- contract

def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows with planted faults, one kind for each residue."""
    s = scored(spark, sf)
    k = F.col("capture_a")
    ok, ran_b, ran_c = F.col("status") == "ok", F.col("status") != "prepare_a_failure", F.col("status") == "ok"
    when = lambda p, x: F.when(p, x)
    return s.select(
        k.alias("pair_id"),
        when(k % 31 == 3, F.lit("done")).otherwise(F.col("status")).alias("status"),
        when(k % 37 != 5, F.col("raw_score")).alias("raw_score"),
        when((k % 41 == 7) | (F.col("error_code").isNotNull() & (k % 100 != 0)), F.lit("refused")).alias("error_code"),
        when(F.col("error_code").isNotNull(), F.lit("refused by rule")).alias("error_message"),
        when(k % 43 == 9, F.lit(-1.0)).otherwise(F.lit(2.0)).alias("prepare_a_ms"),
        when(ran_b | (k % 50 == 0), F.lit(3.0)).alias("prepare_b_ms"),
        when(ran_c, F.lit(4.0)).alias("compare_ms"),
        F.lit(1.5).alias("method_prepare_a_ms"),
        when(ran_b, F.lit(1.5)).alias("method_prepare_b_ms"),
        when(ran_c, F.lit(1.5)).alias("method_compare_ms"),
        when(k % 47 == 11, F.lit(8.5)).when(k % 47 == 12, F.lit(3.5)).otherwise(F.lit(9.0)).alias("total_ms"),
        when(k % 53 == 13, F.lit("[1]")).otherwise(F.lit('{"n": 1}')).alias("prepare_a_diagnostics"),
        when(ran_b, F.lit('{"n": 1}')).alias("prepare_b_diagnostics"),
        when(ok, when(k % 59 == 15, F.lit("{bad")).otherwise(F.lit('{"n": 1}'))).alias("compare_diagnostics"),
    )


@query(f"""
WITH {PAIRS_SQL}, r AS (
  SELECT capture_a AS k, CASE WHEN capture_a % 31 = 3 THEN 'done' ELSE status END AS st, status AS st0, CASE WHEN capture_a % 37 <> 5 THEN raw_score END AS sc,
         capture_a % 41 = 7 OR (error_code IS NOT NULL AND capture_a % 100 <> 0) AS code, error_code IS NOT NULL AS msg FROM s
), f AS (
  SELECT k, 'unknown_status' AS rule FROM r WHERE st = 'done'
  UNION ALL SELECT k, 'ok_without_score' FROM r WHERE st = 'ok' AND sc IS NULL
  UNION ALL SELECT k, 'ok_with_error' FROM r WHERE st = 'ok' AND (code OR msg)
  UNION ALL SELECT k, 'failure_with_score' FROM r WHERE st <> 'ok' AND sc IS NOT NULL
  UNION ALL SELECT k, 'failure_without_error' FROM r WHERE st <> 'ok' AND NOT (code AND msg)
  UNION ALL SELECT k, 'prepare_b_after_failure' FROM r WHERE st = 'prepare_a_failure'
  UNION ALL SELECT k, 'compare_after_failure' FROM r WHERE st = 'done' AND st0 = 'ok'
  UNION ALL SELECT k, 'prepare_a_bad_time' FROM r WHERE k % 43 = 9
  UNION ALL SELECT k, 'prepare_b_bad_time' FROM r WHERE st = 'done' AND st0 = 'prepare_a_failure' AND k % 50 <> 0
  UNION ALL SELECT k, 'prepare_a_bad_diagnostics' FROM r WHERE k % 53 = 13
  UNION ALL SELECT k, 'prepare_b_bad_diagnostics' FROM r WHERE st = 'done' AND st0 = 'prepare_a_failure'
  UNION ALL SELECT k, 'compare_bad_diagnostics' FROM r WHERE st = 'ok' AND k % 59 = 15
  UNION ALL SELECT k, 'total_below_part' FROM r WHERE k % 47 = 12 AND st0 = 'ok'
  UNION ALL SELECT k, 'total_below_sum' FROM r WHERE st = 'ok' AND ((k % 47 = 11 AND k % 43 <> 9) OR k % 47 = 12)
) SELECT k AS pair_id, rule FROM f
""")
def contract_rules(spark: SparkSession, sf: str) -> DataFrame:
    """V2-V6: every broken rule of every row."""
    return contract.row_faults(result_rows(spark, sf), "pair_id")


PART_FIELDS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("""
WITH f AS (SELECT p_partkey, p_brand AS b0, p_size AS s0, CASE WHEN p_partkey % 11 = 0 THEN 'Brand#0' ELSE p_brand END AS b1, CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS s1 FROM part)
SELECT p_partkey, 'p_brand' AS field, b0 AS frozen, b1 AS current, 'changed' AS kind FROM f WHERE b0 <> b1 AND p_partkey % 17 <> 0 AND p_partkey % 19 <> 0
UNION ALL SELECT p_partkey, 'p_size', s0::varchar, s1::varchar, 'changed' FROM f WHERE s0 <> s1 AND p_partkey % 17 <> 0 AND p_partkey % 19 <> 0
UNION ALL SELECT p_partkey, 'p_type', NULL, p_type, 'added' FROM part WHERE p_partkey % 17 = 0 AND p_partkey % 19 <> 0
UNION ALL SELECT p_partkey, 'p_type', p_type, NULL, 'removed' FROM part WHERE p_partkey % 19 = 0 AND p_partkey % 17 <> 0
UNION ALL SELECT p_partkey, 'p_brand', b0, b1, 'changed' FROM f WHERE b0 <> b1 AND (p_partkey % 17 = 0 OR p_partkey % 19 = 0)
UNION ALL SELECT p_partkey, 'p_size', s0::varchar, s1::varchar, 'changed' FROM f WHERE s0 <> s1 AND (p_partkey % 17 = 0 OR p_partkey % 19 = 0)
""")
def config_drift(spark: SparkSession, sf: str) -> DataFrame:
    """V10, V12."""
    p = t(spark, sf, "part")
    k = F.col("p_partkey")
    altered = p.withColumns({"p_brand": F.when(k % 11 == 0, "Brand#0").otherwise(F.col("p_brand")), "p_size": F.when(k % 13 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))})
    frozen = contract.unpivoted(p, ["p_partkey"], PART_FIELDS).filter(~((k % 17 == 0) & (F.col("field") == "p_type")))
    current = contract.unpivoted(altered, ["p_partkey"], PART_FIELDS).filter(~((k % 19 == 0) & (F.col("field") == "p_type")))
    return contract.drift(frozen, current, ["p_partkey"]).select("p_partkey", "field", "frozen", "current", "kind")


# ---- parity

CLASSES = {"positive": "quality = 1", "zero": "quality = 0", "failure": "quality IS NULL", "toxic": "toxic = 1", "long": "n_chars >= 10000", "never": "n_chars < 0"}
ORDERED_SQL = "d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS o, doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), st AS (SELECT i * (SELECT count(*) FROM d) // 10 AS o, 'stride_' || i AS reason FROM range(10) r(i))"


def ordered_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels"), "doc_id", "left")
    return sampling.with_ordinals(d, "doc_id")


@query(f"""
WITH {ORDERED_SQL}, x AS (SELECT * FROM st
{" ".join(f"UNION ALL SELECT min(o), '{n}' FROM d WHERE {p} HAVING count(*) > 0" for n, p in CLASSES.items())}
UNION ALL SELECT o, 'highest_score' FROM (SELECT o FROM d ORDER BY n_chars DESC, o DESC LIMIT 1))
SELECT o AS ordinal, string_agg(reason, ',' ORDER BY reason) AS reasons FROM x GROUP BY o
""")
def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    """W6, W7, W9."""
    d = ordered_documents(spark, sf)
    classes = {n: F.expr(p) for n, p in CLASSES.items()}
    return sampling.all_reasons(sampling.stride_ordinals(d), sampling.first_of_classes(d, classes), sampling.highest(d, "n_chars"))


@query(f"""
WITH {ORDERED_SQL}
{" UNION ALL ".join(f"SELECT min(o) AS ordinal, '{n}' AS reason FROM d WHERE {p} AND NOT EXISTS (SELECT 1 FROM d JOIN st USING (o) WHERE {p}) HAVING count(*) > 0" for n, p in CLASSES.items())}
""")
def missed_class_sample(spark: SparkSession, sf: str) -> DataFrame:
    """W8."""
    d = ordered_documents(spark, sf)
    return sampling.missed_classes(d, sampling.stride_ordinals(d), {n: F.expr(p) for n, p in CLASSES.items()}).select("ordinal", "reason")


CASES = {"positive": "quality = 1", "second_positive": "quality = 1", "zero": "quality = 0", "toxic": "toxic = 1", "long": "n_chars >= 5000"}


def _cases_sql() -> str:
    ctes, before = [ORDERED_SQL], "SELECT -1"
    for i, (n, p) in enumerate(CASES.items()):
        ctes.append(f"k{i} AS (SELECT '{n}' AS case_name, min(o) AS ordinal FROM d WHERE {p} AND o NOT IN ({before}))")
        before += f" UNION ALL SELECT ordinal FROM k{i}"
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(CASES)))


@query(_cases_sql())
def distinct_cases(spark: SparkSession, sf: str) -> DataFrame:
    """W10."""
    return sampling.distinct_cases(ordered_documents(spark, sf), {n: F.expr(p) for n, p in CASES.items()})


DIFF_SQL = """
a AS (SELECT doc_id, lang, CASE WHEN doc_id % 101 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, CASE WHEN doc_id % 202 = 0 THEN NULL ELSE source END AS source FROM documents WHERE doc_id % 303 <> 3),
f AS (SELECT d.doc_id, 'row' AS field, 'present' AS expected, 'absent' AS actual FROM documents d ANTI JOIN a USING (doc_id)
      UNION ALL SELECT d.doc_id, 'n_chars', d.n_chars::varchar, a.n_chars::varchar FROM documents d JOIN a USING (doc_id) WHERE d.n_chars IS DISTINCT FROM a.n_chars
      UNION ALL SELECT d.doc_id, 'source', d.source, a.source FROM documents d JOIN a USING (doc_id) WHERE d.source IS DISTINCT FROM a.source)
"""


def altered_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    k = F.col("doc_id")
    return d, d.filter(k % 303 != 3).withColumns({"n_chars": F.when(k % 101 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")), "source": F.when(k % 202 != 0, F.col("source"))})


@query(f"WITH {DIFF_SQL} SELECT * FROM f")
def row_diff(spark: SparkSession, sf: str) -> DataFrame:
    """D1, J14."""
    return parity.row_diff(*altered_documents(spark, sf), ["doc_id"], ["lang", "source", "n_chars"])


@query(f"""
WITH {DIFF_SQL}
SELECT doc_id, field, expected, actual, 'oracle_a' AS comparison FROM f WHERE field <> 'source'
""")
def three_way_parity(spark: SparkSession, sf: str) -> DataFrame:
    """D3: `source` is declared to differ; the second run repeats the first."""
    d, a = altered_documents(spark, sf)
    return parity.three_way(d, a, a, ["doc_id"], ["lang", "source", "n_chars"], declared=["source"])


@query(f"""
WITH {DIFF_SQL}, b AS (SELECT DISTINCT doc_id, TRUE AS bad FROM f)
SELECT lang, count(*) AS sampled, count(bad) AS mismatching, count(bad) = 0 AND count(*) >= 80 AS passed FROM documents LEFT JOIN b USING (doc_id) GROUP BY lang
""")
def parity_gate(spark: SparkSession, sf: str) -> DataFrame:
    """D4, A22."""
    d, a = altered_documents(spark, sf)
    return parity.gate_report(d, parity.row_diff(d, a, ["doc_id"], ["lang", "source", "n_chars"]), ["doc_id"], ["lang"], 80)


@query("""
WITH b AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 101 <> 0 AND event_id % 103 <> 0)
SELECT event_id, 'k' AS field, k AS expected, (k::bigint + 1)::varchar AS actual FROM b WHERE event_id % 7 = 0
UNION ALL SELECT event_id, 'extra', NULL, 'true' FROM b WHERE event_id % 11 = 0
UNION ALL SELECT event_id, 'event_type', event_type, upper(event_type) FROM b WHERE event_id % 13 = 0
UNION ALL SELECT event_id, 'big', '9007199254740993', '9007199254740992' FROM b WHERE event_id % 17 = 0
UNION ALL SELECT event_id, 'in.t', 'true', '"true"' FROM b WHERE event_id % 19 = 0
UNION ALL SELECT event_id, 'in.s[1]', '"1"', '1' FROM b WHERE event_id % 19 = 0
UNION ALL SELECT event_id, '["in.t"]', '5', '6' FROM b WHERE event_id % 23 = 0
UNION ALL SELECT event_id, 'in.e', '{}', '[]' FROM b WHERE event_id % 29 = 0
UNION ALL SELECT event_id, 'row', 'present', 'absent' FROM events WHERE event_id % 101 = 0 AND event_id % 103 <> 0
UNION ALL SELECT event_id, 'row', 'absent', 'present' FROM events WHERE event_id % 101 <> 0 AND event_id % 103 = 0
""")
def document_diff(spark: SparkSession, sf: str) -> DataFrame:
    """JSON documents with a changed number, an added key, a number in other form, volatile keys, a changed column, rows of one
    side, and, inside nested objects too, other types, integers beyond 2^53, keys with dots and empty containers."""
    e = t(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "map<string,bigint>")["k"].alias("k"))
    i, k = F.col("event_id"), F.col("k")
    number = F.when(i % 7 == 0, (k + 1).cast("string")).when(i % 5 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(i % 3 == 0, F.concat(k.cast("string"), F.lit("e0"))).otherwise(k.cast("string"))
    pick = lambda n, new, old: F.when(i % n == 0, new).otherwise(old)
    kind = F.when(i % 13 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    document = lambda n, big, t, s, dotted, empty, more: F.concat(F.lit('{"in": {"pid": '), i, F.lit(', "t": '), t, F.lit(', "e": '), empty, F.lit(', "s": [{"a_ms": '), i, F.lit("}, "), s, F.lit(']}, "in.t": '), dotted, F.lit(', "big": '), big, F.lit(', "k": '), n, more, F.lit("}"))
    old = document(k.cast("string"), F.lit("9007199254740993"), F.lit("true"), F.lit('"1"'), F.lit("5"), F.lit("{}"), F.lit(""))
    extra = F.when(i % 11 == 0, F.lit(', "extra": true')).otherwise(F.lit(""))
    new = document(number, pick(17, "9007199254740992", "9007199254740993"), pick(19, '"true"', "true"), pick(19, "1", '"1"'), pick(23, "6", "5"), pick(29, "[]", "{}"), F.concat(F.lit(', "wall_ms": 1.25'), extra))
    actual = e.select("event_id", kind.alias("event_type"), new.alias("props"))
    return documents.document_diff(e.filter(i % 103 != 0).withColumn("props", old), actual.filter(i % 101 != 0), ["event_id"], "props", ["event_type"])


@query(f"""
WITH {PAIRS_SQL}, r AS (SELECT capture_a, status, raw_score, i AS run_id FROM s, range(3) r(i))
SELECT capture_a AS case_id, run_id, run_id = 0 OR NOT (run_id = 2 AND capture_a % 23 = 4 AND status = 'ok') AS identical FROM r
""")
def repeat_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs, the last with planted differences."""
    s = scored(spark, sf).select(F.col("capture_a").alias("case_id"), "status", "raw_score")
    runs = s.withColumn("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    runs = runs.withColumn("raw_score", F.when((F.col("run_id") == 2) & (F.col("case_id") % 23 == 4), F.col("raw_score") + 0.5).otherwise(F.col("raw_score")))
    return parity.repeatability(runs, "case_id", "run_id", ["status", "raw_score"])


@query("""
WITH r AS (SELECT vec_id, embedding AS a, CASE WHEN vec_id % 17 = 3 THEN list_reverse(embedding) WHEN vec_id % 19 = 4 THEN embedding[1:63] ELSE embedding END AS b FROM embeddings)
SELECT vec_id, a = b AS digest_equal, len(a) = len(b) AS payload_equal, a = b AS gate FROM r
""")
def repeat_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of repeated extractions of one item."""
    v = t(spark, sf, "embeddings").select("vec_id", "embedding").withColumn("repeat_id", F.explode(F.array(F.lit(1), F.lit(2))))
    changed = (F.col("repeat_id") == 2) & (F.col("vec_id") % 17 == 3)
    shorter = (F.col("repeat_id") == 2) & (F.col("vec_id") % 19 == 4)
    v = v.withColumn("embedding", F.when(changed, F.reverse("embedding")).when(shorter, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    v = v.withColumn("digest", vectors.array_digest({"v": F.col("embedding")}))
    return parity.repeat_flags(v.withColumn("payload", F.size("embedding")), "vec_id", "repeat_id", ["digest"], ["payload"])


# ---- matching kernels: even against odd vectors of a point set, which is a label's part of a thousand consecutive ids

RATIO = 0.98
KNN_SQL = f"""
p AS (SELECT (vec_id // 1000) * 100 + label AS label, vec_id AS id, embedding::double[] AS e, vec_id % 2 = 0 AS even FROM embeddings),
d AS (SELECT a.label, a.id AS ia, b.id AS ib, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d FROM p a JOIN p b ON a.label = b.label AND a.even AND NOT b.even),
f AS (SELECT label, ia, max(ib) FILTER (WHERE r = 1) AS ib, max(d) FILTER (WHERE r = 1) AS d1, max(d) FILTER (WHERE r = 2) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY label, ia ORDER BY d, ib) AS r FROM d) GROUP BY label, ia),
b AS (SELECT label, ib, max(ia) FILTER (WHERE r = 1) AS ia, max(d) FILTER (WHERE r = 1) AS d1, max(d) FILTER (WHERE r = 2) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY label, ib ORDER BY d, ia) AS r FROM d) GROUP BY label, ib),
fk AS (SELECT label, ia, ib, d1, d2 FROM f WHERE d2 IS NOT NULL AND d1 < {RATIO} * d2),
bk AS (SELECT label, ia, ib, d1, d2 FROM b WHERE d2 IS NOT NULL AND d1 < {RATIO} * d2),
mu AS (SELECT fk.* FROM fk SEMI JOIN bk USING (label, ia, ib)),
un AS (SELECT label, ia, ib, min(d1) AS d1, arg_min(d2, struct_pack(a := d1, b := d2)) AS d2 FROM (SELECT * FROM fk UNION ALL SELECT * FROM bk) GROUP BY label, ia, ib)
"""


def point_set() -> F.col:
    """The point set of a vector: its label and its thousand of ids, so sets have about a hundred points in a table of any size."""
    return (F.floor(F.col("vec_id") / 1000) * 100 + F.col("label")).cast("bigint").alias("label")


def knn_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = t(spark, sf, "embeddings").select(point_set(), F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))
    return v.filter("idx % 2 = 0"), v.filter("idx % 2 = 1")


@query(f"WITH {KNN_SQL} SELECT label, ia, ib, round(d1, 6) AS d1, round(d2, 6) AS d2, d2 IS NOT NULL AND d1 < {RATIO} * d2 AS kept FROM f")
def knn_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """J15, W17."""
    two = matching.two_nearest(*knn_sides(spark, sf), ["label"], 9)
    kept = F.coalesce(F.col("d1") < F.lit(RATIO) * F.col("d2"), F.lit(False))
    return two.select("label", "ia", "ib", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"), kept.alias("kept"))


@query("""
WITH p AS (SELECT vec_id, embedding[1:4]::double[] AS e FROM embeddings),
d AS (SELECT a.vec_id AS ia, b.vec_id AS ib, round(list_distance(a.e, b.e), 9) AS d FROM p a JOIN p b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY ia ORDER BY d, ib) AS k FROM d)
SELECT ia, max(ib) FILTER (k = 1) AS ib, round(max(d) FILTER (k = 1), 6) AS d1, round(max(d) FILTER (k = 2), 6) AS d2 FROM r WHERE k <= 2 GROUP BY ia
""")
def knn_large_set(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table as one point set, by pivots: every even vector's two nearest odd ones in four dimensions."""
    v = t(spark, sf, "embeddings").select(F.lit(0).alias("all"), F.col("vec_id").alias("idx"), F.slice("embedding", 1, 4).cast("array<double>").alias("v"))
    two = matching.two_nearest(v.filter("idx % 2 = 0"), v.filter("idx % 2 = 1"), ["all"], 9, few=64)
    return two.select("ia", "ib", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query(f"""
WITH {KNN_SQL}, m AS (SELECT 'one_way' AS mode, * FROM fk UNION ALL SELECT 'mutual', * FROM mu UNION ALL SELECT 'bidirectional_union', * FROM un)
SELECT mode, label, ia, ib, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM m
""")
def mutual_union(spark: SparkSession, sf: str) -> DataFrame:
    """J16, U5, K1."""
    m = matching.match(matching.both_ways(*knn_sides(spark, sf), ["label"], 9), ["label"], RATIO)
    return m.select("mode", "label", "ia", "ib", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query(f"""
WITH {KNN_SQL}, n AS (SELECT label, count(*) FILTER (WHERE even) AS na, count(*) FILTER (WHERE NOT even) AS nb FROM p GROUP BY label),
c AS (SELECT n.label, na, nb, (SELECT count(*) FROM fk WHERE fk.label = n.label) AS m, (SELECT count(*) FROM mu WHERE mu.label = n.label) AS i FROM n)
SELECT label, m AS matches, i AS inliers, i::double AS geometric_inlier_count, round(CASE WHEN m > 0 THEN i / m ELSE 0 END, 6) AS geometric_inlier_ratio,
       round(i / greatest(1, least(na, nb)), 6) AS inliers_over_min_keypoints, round(CASE WHEN i > 0 AND m > 0 THEN i * (i / m) * ln(1 + m) ELSE 0 END, 6) AS composite,
       round(CASE WHEN label % 3 = 0 THEN i::double WHEN label % 3 = 1 THEN CASE WHEN m > 0 THEN i / m ELSE 0 END END, 6) AS score, CASE WHEN label % 3 = 2 THEN 'unsupported_score_mode' END AS error
FROM c
""")
def score_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual matches as inliers of the one-way matches."""
    two = matching.both_ways(*knn_sides(spark, sf), ["label"], 9)
    counts = matching.match_counts(two, matching.match(two, ["label"], RATIO), ["label"], RATIO)
    c = counts.withColumn("parts", scores.score_components(F.col("mutual"), F.col("ratio_a_to_b"), F.col("knn_a_to_b"), F.col("knn_b_to_a")))
    mode = F.when(F.col("label") % 3 == 0, scores.COUNT).when(F.col("label") % 3 == 1, scores.RATIO).otherwise("unknown")
    c = c.withColumn("s", scores.score_of_mode(F.col("parts"), mode))
    part = lambda n: F.round(F.col("parts")[n], 6)
    return c.select(
        "label", F.col("ratio_a_to_b").alias("matches"), F.col("mutual").alias("inliers"), part(scores.COUNT).alias("geometric_inlier_count"), part(scores.RATIO).alias("geometric_inlier_ratio"),
        part(scores.OVER_MIN).alias("inliers_over_min_keypoints"), part(scores.COMPOSITE).alias("composite"), F.round("s.score", 6).alias("score"), F.col("s.error").alias("error"),
    )


@query("""
SELECT p_partkey, round(p_size * p_retailprice / 1000, 6) AS support, round(p_size * 25.4 / p_retailprice, 6) AS mm, round((p_size + 0.5) * 500 / p_retailprice - 0.5, 6) AS centre,
       CASE WHEN p_retailprice < 100 THEN 'dpi_out_of_range' WHEN p_retailprice > 950 THEN 'dpi_out_of_range' END AS dpi_fault,
       round(p_size * (1000 / p_retailprice), 6) AS reference_x, round(sqrt(abs(p_size * p_size + 2.0)), 6) AS scale, round(degrees(atan2(1.0, p_size)), 6) AS rotation_degrees, p_size < 40 AS inside
FROM part
""")
def geometry_scale(spark: SparkSession, sf: str) -> DataFrame:
    """F11-F14, F19, F22, K2."""
    p = t(spark, sf, "part")
    size, ppi = F.col("p_size").cast("double"), F.col("p_retailprice")
    parts = geometry.decomposition(size, F.lit(-2.0), F.lit(1.0), size)
    r = lambda c: F.round(c, 6)
    return p.select(
        "p_partkey", r(geometry.support_size(size, ppi, 1000)).alias("support"), r(geometry.pixels_to_mm(size, ppi)).alias("mm"), r(geometry.pixel_centre(size, ppi, F.lit(500.0))).alias("centre"),
        geometry.dpi_fault(ppi, 100, 950).alias("dpi_fault"), r(geometry.to_reference(size, ppi, 1000)).alias("reference_x"), r(parts["scale"]).alias("scale"), r(parts["rotation_degrees"]).alias("rotation_degrees"),
        geometry.inside(size, F.lit(1.0), F.lit(40.0), F.lit(2.0)).alias("inside"),
    )


@query("""
WITH p AS (SELECT (vec_id // 1000) * 100 + label AS pair, vec_id % 7 = 0 AS off FROM embeddings)
SELECT pair, count(*) AS matches, count(*) FILTER (WHERE NOT off) AS inliers, count(*) FILTER (WHERE off) AS outliers, round(count(*) FILTER (WHERE NOT off) / count(*), 6) AS inlier_ratio, NULL::varchar AS reason,
       1.25::double AS scale, round(CASE WHEN (pair % 100) * 10.0 > 180 THEN (pair % 100) * 10.0 - 360 ELSE (pair % 100) * 10.0 END, 6)::double AS rotation_degrees, 40.0::double AS tx, -15.0::double AS ty, TRUE AS close
FROM p GROUP BY pair
""")
def robust_affine(spark: SparkSession, sf: str) -> DataFrame:
    """Per point set, points of the first two dimensions under a known transform, every seventh an outlier, so the answer is known in closed form."""
    v = t(spark, sf, "embeddings").select(point_set().alias("pair"), F.col("vec_id").alias("idx"), (F.col("embedding")[0] * 1000.0).alias("x"), (F.col("embedding")[1] * 1000.0).alias("y"))
    angle = F.radians((F.col("pair") % 100) * 10.0)
    u = 1.25 * (F.cos(angle) * F.col("x") - F.sin(angle) * F.col("y")) + 40 + F.when(F.col("idx") % 7 == 0, 500.0).otherwise(0.0)
    w = 1.25 * (F.sin(angle) * F.col("x") + F.cos(angle) * F.col("y")) - 15
    out = affine.robust_affine(v.withColumns({"u": u, "v": w}))
    r = lambda c, n=6: (F.round(c, n) + 0.0).alias(c)
    return out.select("pair", "matches", "inliers", "outliers", r("inlier_ratio"), "reason", r("scale"), r("rotation_degrees"), r("tx", 4), r("ty", 4), (F.col("residual_max") < 1e-6).alias("close"))


@query("""
WITH s AS (SELECT vec_id, label, i // 2 AS k, embedding[i + 1]::double AS gx, embedding[i + 2]::double AS gy FROM embeddings, range(0, 64, 2) r(i)),
q AS (SELECT vec_id, ((floor(((degrees(atan2(gy, gx)) % 360 + 360) % 360) * 36 / 360))::int % 36) AS bin, round(sum(exp(-((k % 8 - 4) * (k % 8 - 4) + (k // 8 - 2) * (k // 8 - 2)) / (2 * 1.5 * 1.5)) * sqrt(gx * gx + gy * gy)), 9) AS w
      FROM s WHERE (k % 8 - 4) * (k % 8 - 4) + (k // 8 - 2) * (k // 8 - 2) <= 25 AND gx * gx + gy * gy > 0 GROUP BY ALL),
b AS (SELECT vec_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, bin) AS r FROM q) WHERE r = 1)
SELECT vec_id, bin, bin * 10.0::double AS angle FROM b
""")
def dominant_bin(spark: SparkSession, sf: str) -> DataFrame:
    """K6, K7: dimension pairs as gradients on an 8 × 4 grid, one point a vector."""
    v = t(spark, sf, "embeddings").select("vec_id", "embedding")
    s = v.select("vec_id", F.posexplode("embedding").alias("i", "g")).select("vec_id", F.expr("i div 2").alias("k"), F.when(F.col("i") % 2 == 0, F.col("g")).alias("gx"), F.when(F.col("i") % 2 == 1, F.col("g")).alias("gy"))
    s = s.groupBy("vec_id", "k").agg(F.max("gx").alias("gx"), F.max("gy").alias("gy")).select("vec_id", (F.col("k") % 8).alias("x"), F.expr("k div 8").alias("y"), "gx", "gy")
    points = v.select("vec_id", F.lit(0).alias("pid"), F.lit(0).alias("rank"), F.lit(4).alias("x"), F.lit(2).alias("y"))
    out = orientation.oriented(points, s, ["vec_id"], "rank", 1, F.lit(2.0))
    return out.select("vec_id", "bin", "angle")


# ---- digests

@query("""
WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS o, lang, sha256(concat_ws(chr(31), doc_id::varchar, lang, source, n_chars::varchar)) AS h FROM documents),
b AS (SELECT o // 100 AS bucket, sha256(string_agg(h, chr(10) ORDER BY o)) AS h, count(*) AS n FROM r GROUP BY ALL),
b2 AS (SELECT bucket // 100 AS bucket, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS h, sum(n) AS n, count(*) AS b FROM b GROUP BY bucket // 100),
b3 AS (SELECT bucket // 100 AS bucket, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS h, sum(n) AS n, sum(b) AS b FROM b2 GROUP BY bucket // 100)
SELECT sum(n)::bigint AS n_rows, sum(b)::bigint AS n_buckets, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS digest FROM b3
""")
def row_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Order-exact digest that ignores the partitioning."""
    d = sampling.with_ordinals(t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return digests.ordered_digest(d, "ordinal", ["doc_id", "lang", "source", "n_chars"], bucket_rows=100)


@query("""
WITH c AS (SELECT p_partkey, p_type, sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || p_size || '}') AS config_hash FROM part)
SELECT p_type, count(*) AS n_files, sha256('[' || string_agg('{"path":"' || printf('%09d', p_partkey) || '","sha256":"' || config_hash || '"}', ',' ORDER BY p_partkey) || ']') AS digest, bool_and(regexp_full_match(config_hash, '[0-9a-f]{64}')) AS well_formed
FROM c GROUP BY p_type
""")
def config_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of configurations, and of the list of them for each type."""
    p = t(spark, sf, "part")
    p = p.withColumn("sha", digests.config_digest({"size": F.col("p_size"), "key": F.col("p_partkey"), "brand": F.col("p_brand")})).withColumn("path", F.format_string("%09d", "p_partkey"))
    listed = digests.list_digest(p, ["p_type"], "path", "sha")
    return listed.join(p.groupBy("p_type").agg(F.bool_and(digests.is_sha256(F.col("sha"))).alias("well_formed")), "p_type").select("p_type", "n_files", "digest", "well_formed")


@query("SELECT o_orderstatus, CASE WHEN o_custkey % 50 = 3 THEN 'other' ELSE 'c' || o_custkey END AS code, count(*) AS n FROM orders GROUP BY ALL")
def code_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Every code of large vocabularies, with one that is named `other`."""
    o = t(spark, sf, "orders").withColumn("code", F.when(F.col("o_custkey") % 50 == 3, "other").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))))
    return aggregates.code_counts(o, ["o_orderstatus"], "code")


@query("""
SELECT l_returnflag AS file, count(*) AS rows, count(*) FILTER (WHERE l_linestatus = 'F') AS "n_F", count(*) FILTER (WHERE l_linestatus = 'O') AS "n_O",
       min(l_extendedprice) AS score_min, max(l_extendedprice) AS score_max, round(avg(l_extendedprice), 6) AS score_mean, round(median(l_extendedprice), 6) AS score_median,
       median(l_quantity) AS l_quantity_median, quantile_disc(l_quantity, 0.95) AS l_quantity_p95, round(median(l_discount), 6) AS l_discount_median, quantile_disc(l_discount, 0.95) AS l_discount_p95,
       CASE WHEN l_returnflag <> 'N' THEN sha256('result ' || l_returnflag) END AS sha256
FROM lineitem GROUP BY l_returnflag
""")
def file_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Score and timing summaries and digests, one row a file; one file has no digest."""
    li = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("raw_score"), "l_quantity", "l_discount")
    files = li.select("file").distinct().filter("file <> 'N'").withColumn("sha256", F.sha2(F.concat(F.lit("result "), "file"), 256))
    out = aggregates.file_summary(li, "file", ["l_quantity", "l_discount"], ["F", "O"], files)
    return out.withColumns({c: F.round(c, 6) for c in ("score_mean", "score_median", "l_discount_median")})


# ---- the whole report over result rows made from scored documents: two views, two kinds

REPORT_SQL = """
r AS (SELECT lang AS method, CASE WHEN v = 0 THEN 'va' ELSE 'vb' END AS dataset, CASE WHEN quality = 1 THEN 'genuine' ELSE 'impostor' END AS pair_kind, doc_id,
             CASE WHEN (doc_id + v) % 29 = 0 THEN 'prepare_a_failure' ELSE 'ok' END AS status, CASE WHEN (doc_id + v) % 29 <> 0 THEN (n_chars + v * (doc_id % 5))::double END AS s, doc_id % 40 AS m
      FROM documents JOIN labels USING (doc_id), range(2) x(v) WHERE NOT (v = 1 AND doc_id % 31 = 3)),
j AS (SELECT method, pair_kind, a.status AS sa, b.status AS sb, a.s AS x, b.s AS y, coalesce(a.status = 'ok' AND b.status = 'ok', FALSE) AS ok,
             (CASE WHEN a.status = 'ok' THEN a.m ELSE a.m END)::double AS pa, (b.m + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END)::double AS pb
      FROM (SELECT * FROM r WHERE dataset = 'va') a FULL JOIN (SELECT * FROM r WHERE dataset = 'vb') b USING (method, pair_kind, doc_id)),
t AS (SELECT method, pair_kind, string_agg(k || ':' || n, ',' ORDER BY k) AS transitions FROM (SELECT method, pair_kind, coalesce(sa, 'absent') || '->' || coalesce(sb, 'absent') AS k, count(*) AS n FROM j GROUP BY ALL) GROUP BY ALL)
"""


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    d = d.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).filter("NOT (v = 1 AND doc_id % 31 = 3)")
    ok = (F.col("doc_id") + F.col("v")) % 29 != 0
    dataset = F.when(F.col("v") == 0, "va").otherwise("vb")
    shape = lambda c: F.when(ok, c)
    points = F.col("doc_id") % 40 + F.when((F.col("v") == 1) & (F.col("doc_id") % 3 == 0), 2).otherwise(0)  # more points in the second view
    return d.select(
        F.col("lang").alias("method"), dataset.alias("dataset"), F.when(F.col("quality") == 1, "genuine").otherwise("impostor").alias("pair_kind"),
        F.concat_ws("_", dataset, F.col("doc_id").cast("string")).alias("pair_id"), F.when(ok, "ok").otherwise("prepare_a_failure").alias("status"),
        shape((F.col("n_chars") + F.col("v") * (F.col("doc_id") % 5)).cast("double")).alias("raw_score"), F.when(~ok, "unreadable").alias("error_code"),
        F.lit(1.0).alias("prepare_a_ms"), shape(F.lit(2.0)).alias("prepare_b_ms"), shape(F.lit(3.0)).alias("compare_ms"),
        F.format_string('{"detector_point_count": %d, "representation_descriptor_count": 7}', points).alias("prepare_a_diagnostics"),
        shape(F.format_string('{"detector_point_count": %d}', points)).alias("prepare_b_diagnostics"),
        shape(F.format_string('{"mutual_match_count": %d, "score_components": {"inliers_over_min_keypoints": 0.5}}', F.col("doc_id") % 40)).alias("compare_diagnostics"),
    )


def _five_sql(name: str, value: str, where: str) -> str:
    q = lambda f: f"quantile_cont({value}, {f}) FILTER (WHERE {where})::double"
    x = f"({value})::double"
    return f"count({value}) FILTER (WHERE {where}) AS {name}_n, min({x}) FILTER (WHERE {where}) AS {name}_min, {q(0.25)} AS {name}_p25, {q(0.5)} AS {name}_p50, {q(0.75)} AS {name}_p75, max({x}) FILTER (WHERE {where}) AS {name}_max"


def _report_sql() -> str:
    ok = "status = 'ok'"
    points = "m + CASE WHEN r.dataset = 'vb' AND doc_id % 3 = 0 THEN 2 ELSE 0 END"
    one_to_three = "CASE v WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 END"  # times of both sides' preparation
    return f"""
WITH {REPORT_SQL},
p AS (SELECT method, dataset, pair_kind, {_five_sql('preparation_time_ms', one_to_three, 'TRUE')}, {_five_sql('detector_point_count', points, ok)},
             {_five_sql('descriptor_count', 'CASE WHEN v = 1 THEN 7 END', ok)} FROM r, (VALUES (1), (2)) x(v) WHERE v = 1 OR status = 'ok' GROUP BY ALL)
SELECT r.method, r.dataset, r.pair_kind, count(*) AS requested_rows, count(*) FILTER (WHERE {ok}) AS successful_rows, count(*) FILTER (WHERE status <> 'ok') AS prepare_failures, 0::bigint AS comparison_failures,
       {_five_sql('raw_score', 's', ok)}, {_five_sql('comparison_time_ms', '3.0', ok)}, {_five_sql('mutual_matches', 'm', ok)}, {_five_sql('geometric_inliers', 'NULL::double', ok)}, {_five_sql('inlier_ratio', 'NULL::double', ok)},
       {_five_sql('inliers_over_minimum_keypoint_count', '0.5', ok)}, {_five_sql('detector_time_ms', 'NULL::double', ok)},
       any_value(COLUMNS(p.* EXCLUDE (method, dataset, pair_kind))),
       CASE WHEN count(*) > count(s) THEN 'unreadable:' || (count(*) - count(s)) END AS failure_codes
FROM r JOIN p ON r.method = p.method AND r.dataset = p.dataset AND r.pair_kind = p.pair_kind GROUP BY r.method, r.dataset, r.pair_kind
"""


@query(_report_sql())
def report_group_summary(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the summary."""
    return screening_report(report_rows(spark, sf))["group_summary"]


@query(f"""
WITH {REPORT_SQL}
SELECT j.method, j.pair_kind, count(*) AS logical_pairs, count(*) FILTER (WHERE sa IS NULL OR sb IS NULL) AS one_sided, count(*) FILTER (WHERE ok) AS paired_success, count(y - x) FILTER (WHERE ok) AS score_n,
       median(y - x) FILTER (WHERE ok) AS score_median_delta, median(abs(y - x)) FILTER (WHERE ok) AS score_median_abs_delta, round(avg(y - x) FILTER (WHERE ok), 6) AS score_mean_delta,
       median(pb - pa) FILTER (WHERE ok) AS point_count_median_delta, round(avg(pb - pa) FILTER (WHERE ok), 6) AS point_count_mean_delta, count(*) FILTER (WHERE ok) AS descriptor_count_n, any_value(transitions) AS transitions, round(CASE WHEN count(*) FILTER (WHERE ok) >= 2 THEN corr(x, y) FILTER (WHERE ok) END, 6) AS pearson
FROM j JOIN t ON j.method = t.method AND j.pair_kind = t.pair_kind GROUP BY ALL
""")
def report_paired(spark: SparkSession, sf: str) -> DataFrame:
    """View against view on the logical id."""
    p = screening_report(report_rows(spark, sf), view_a="va", view_b="vb")["paired"]
    names = ["logical_pairs", "one_sided", "paired_success", "score_n", "score_median_delta", "score_median_abs_delta"]
    return p.select("method", "pair_kind", *names, F.round("score_mean_delta", 6).alias("score_mean_delta"), "point_count_median_delta", F.round("point_count_mean_delta", 6).alias("point_count_mean_delta"), "descriptor_count_n", "transitions", F.round("pearson", 6).alias("pearson"))
