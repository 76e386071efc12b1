"""Queries over records, pairs and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import logical_key, pair_id, pair_kind, regex_groups, zero_padded
from ..operators import aggregates, cohort, pairs, records, sampling
from .jobs import build_protocol

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


URL = r"(https?)://([a-z.-]+)/([a-z]{2})/(\d+)(?:[?#].*)?"


@query(rf"""
SELECT 'page' AS kind, page_id AS id, CASE WHEN ok THEN regexp_extract(url, '{URL}', 1) END AS scheme,
       CASE WHEN ok THEN regexp_extract(url, '{URL}', 2) END AS host, CASE WHEN ok THEN regexp_extract(url, '{URL}', 3) END AS lang,
       CASE WHEN ok THEN regexp_extract(url, '{URL}', 4)::bigint END AS number, CASE WHEN NOT ok THEN 'bad_name' END AS error_message
FROM (SELECT *, regexp_full_match(url, '{URL}') AS ok FROM pages)
UNION ALL
SELECT 'customer', c_custkey, NULL, NULL, NULL, n, CASE WHEN n IS NULL THEN 'bad_name' WHEN n <> c_custkey THEN 'number_mismatch' END
FROM (SELECT *, CASE WHEN regexp_full_match(c_name, 'Customer#(\d{{9}})') THEN regexp_extract(c_name, '(\d{{9}})', 1)::bigint END AS n FROM customer)
""")
def parse_keys(spark: SparkSession, sf: str) -> DataFrame:
    """P1, P2, F1."""
    names = ["scheme", "host", "lang", "number"]
    p = t(spark, sf, "pages").select("page_id", *regex_groups(F.col("url"), URL, names))
    p = records.with_failure(p, [(F.col("scheme").isNotNull(), "bad_name")])
    p = p.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "scheme", "host", "lang", F.col("number").try_cast("bigint").alias("number"), "error_message")
    c = t(spark, sf, "customer").select("c_custkey", *regex_groups(F.col("c_name"), r"Customer#(\d{9})", ["digits"]))
    c = c.withColumn("number", F.col("digits").try_cast("bigint"))
    c = records.with_failure(c, [(F.col("number").isNotNull(), "bad_name"), (F.col("number") == F.col("c_custkey"), "number_mismatch")])
    none = F.lit(None).cast("string")
    return p.unionByName(c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), none.alias("scheme"), none.alias("host"), none.alias("lang"), "number", "error_message"))


#: (status, priority) → slot; a null slot is valid but holds several captures.
SLOTS = [("F", "1-URGENT", 1), ("F", "2-HIGH", 2), ("F", "3-MEDIUM", None), ("O", "1-URGENT", 1), ("O", "2-HIGH", 2), ("O", "3-MEDIUM", 3), ("O", "4-NOT SPECIFIED", None)]


@query(f"""
WITH dim(o_orderstatus, o_orderpriority, slot) AS (VALUES {", ".join(f"('{a}', '{b}', {'NULL' if c is None else c}::int)" for a, b, c in SLOTS)})
SELECT o_orderkey, o.o_orderstatus, coalesce(l.label, 'unknown_' || o.o_orderstatus) AS label, d.o_orderstatus IS NOT NULL AS is_valid, slot,
       d.o_orderstatus IS NOT NULL AND slot IS NOT NULL AS is_single, d.o_orderstatus IS NOT NULL AND slot IS NULL AS is_multi
FROM orders o LEFT JOIN dim d ON o.o_orderstatus = d.o_orderstatus AND o.o_orderpriority = d.o_orderpriority
LEFT JOIN (VALUES ('F', 'finished'), ('O', 'open')) l(code, label) ON l.code = o.o_orderstatus
""")
def code_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """P3, P4, P5."""
    dim = spark.createDataFrame(SLOTS, "o_orderstatus string, o_orderpriority string, slot int")
    labels = spark.createDataFrame([("F", "finished"), ("O", "open")], "o_orderstatus string, label string")
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    o = records.coded(o, labels, ["o_orderstatus"], "label", F.concat(F.lit("unknown_"), F.col("o_orderstatus")))
    return records.slotted(o, dim, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "o_orderstatus", "label", "is_valid", "slot", "is_single", "is_multi")


ALLOWED = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")


@query(f"""
WITH r AS (
  SELECT 'customer' AS kind, c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'negative_balance' WHEN c_mktsegment NOT IN {ALLOWED} THEN 'segment_not_allowed' END AS e FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, CASE WHEN s_acctbal < 0 THEN 'negative_balance' WHEN s_nationkey >= 20 THEN 'nation_not_allowed' END FROM supplier
), b AS (SELECT *, row_number() OVER (PARTITION BY kind, e ORDER BY id) AS n, count(*) OVER (PARTITION BY kind, e) AS c FROM r WHERE e IS NOT NULL)
SELECT kind, e AS error_message, any_value(c) AS n_errors, string_agg(id::varchar, '; ' ORDER BY n) FILTER (WHERE n <= 5) AS shown, greatest(any_value(c) - 5, 0) AS n_more
FROM b GROUP BY kind, e
""")
def record_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rejects with their first reason, five ids shown of each."""
    c = records.with_failure(t(spark, sf, "customer"), [(F.col("c_acctbal") >= 0, "negative_balance"), (F.col("c_mktsegment").isin(*ALLOWED), "segment_not_allowed")])
    s = records.with_failure(t(spark, sf, "supplier"), [(F.col("s_acctbal") >= 0, "negative_balance"), (F.col("s_nationkey") < 20, "nation_not_allowed")])
    both = c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), "error_message").unionByName(s.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), "error_message"))
    bad = both.filter("error_message IS NOT NULL").withColumn("message", F.col("id").cast("string"))
    return records.error_digest(bad, ["kind", "error_message"], "message", "id").select("kind", "error_message", "n_errors", "shown", "n_more")


LANGS = ("de", "en", "es", "fr", "it")


@query("""
WITH domain AS (SELECT lang, source FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) l(lang), (SELECT 'src' || i AS source FROM range(20) r(i)))
SELECT d.lang, d.source, coalesce(n, 0)::bigint AS n FROM domain d LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) c USING (lang, source)
""")
def domain_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1-A3: counts over a fixed domain with an absent value."""
    langs = spark.createDataFrame([(x,) for x in LANGS], "lang string")
    domain = langs.crossJoin(spark.range(20).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source")))
    return aggregates.zero_filled(t(spark, sf, "documents").select("lang", "source"), domain, ["lang", "source"])


@query("""
SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'total' ELSE o_orderstatus END AS o_orderstatus, count(*) AS rows, count(DISTINCT o_custkey) AS subjects
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())
""")
def dataset_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A4."""
    return aggregates.totals(t(spark, sf, "orders").select("o_orderstatus", "o_custkey"), "o_orderstatus", "o_custkey")


@query("""
WITH k AS (SELECT o_custkey || '/' || o_orderpriority AS key, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'
           ), r AS (SELECT 'orders' AS kind, key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS n, count(*) OVER (PARTITION BY key) AS c FROM k),
x AS (SELECT 'documents' AS kind, sha256(text) AS key, doc_id AS id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY text) AS c FROM documents)
SELECT kind, key, any_value(c) AS n_rows, string_agg(id::varchar, ',' ORDER BY id::varchar) AS samples
FROM (SELECT * FROM r UNION ALL SELECT * FROM x) WHERE c > 1 AND n <= 3 GROUP BY kind, key
""")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Identities and texts that occur more than once."""
    o = t(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("key"), F.col("o_orderkey").alias("id"))
    d = t(spark, sf, "documents").select(F.sha2("text", 256).alias("key"), F.col("doc_id").alias("id"))
    named = lambda df, kind: records.duplicate_keys(df, ["key"], "id").select(F.lit(kind).alias("kind"), "key", "n_rows", "samples")
    return named(o, "orders").unionByName(named(d, "documents"))


# Identity stand-in: subject o_custkey, stratum o_orderpriority, side by o_orderstatus.
KEYS = ["subject", "stratum"]


def side(spark: SparkSession, sf: str, status: str) -> DataFrame:
    o = t(spark, sf, "orders").filter(F.col("o_orderstatus") == status)
    return o.select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("stratum"), F.col("o_orderkey").alias("capture"), F.col("o_totalprice").alias("price"))


def once(spark: SparkSession, sf: str, status: str) -> DataFrame:
    return pairs.once_only(side(spark, sf, status), KEYS, ["capture", "price"])


SIDE_SQL = """
{n} AS (SELECT o_custkey AS subject, o_orderpriority AS stratum, min(o_orderkey) AS capture, min(o_totalprice) AS price
        FROM orders WHERE o_orderstatus = '{s}' GROUP BY ALL HAVING count(*) = 1)
"""
A_SQL, B_SQL, P_SQL = (SIDE_SQL.format(n=n, s=s) for n, s in (("a", "F"), ("b", "O"), ("p", "P")))
SLOT_SQL = "substring(stratum, 1, 1)::int"
PAIR_ID_SQL = f"printf('%s_%s_%s_%02d', 'tpch', '{{p}}', lpad(subject::varchar, 8, '0'), {SLOT_SQL})"


def slot() -> F.col:
    return F.substring("stratum", 1, 1).cast("int")


def named(protocol: str, dataset: str = "tpch") -> F.col:
    return pair_id(F.lit(dataset), F.lit(protocol), zero_padded(F.col("subject"), 8), slot())


@query(f"""
WITH {A_SQL} SELECT {PAIR_ID_SQL.format(p='self')} AS pair_id, subject, stratum, capture AS capture_a, capture AS capture_b FROM a
""")
def self_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """J1, P10, P13."""
    made = pairs.self_pairs(once(spark, sf, "F"), KEYS, ["capture"])
    made = made.filter(records.side_rule(F.col("capture_a"), F.col("capture_b"), same=True))
    return made.select(named("self").alias("pair_id"), *KEYS, "capture_a", "capture_b")


GENUINE_SQL = "g AS (SELECT subject, stratum, a.capture AS capture_a, a.price AS price_a, b.capture AS capture_b, b.price AS price_b FROM a JOIN b USING (subject, stratum))"


def genuine(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.genuine_pairs(once(spark, sf, "F"), once(spark, sf, "O"), KEYS, ["capture", "price"])


@query(f"""
WITH {A_SQL}, {B_SQL}, {GENUINE_SQL}
SELECT {PAIR_ID_SQL.format(p='genuine')} AS pair_id, subject, stratum, capture_a, capture_b, row_number() OVER (PARTITION BY stratum ORDER BY subject) AS pair_ordinal
FROM g WHERE capture_a <> capture_b
""")
def genuine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """J2, O1, P6, P10."""
    made = genuine(spark, sf).filter(records.side_rule(F.col("capture_a"), F.col("capture_b"), same=False))
    made = sampling.ranked_in_groups(made, ["stratum"], ["subject"], "pair_ordinal", 1)
    return made.select(named("genuine").alias("pair_id"), *KEYS, "capture_a", "capture_b", "pair_ordinal")


@query("""
WITH s AS (SELECT o_custkey AS subject, o_orderpriority AS stratum, max((o_orderstatus = 'F')::int) AS a, max((o_orderstatus = 'O')::int) AS b
           FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL)
SELECT stratum, count(*) AS identities, count(*) FILTER (WHERE a = 1 AND b = 1) AS both, count(*) FILTER (WHERE b = 0) AS a_only, count(*) FILTER (WHERE a = 0) AS b_only FROM s GROUP BY stratum
""")
def identity_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """J3, U1, U3, A8, A9."""
    return pairs.reconcile_report(pairs.reconcile(side(spark, sf, "F"), side(spark, sf, "O"), KEYS), ["stratum"])


@query(f"""
WITH {A_SQL}, {B_SQL}, {GENUINE_SQL}, m AS (
  SELECT subject, stratum, CASE WHEN capture_a % 97 = 0 THEN capture_b WHEN capture_a % 89 = 0 THEN capture_a + 1 ELSE capture_a END AS ma,
         CASE WHEN capture_a % 97 = 0 THEN capture_a WHEN capture_b % 83 = 0 THEN capture_b + 1 ELSE capture_b END AS mb FROM g WHERE capture_b % 101 <> 0
)
SELECT subject, stratum, CASE WHEN ma IS NULL THEN 'missing' WHEN ma = capture_a AND mb = capture_b THEN 'consistent' WHEN ma = capture_b AND mb = capture_a THEN 'swapped'
       WHEN ma <> capture_a THEN 'a_mismatch' ELSE 'b_mismatch' END AS verdict
FROM g LEFT JOIN m USING (subject, stratum)
""")
def source_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """A stored manifest with planted faults against its re-derivation."""
    g = genuine(spark, sf)
    a, b = F.col("capture_a"), F.col("capture_b")
    stored = g.filter(b % 101 != 0).select(
        *KEYS,
        F.when(a % 97 == 0, b).when(a % 89 == 0, a + 1).otherwise(a).alias("capture_a"),
        F.when(a % 97 == 0, a).when(b % 83 == 0, b + 1).otherwise(b).alias("capture_b"),
    )
    return pairs.consistency(stored, g, KEYS, ["capture"]).select(*KEYS, "verdict")


ELIGIBLE_SQL = f"{A_SQL}, {B_SQL}, {P_SQL}, e AS (SELECT subject, stratum FROM a JOIN b USING (subject, stratum) JOIN p USING (subject, stratum) WHERE a.price > 0 AND b.price > 0 AND p.price > 0)"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    sources = {s: side(spark, sf, s) for s in "FOP"}
    return pairs.eligible(sources, KEYS, F.col("price") > 0)


@query(f"WITH {ELIGIBLE_SQL} SELECT subject, stratum FROM e")
def eligible_n_source(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly once in each of three sources."""
    return candidates(spark, sf).select(*KEYS)


VERSION, SEED, STRATA = "cohort_v1", "20240601", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
HASH_SQL = f"sha256(concat_ws(chr(10), '{VERSION}', '{SEED}', stratum, subject::varchar))"


@query(f"""
WITH {A_SQL}, {B_SQL}, e AS (SELECT subject, stratum FROM a JOIN b USING (subject, stratum))
SELECT stratum, subject, {HASH_SQL} AS selection_hash, row_number() OVER (PARTITION BY stratum ORDER BY {HASH_SQL}, subject) AS selection_rank FROM e
""")
def hash_rank(spark: SparkSession, sf: str) -> DataFrame:
    """W1, F3."""
    e = genuine(spark, sf).select("stratum", "subject")
    return cohort.hash_ranked(e, VERSION, SEED)


#: Cohort size of a stratum.
K = 10


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.select_cohort(genuine(spark, sf).select("stratum", "subject"), STRATA, K, VERSION, SEED)


def _cohort_sql() -> str:
    ctes = [A_SQL, B_SQL, "e AS (SELECT subject, stratum FROM a JOIN b USING (subject, stratum))", f"h AS (SELECT *, {HASH_SQL} AS selection_hash FROM e)", "c0 AS (SELECT stratum, subject, selection_hash, 0::bigint AS selection_rank FROM h LIMIT 0)"]
    for i, s in enumerate(STRATA, 1):
        ctes.append(f"""c{i} AS (SELECT * FROM c{i - 1} UNION ALL SELECT * FROM (
            SELECT stratum, subject, selection_hash, row_number() OVER (ORDER BY selection_hash, subject) AS selection_rank FROM h
            WHERE stratum = '{s}' AND subject NOT IN (SELECT subject FROM c{i - 1})) WHERE selection_rank <= {K})""")
    return ",\n".join(ctes)


COHORT_SQL = _cohort_sql()
LAST = f"c{len(STRATA)}"


@query(f"WITH {COHORT_SQL} SELECT * FROM {LAST}")
def cohort_select(spark: SparkSession, sf: str) -> DataFrame:
    """W2, J9, W5, A21."""
    return chosen(spark, sf)


PAIRING_SQL = f"""
q AS (SELECT stratum, subject AS probe, selection_rank AS rank_probe,
      coalesce(lead(subject) OVER w, first_value(subject) OVER w) AS candidate, coalesce(lead(selection_rank) OVER w, first_value(selection_rank) OVER w) AS rank_candidate
      FROM {LAST} WINDOW w AS (PARTITION BY stratum ORDER BY selection_rank))
"""


@query(f"""
WITH {COHORT_SQL}, {PAIRING_SQL}
SELECT q.stratum, probe, candidate, rank_probe, rank_candidate, a.capture AS capture_a, b.capture AS capture_b
FROM q JOIN a ON a.subject = probe AND a.stratum = q.stratum JOIN b ON b.subject = candidate AND b.stratum = q.stratum
""")
def impostor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """W3, J8."""
    pairing = cohort.circular_pairs(chosen(spark, sf))
    made = pairs.impostor_manifest(pairing, once(spark, sf, "F"), once(spark, sf, "O"), "stratum", ["capture"])
    return made.select("stratum", "probe", "candidate", "rank_probe", "rank_candidate", "capture_a", "capture_b")


@query(f"""
WITH {COHORT_SQL}, {PAIRING_SQL},
x AS (SELECT stratum, probe AS s, 1 AS p, 0 AS c FROM q UNION ALL SELECT stratum, candidate, 0, 1 FROM q),
y AS (SELECT stratum, s, sum(p) AS p, sum(c) AS c FROM x GROUP BY ALL),
z AS (SELECT stratum, count(*) FILTER (WHERE p > 0) AS probes, count(*) FILTER (WHERE c > 0) AS candidates, count(*) FILTER (WHERE c > 0 AND p = 0) AS outside,
      bool_and(p = 1 AND c = 1) AS balanced FROM y GROUP BY stratum)
SELECT z.stratum, probes, candidates, outside, pairs, self_pairs, balanced AND self_pairs = 0 AND outside = 0 AS is_bijection, ranks_exact
FROM z JOIN (SELECT stratum, count(*) AS pairs, count(*) FILTER (WHERE probe = candidate) AS self_pairs FROM q GROUP BY stratum) USING (stratum)
JOIN (SELECT stratum, min(selection_rank) = 1 AND max(selection_rank) = {K} AND count(DISTINCT selection_rank) = {K} AND count(*) = {K} AS ranks_exact FROM {LAST} GROUP BY stratum) USING (stratum)
""")
def cohort_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Bijection and rank checks of the cohort."""
    c = chosen(spark, sf)
    report = cohort.bijection_report(cohort.circular_pairs(c)).drop("unbalanced")
    return report.join(cohort.cohort_faults(c, K).select("stratum", "ranks_exact"), "stratum")


@query(f"""
WITH {COHORT_SQL}, {GENUINE_SQL}, m AS (SELECT {PAIR_ID_SQL.format(p='cohort_genuine')} AS pair_id, stratum, subject, capture_a, capture_b FROM {LAST} JOIN g USING (stratum, subject))
SELECT pair_id, substring(pair_id, 6) AS logical_pair_id, 'genuine' AS pair_kind, side, CASE side WHEN 'a' THEN capture_a ELSE capture_b END AS capture FROM m, (VALUES ('a'), ('b')) s(side)
""")
def derived_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """J7, P14, P15."""
    m = pairs.derived_manifest(chosen(spark, sf), genuine(spark, sf), KEYS, named("cohort_genuine"))
    m = m.select("pair_id", logical_key(F.col("pair_id"), F.lit("tpch")).alias("logical_pair_id"), pair_kind(F.lit("cohort_genuine"), {"genuine": "genuine", "impostor": "impostor"}).alias("pair_kind"), "capture_a", "capture_b")
    return records.unpivot_sides(m, ["pair_id", "logical_pair_id", "pair_kind"], ["capture"])


@query("""
WITH w AS (SELECT s.v AS o_orderstatus, p.v AS o_orderpriority, y.v AS year FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(v),
           (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) p(v), (SELECT unnest(range(1994, 2003))::int AS v) y)
SELECT o_orderstatus, o_orderpriority, year FROM w ANTI JOIN (SELECT DISTINCT o_orderstatus, o_orderpriority, year(o_orderdate)::int AS year FROM orders) USING (o_orderstatus, o_orderpriority, year)
""")
def matrix_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Combinations that no order has."""
    one = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    years = spark.range(1994, 2003).select(F.col("id").cast("int").alias("year"))
    actual = t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    return pairs.matrix_gaps([one("FOPX", "o_orderstatus"), one(STRATA, "o_orderpriority"), years], actual)


@query("""
SELECT o_orderstatus, count(DISTINCT (o_orderpriority, year(o_orderdate))) AS variants, count(DISTINCT (o_orderpriority, year(o_orderdate))) = 1 AS homogeneous FROM orders GROUP BY o_orderstatus
""")
def group_homogeneity(spark: SparkSession, sf: str) -> DataFrame:
    """A23."""
    o = t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"))
    return aggregates.homogeneous(o, "o_orderstatus", ["o_orderpriority", "y"])


ELIGIBLE_COHORT_SQL = COHORT_SQL.replace("e AS (SELECT subject, stratum FROM a JOIN b USING (subject, stratum))", f"{P_SQL}, e AS (SELECT subject, stratum FROM a JOIN b USING (subject, stratum) JOIN p USING (subject, stratum))")


PROTOCOL_SQL = f"""
WITH {ELIGIBLE_COHORT_SQL}, {PAIRING_SQL},
i AS (SELECT stratum, subject, selection_rank AS pair_rank, a.capture AS ca, b.capture AS cb FROM {LAST} JOIN a USING (stratum, subject) JOIN b USING (stratum, subject)),
m AS (SELECT 'self_a' AS pair_kind, stratum, subject, pair_rank, ca AS x, ca AS y FROM i UNION ALL SELECT 'self_b', stratum, subject, pair_rank, cb, cb FROM i
      UNION ALL SELECT 'genuine', stratum, subject, pair_rank, ca, cb FROM i
      UNION ALL SELECT 'impostor', q.stratum, probe, rank_probe, a.capture, b.capture FROM q JOIN a ON a.subject = probe AND a.stratum = q.stratum JOIN b ON b.subject = candidate AND b.stratum = q.stratum),
o AS (SELECT pair_kind, ({SLOT_SQL} - 1) * {K} + pair_rank - 1 AS o, sha256(concat_ws(chr(31), printf('tpch_%s_%s_%02d', pair_kind, subject::varchar, {SLOT_SQL}), x::varchar, y::varchar)) AS h FROM m),
b2 AS (SELECT pair_kind, o // 10000 AS bucket, sha256(string_agg(h, chr(10) ORDER BY o)) AS h, count(*) AS n FROM o GROUP BY ALL),
b3 AS (SELECT pair_kind, bucket // 10000 AS bucket, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS h, sum(n) AS n, count(*) AS b FROM b2 GROUP BY pair_kind, bucket // 10000),
b4 AS (SELECT pair_kind, bucket // 10000 AS bucket, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS h, sum(n) AS n, sum(b) AS b FROM b3 GROUP BY pair_kind, bucket // 10000)
SELECT pair_kind, sum(n)::bigint AS n_rows, sum(b)::bigint AS n_buckets, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS digest FROM b4 GROUP BY pair_kind
"""


@query(PROTOCOL_SQL)
def protocol_build(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of all pair kinds for a three-source cohort, as digests."""
    sources = {s: side(spark, sf, s).select("subject", "stratum", "capture") for s in "FOP"}
    return build_protocol(sources, "F", "O", STRATA, K, VERSION, SEED, "tpch")["digests"].drop("dataset")
