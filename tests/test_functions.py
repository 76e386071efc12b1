import hashlib
import math

import pytest
from pyspark.sql import functions as F

from pairlab.functions import digests, geometry, jsonmaps, keys, numbers, scores, vectors


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_keys(spark):
    df = spark.createDataFrame([("00001234_roll_1000_03.png",), ("1234_roll_1000_03.png",), ("x00001234_roll_1000_03.png",)], "f string")
    got = df.select(*keys.regex_groups(F.col("f"), r"(\d{8})_(plain|roll)_(\d{3,4})_(\d{2})(\.png)", ["s", "i", "p", "c", "e"])).collect()
    assert tuple(got[0]) == ("00001234", "roll", "1000", "03", ".png")
    assert got[1]["s"] is None and got[2]["s"] is None
    r = one(spark, id=keys.pair_id(F.lit("d"), F.lit("p"), F.lit("0007"), F.lit(3)), bad=keys.logical_key(F.lit("x_1"), F.lit("d")), good=keys.logical_key(F.lit("d_p_0007_03"), F.lit("d")), pad=keys.zero_padded(F.lit(7), 4), alias=keys.alias_of(F.lit(" Right "), {"right": "r"}), unknown=keys.alias_of(F.lit("up"), {"right": "r"}))
    assert tuple(r) == ("d_p_0007_03", None, "p_0007_03", "0007", "r", None)


@pytest.mark.parametrize(("text", "value"), [("1.5", 1.5), ("nan", None), ("inf", None), ("true", None), ("", None), (None, None), ("x", None), ("-2", -2.0)])
def test_lenient_number(spark, text, value):
    assert one(spark, x=numbers.lenient_number(F.lit(text).cast("string")))["x"] == value


def test_strict_number_and_integer(spark):
    cases = {"": "missing", "x": "not_numeric", "nan": "out_of_range", "-1": "out_of_range", "1": None}
    for text, fault in cases.items():
        assert one(spark, x=numbers.strict_number_fault(F.lit(text), nonnegative=True))["x"] == fault
    assert [one(spark, x=numbers.integer_fault(F.lit(s)))["x"] for s in (" 12 ", "1.5", "")] == [None, "not_integer", "missing"]


def test_json(spark):
    v = lambda s: numbers.json_object(F.lit(s))
    r = one(spark, a=v('{"a": {"b": 2.5}}').isNotNull(), b=v("[1]").isNotNull(), c=v("{bad").isNotNull(), n=numbers.json_number(v('{"a": {"b": 2.5}}'), "$.a.b"), t=numbers.json_number(v('{"a": "2"}'), "$.a"), f=numbers.json_number(v('{"a": true}'), "$.a"))
    assert tuple(r) == (True, False, False, 2.5, None, None)
    doc = '{"b": 1, "a": {"x": 2, "run_ms": 3}, "wall_ms": 4, "pid": 5}'
    assert one(spark, s=jsonmaps.sorted_json(jsonmaps.stable_map(F.lit(doc))))["s"] == '{"a":{"run_ms":3,"x":2},"b":1}'
    typed = '{"z": null, "t": true, "s": "1", "d": 1.50, "n": 9007199254740993, "e": {}, "x.pid": []}'
    assert one(spark, s=jsonmaps.sorted_json(jsonmaps.stable_map(F.lit(typed))))["s"] == '{"d":1.5,"e":{},"n":9007199254740993,"s":"1","t":true,"x.pid":[],"z":null}'


@pytest.mark.parametrize("x", [0.0, 1.0, 123.456, 1234567.891, 0.00012345, 2.5])
def test_nine_digits(spark, x):
    assert float(one(spark, t=numbers.nine_digits(F.lit(x)))["t"]) == pytest.approx(x, rel=1e-6)
    assert one(spark, t=numbers.round_trips(F.lit("0.5")))["t"] and not one(spark, t=numbers.round_trips(F.lit("0.50")))["t"]


def test_vectors(spark):
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    r = one(spark, zero=vectors.root_normalised(arr(0, 0)), root=vectors.root_normalised(arr(1, 3)), self_=vectors.two_branch_score(arr(1, 2, 3, 4), arr(1, 2, 3, 4), 2), d=vectors.l2_distance(arr(0, 3), arr(4, 0)), short=vectors.vector_fault(arr(1), 2), nan=vectors.vector_fault(arr(1, float("nan")), 2))
    assert r["zero"] == [0, 0] and r["root"] == [0.5, pytest.approx(math.sqrt(0.75))]
    assert r["self_"] == pytest.approx(2.0) and r["d"] == 5 and r["short"] == "wrong_length" and r["nan"] == "not_finite"


def test_score_formula(spark):
    parts = scores.score_components(F.lit(12), F.lit(20), F.lit(100), F.lit(80))
    got = one(spark, p=parts)["p"]
    assert got[scores.COUNT] == 12 and got[scores.RATIO] == 0.6 and got[scores.OVER_MIN] == pytest.approx(0.15)
    assert got[scores.COMPOSITE] == pytest.approx(12 * 0.6 * math.log(21))
    zero = one(spark, p=scores.score_components(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))["p"]
    assert set(zero.values()) == {0.0}
    assert one(spark, s=scores.score_of_mode(parts, F.lit("none")))["s"]["error"] == "unsupported_score_mode"


def test_geometry(spark):
    r = one(spark, s=geometry.support_size(F.lit(8.0), F.lit(1000.0), 500), bad=geometry.support_size(F.lit(-1.0), F.lit(1000.0), 500), c=geometry.pixel_centre(F.lit(0.0), F.lit(100.0), F.lit(50.0)), out=geometry.pixel_centre(F.lit(200.0), F.lit(100.0), F.lit(50.0)), d=geometry.dpi_fault(F.lit(50.0)), n=geometry.dpi_fault(F.lit(None).cast("double")), mm=geometry.mm_to_pixels(F.lit(25.4), F.lit(500.0)), f=geometry.cycles_per_mm(F.lit(0.1), F.lit(254.0)))
    assert tuple(r) == (16.0, None, -0.25, None, "dpi_out_of_range", "missing_dpi", 500.0, pytest.approx(1.0))


def test_digests(spark):
    r = one(spark, s=digests.joined_sha256(F.lit("a"), F.lit("b")), ok=digests.is_sha256(F.lit("0" * 64)), no=digests.is_sha256(F.lit("G" * 64)), a=digests.config_digest({"x": F.lit(1), "a": F.lit("b")}), b=digests.config_digest({"a": F.lit("b"), "x": F.lit(1)}))
    assert r["s"] == hashlib.sha256(b"a\nb").hexdigest() and r["ok"] and not r["no"] and r["a"] == r["b"]


def test_ordered_digest_ignores_partitions_but_not_order(spark):
    df = spark.range(1000).select(F.col("id").alias("o"), (F.col("id") * 7 % 13).alias("v"))
    d = lambda x: digests.ordered_digest(x, "o", ["v"], bucket_rows=64).first()["digest"]
    assert d(df) == d(df.repartition(7).orderBy(F.rand(1))) != d(df.withColumn("o", 999 - F.col("o")))


def test_file_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert digests.file_digests(spark, str(tmp_path)).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
