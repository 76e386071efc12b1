"""Pair scoring as a job.

A method is an adapter with two column functions: `prepare` describes a capture
by a struct<payload, error, …>, `compare` scores two payloads by a
struct<score, error>; both may report messages, diagnostics and times.  Captures are prepared once, whatever the number of pairs
they stand in; failures are rows with a stage, never exceptions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.vectors import dot, two_branch_score, vector_fault

OK, FAIL_A, FAIL_B, FAIL_COMPARE = "ok", "prepare_a_failure", "prepare_b_failure", "comparison_failure"
STATUSES = (OK, FAIL_A, FAIL_B, FAIL_COMPARE)


class Method(Protocol):
    """No thresholds and no hidden state; names and versions are run constants."""

    name: str
    version: str
    payload_format: str

    def prepare(self, captures: DataFrame) -> DataFrame:
        """(capture, payload, error) for (capture, …)."""

    def compare(self, a: Column, b: Column) -> Column:
        """struct<score double, error string>."""


@dataclass(frozen=True)
class DotProduct:
    """Cosine-like score of equal-length vectors; `refuse` marks captures that fail to prepare, `first` keeps the score to leading dimensions."""

    length: int
    refuse: Column | None = None
    halves: bool = False
    first: int | None = None
    name: str = "dot"
    version: str = "1"
    payload_format: str = "vector"

    def prepare(self, captures: DataFrame) -> DataFrame:
        fault = vector_fault(F.col("vector"), self.length)
        if self.refuse is not None:
            fault = F.when(self.refuse, "refused").otherwise(fault)
        return captures.select("capture", F.when(fault.isNull(), F.col("vector")).alias("payload"), fault.alias("error"))

    def compare(self, a: Column, b: Column) -> Column:
        if self.first:
            a, b = F.slice(a, 1, self.first), F.slice(b, 1, self.first)
        s = two_branch_score(a, b, self.length // 2) if self.halves else dot(a, b)
        return F.struct(F.when(finite(s), s).alias("score"), F.when(~finite(s), "non_finite_raw_score").alias("error"))


def authorised(prepared: DataFrame, method: Method) -> DataFrame:
    """A stored payload of another method, version or format is an error, not an input."""
    fine = (F.col("method") == method.name) & (F.col("version") == method.version) & (F.col("format") == method.payload_format)
    error = F.when(~F.coalesce(fine, F.lit(False)), "payload_not_authorised").otherwise(F.col("error"))
    return prepared.select("capture", F.when(error.isNull(), F.col("payload")).alias("payload"), error.alias("error"))


# Codes of failures that the job itself finds.
BAD_TIMING, NON_FINITE, MISSING = "invalid_method_timing", "non_finite_raw_score", "missing_capture"
MESSAGES = {BAD_TIMING: "a reported time is not finite or is negative", NON_FINITE: "the score is not finite", MISSING: "the capture is not in the table"}
#: What a stage reports besides its result; every field is optional.
REPORTED = {"message": "string", "diagnostics": "string", "ms": "double", "wall_ms": "double"}


def _valid(ms: Column) -> Column:
    return F.coalesce(finite(ms) & (ms >= 0), F.lit(False))


def _stage(field, error: Column) -> Column:
    """What a stage that ran leaves in a row.

    A refused own time is not kept and fails the stage; the wall time is the one
    reported, else the own one, else zero; diagnostics are an object, empty if
    none are given.
    """
    ms, wall = field("ms"), field("wall_ms")
    code = F.coalesce(error, F.when((ms.isNotNull() & ~_valid(ms)) | (wall.isNotNull() & ~_valid(wall)), BAD_TIMING))
    own = F.when(_valid(ms), ms)
    said = F.when(F.trim(field("message")) != "", field("message"))
    message = F.coalesce(said, F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])[code], code)
    return F.struct(code.alias("code"), F.when(code.isNotNull(), message).alias("message"), F.coalesce(F.when(_valid(wall), wall), own, F.lit(0.0)).alias("wall"), own.alias("own"), F.coalesce(field("diagnostics"), F.lit("{}")).alias("diagnostics"))


def run_pairs(pairs: DataFrame, captures: DataFrame, method: Method, constants: dict[str, str] | None = None) -> DataFrame:
    """Pairs (…, capture_a, capture_b) → result rows that hold the contract's row rules, and the run constants.

    `prepare` and `compare` may report a message, diagnostics (JSON text), the
    method's own time `ms` and a `wall_ms` (columns of the one, fields of the
    other).  A stage that did not run has neither times nor diagnostics;
    total_ms is the sum of the stages that ran, each at the larger of its times.
    """
    prepared = method.prepare(captures)
    reported = lambda name: F.col(name) if name in prepared.columns else F.lit(None).cast(REPORTED[name])
    described = prepared.select("capture", "payload", _stage(reported, F.col("error")).alias("s"))
    side = lambda x: described.select(F.col("capture").alias(f"capture_{x}"), F.col("payload").alias(f"_p{x}"), F.col("s").alias(f"_{x}"))
    joined = pairs.join(side("a"), "capture_a", "left").join(side("b"), "capture_b", "left")
    nothing = lambda name: F.lit(None).cast(REPORTED[name])
    joined = joined.withColumns({f"_{x}": F.coalesce(f"_{x}", _stage(nothing, F.lit(MISSING))) for x in "ab"})
    both = F.col("_a.code").isNull() & F.col("_b.code").isNull()
    compared = joined.withColumn("_r", F.when(both, method.compare(F.col("_pa"), F.col("_pb"))))
    given = compared.schema["_r"].dataType.names
    field = lambda name: F.col(f"_r.{name}") if name in given else nothing(name)
    score = F.col("_r.score")
    error = F.coalesce(F.col("_r.error"), F.when(~F.coalesce(finite(score), F.lit(False)), NON_FINITE))
    compared = compared.withColumn("_c", F.when(both, _stage(field, error)))
    status = F.when(F.col("_a.code").isNotNull(), FAIL_A).when(F.col("_b.code").isNotNull(), FAIL_B).when(F.col("_c.code").isNotNull(), FAIL_COMPARE).otherwise(OK)
    compared = compared.withColumn("status", status)
    ran = {"a": F.lit(True), "b": F.col("status") != FAIL_A, "c": both}
    names = {"a": "prepare_a", "b": "prepare_b", "c": "compare"}
    of = lambda x, what: F.when(ran[x], F.col(f"_{x}.{what}"))
    times = {f"{n}_ms": of(x, "wall") for x, n in names.items()} | {f"method_{n}_ms": of(x, "own") for x, n in names.items()} | {f"{n}_diagnostics": of(x, "diagnostics") for x, n in names.items()}
    spent = [F.coalesce(F.when(ran[x], F.greatest(F.col(f"_{x}.wall"), F.col(f"_{x}.own"))), F.lit(0.0)) for x in names]
    first = lambda what: F.coalesce(F.col(f"_a.{what}"), F.when(ran["b"], F.col(f"_b.{what}")), F.col(f"_c.{what}"))
    out = compared.withColumns({"raw_score": F.when(F.col("status") == OK, score), **times, "total_ms": reduce(lambda x, y: x + y, spent), "error_code": first("code"), "error_message": first("message")})
    out = out.drop("_pa", "_pb", "_a", "_b", "_c", "_r")
    return out.withColumns({k: F.lit(v) for k, v in (constants or {}).items()})


@dataclass(frozen=True)
class Timed:
    """A method whose stages report own times: `prepare_ms` over a capture's columns, `compare_ms` a constant or expression."""

    method: Method
    prepare_ms: Column
    compare_ms: Column

    def prepare(self, captures: DataFrame) -> DataFrame:
        return self.method.prepare(captures).join(captures.select("capture", self.prepare_ms.cast("double").alias("ms")), "capture")

    def compare(self, a: Column, b: Column) -> Column:
        return self.method.compare(a, b).withField("ms", self.compare_ms.cast("double"))


@dataclass(frozen=True)
class Telling:
    """A method that refuses some pairs (`refuse` gives a code over the pair's columns), with a message, and tells the payload's length."""

    method: Method
    refuse: Column

    def prepare(self, captures: DataFrame) -> DataFrame:
        return self.method.prepare(captures).withColumn("diagnostics", F.to_json(F.struct(F.size("payload").alias("length"))))

    def compare(self, a: Column, b: Column) -> Column:
        c = self.method.compare(a, b)
        error = F.coalesce(self.refuse, c["error"])
        return F.struct(F.when(error.isNull(), c["score"]).alias("score"), error.alias("error"), F.concat(F.lit("method said: "), error).alias("message"), F.to_json(F.struct(F.size(a).alias("length"))).alias("diagnostics"))


def run_filtered(pairs: DataFrame, captures: DataFrame, methods: dict[str, Method], wanted: DataFrame, manifest_faults: DataFrame, group: str) -> DataFrame:
    """The runs of `wanted` (method, `group`) over one table of pairs that is checked once for all of them.

    `manifest_faults` has a row per broken rule of the pairs' manifests; any row
    refuses every run.  Methods are a small vocabulary and one job a method.
    """
    if manifest_faults.limit(1).count():
        raise ValueError("the shared manifest broke rules; no run was started")
    names = F.lit(None).cast("string")
    out = None
    for name, method in methods.items():
        runs = wanted.filter(F.col("method") == name).select(group)
        now = run_pairs(pairs.join(runs, group, "left_semi"), captures, method, {"method": name})
        out = now if out is None else out.unionByName(now)
    return out if out is not None else pairs.withColumn("method", names).limit(0)


def run_matrix(dimensions: list[DataFrame], wanted: Column | None = None) -> DataFrame:
    """All combinations of the run dimensions, or those wanted; dimensions are small vocabularies."""
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(d)
    return out if wanted is None else out.filter(wanted)


def detect(captures: DataFrame, detector, schema: str) -> DataFrame:
    """A detector plug-in, a mapInPandas function of (capture, content) giving exploded, ranked points."""
    return captures.select("capture", "content").mapInPandas(detector, schema)
