import pytest
from pyspark.sql import functions as F

from pairlab.sources import publish, readers, scan


def test_scan_reports_missing_directories(spark, tmp_path):
    (tmp_path / "roll").mkdir()
    (tmp_path / "roll" / "a.png").write_bytes(b"x")
    got = scan.scan_all(spark, {"d": {"roll": str(tmp_path / "roll"), "plain": str(tmp_path / "plain")}})
    assert sorted((r["side"], r["error_message"]) for r in got.collect()) == [("plain", "missing_directory"), ("roll", None)]


def test_strict_reader(spark, tmp_path):
    good, order, extra = (tmp_path / n for n in ("good.csv", "order.csv", "extra.csv"))
    good.write_text("id,n\na,1\nb,2\n")
    order.write_text("n,id\n1,a\n")
    extra.write_text("id,n\na,1,9\n")
    assert readers.strict_csv(spark, str(good), "id string, n int").count() == 2
    for bad in (order, extra):
        with pytest.raises(Exception):
            readers.strict_csv(spark, str(bad), "id string, n int").collect()
    mixed = tmp_path / "mixed.csv"
    mixed.write_text("id,n\na,1\nb,x\n,3\n")
    rows = readers.tolerant_csv(spark, str(mixed), "id string, n int")
    assert rows.filter("_corrupt IS NOT NULL").count() == 1
    assert ("empty:id",) in [tuple(r) for r in readers.manifest_faults(rows, ["id"], "id").select("rule").collect()]
    text = tmp_path / "t.csv"
    text.write_text('id,j\n1,"{""a"": ""x\ny""}"\n')
    assert readers.text_csv(spark, str(text), ["id", "j"]).first()["j"] == '{"a": "x\ny"}'
    doc = tmp_path / "d.json"
    doc.write_text("[1]")
    assert not readers.json_document(spark, str(doc)).first()["is_object"]
    tagged = scan.load_tagged(spark, [str(good)], "id string, n int", "([a-z]+)[.]csv")
    assert tagged.first()["tag"] == "good"


def test_publish_is_atomic_and_idempotent(spark, tmp_path):
    df = spark.range(10)
    path = str(tmp_path / "out")
    bad = lambda x: x.filter("id > 8")
    with pytest.raises(publish.PublishError):
        publish.publish(df, path, bad)
    assert list(tmp_path.iterdir()) == []
    none = lambda x: x.filter("id > 99")
    assert publish.publish(df, path, none).count() == 10
    with pytest.raises(publish.PublishError):
        publish.publish(df, path, none)
    assert publish.publish_or_reuse(spark.range(3), path, none).count() == 10
    with pytest.raises(publish.PublishError):
        publish.publish_or_reuse(df, path, bad)
    stored = spark.read.parquet(path)
    assert publish.build_differences(df, stored).count() == 0 and publish.build_differences(spark.range(9), stored).count() == 1
    assert publish.pending_runs(spark.range(12), stored, ["id"]).count() == 2


def test_exports(spark, tmp_path):
    df = spark.range(5).select((4 - F.col("id")).alias("o"), F.array(F.lit(1)).alias("a"))
    flat = publish.flattened(df)
    publish.write_csv(flat, str(tmp_path / "c"), ["o"])
    lines = [x for p in sorted((tmp_path / "c").glob("part-*")) for x in p.read_text().split("\n")[1:] if x]
    assert [x.split(",")[0] for x in lines] == ["0", "1", "2", "3", "4"]
    publish.write_json(df, str(tmp_path / "j"))
    assert '{"a":[1],"o":' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    found = spark.createDataFrame([("a",), ("a",), ("z",), ("b",)], "k string")
    allowed = spark.createDataFrame([("a",), ("b",)], "k string")
    assert sorted(tuple(r) for r in publish.partition_faults(found, allowed, ["k"]).collect()) == [("a", "duplicate_partition"), ("z", "unknown_partition")]


def test_staged_tables_can_be_cleared(spark):
    table = publish.staged(spark.range(4))
    assert table.count() == 4
    publish.clear_staged(spark)
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0]).count()


def test_digests_of_files_of_any_size(spark, tmp_path):
    """A sparse file of 3 GB, which Spark's reader of whole files refuses, and one whose name needs escapes, in ranges of a megabyte."""
    import hashlib

    from pairlab.functions import digests

    big, n = tmp_path / "big.bin", 3 * 1024**3
    with open(big, "wb") as f:
        f.truncate(n - 3)
        f.seek(n - 3)
        f.write(b"end")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b%20é.bin").write_bytes(b"xyz" * 1000)
    want = hashlib.sha256()
    zeros = bytes(1 << 20)
    for _ in range((n - 3) // len(zeros)):
        want.update(zeros)
    want.update(bytes((n - 3) % len(zeros)) + b"end")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in digests.file_digests(spark, str(tmp_path), 1 << 20).collect()}
    assert got.pop("big.bin") == (n, want.hexdigest())
    assert list(got.values()) == [(3000, hashlib.sha256(b"xyz" * 1000).hexdigest())]


def test_long_lists_have_no_single_text(spark):
    from pairlab.functions import digests

    df = spark.createDataFrame([("a", f"p{i}", "s") for i in range(5)] + [("b", "p", "s")], "g string, path string, sha string")
    got = {r["g"]: r for r in digests.list_digest(df, ["g"], "path", "sha", most=3).collect()}
    assert got["a"]["digest"] is None and got["a"]["n_files"] == 5 and got["b"]["digest"] and got["b"]["n_files"] == 1
    assert digests.list_digest(df, [], "path", "sha", most=3).first()["digest"] is None and digests.list_digest(df, [], "path", "sha").first()["digest"]


def test_lists_of_any_length_have_their_whole_digest(spark):
    """Beyond 100,000 files, with null and repeated paths, groups of any key, and no file at all."""
    import hashlib
    import json

    from pairlab.functions import digests

    listed = lambda rows: json.dumps([{k: v for k, v in zip(("path", "sha256"), x) if v is not None} for x in rows], separators=(",", ":"), ensure_ascii=False)
    of = lambda rows: (hashlib.sha256(listed(rows).encode()).hexdigest(), len(rows))
    long = spark.range(100_033).selectExpr("'a' AS g", "1.5D AS `_g0`", "format_string('%09d', id) AS path", "sha2(string(id), 256) AS sha")
    odd = [(None, float("nan"), "q\"ü", "s"), (None, float("nan"), None, "s"), (None, float("nan"), "q", "t"), (None, float("nan"), "q", "s"), ("b", None, "p", None)]
    df = long.union(spark.createDataFrame(odd, "g string, `_g0` double, path string, sha string")).repartition(5)
    got = {r["g"]: (r["digest"], r["n_files"]) for r in digests.list_digest(df, ["g", "_g0"], "path", "sha").collect()}
    want = {"a": [(f"{i:09d}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(100_033)], None: [(None, "s"), ("q", "s"), ("q", "t"), ("q\"ü", "s")], "b": [("p", None)]}
    assert got == {g: of(rows) for g, rows in want.items()}
    assert tuple(digests.list_digest(df.filter("g = 'a'"), [], "path", "sha").first()) == of(want["a"])
    assert tuple(digests.list_digest(df.limit(0), [], "path", "sha").first()) == of([])


def test_quoted_csv_in_splits(spark, tmp_path):
    """Splits cut records anywhere, in and before quoted newlines and quotes: the same rows as the whole file, by several tasks."""
    import csv
    import random

    r = random.Random(4)
    cells = ["plain", "a,b", 'say "hi"', "two\nlines", "\n\n", '"\n"', ",\n,", "é" * 30, "x" * 300, '""', "end\n"]
    folder = tmp_path / "csv"
    folder.mkdir()
    rows = [(str(i), r.choice(cells), r.choice(cells)) for i in range(900)]
    for k, end in enumerate(("\n", "\r\n")):
        with open(folder / f"part{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerows([("id", "a", "b"), *rows[450 * k : 450 * (k + 1)]])
    (folder / "none.csv").write_text("id,a,b\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert readers.quoted_records(spark, str(folder)).select("block").distinct().count() > 20
        got = readers.text_csv(spark, str(folder), ["id", "a", "b"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, got), key=lambda x: int(x[0])) == rows
    with pytest.raises(ValueError):
        readers.text_csv(spark, str(folder), ["id", "b", "a"])


def test_commits_need_no_rename(spark, tmp_path):
    """A killed writer leaves nothing that is read; of two that race one whole table is left; lost files are named."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    fine = lambda df: df.limit(0)
    path = str(tmp_path / "t")
    with pytest.raises(RuntimeError, match="killed"):

        def killed(df):
            raise RuntimeError("killed")

        publish.commit_table(spark.range(5), path, killed)
    spark.range(7).write.parquet(f"{path}/data-dead")  # as a writer leaves it that could not clean up
    with pytest.raises(publish.PublishError, match="nothing"):
        publish.live_table(spark, path)
    gate = Barrier(2)

    def race(k):
        def wait(df):
            gate.wait(60)
            return df.limit(0)

        try:
            return publish.commit_table(spark.range(1000 * k, 1000 * k + 100), path, wait).count()
        except publish.PublishError as e:
            return str(e)

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(race, (1, 2)))
    assert sorted(map(str, got))[0] == "100" and sum("already" in str(x) for x in got) == 1
    rows = sorted(r[0] for r in publish.live_table(spark, path).collect())
    assert rows in ([*range(1000, 1100)], [*range(2000, 2100)])
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-") and p.name != "data-dead"]) == 1
    assert publish.commit_table(spark.range(0), str(tmp_path / "e"), fine).count() == 0
    part = next((tmp_path / "t").glob("data-[!d]*/part-*"))
    part.unlink()
    with pytest.raises(publish.PublishError, match="missing"):
        publish.live_table(spark, path)


def test_runs_of_threads_stage_apart(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    gate = Barrier(2)

    def run(_):
        with publish.staging_run(spark) as own:
            gate.wait(60)
            found = publish.staged(spark.range(3)).inputFiles()[0]
            gate.wait(60)
            return own, found

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(run, range(2))
    assert one[0] != two[0] and one[0].rsplit("/", 1)[1] in one[1] and two[0].rsplit("/", 1)[1] in two[1]
