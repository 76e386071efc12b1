"""Lines are dropped from the rows they stand in, also where rows share an id or have none."""

from pairlab.llm.linededup import dedup_lines

COMMON = "this line of text stands in several rows of the table"


def unique(i):
    return " ".join(f"own{chr(97 + i)}{chr(97 + k)}" for k in range(9))


def test_rows_without_id_or_of_one_id_keep_their_own_lines(spark):
    rows = [(1, COMMON), (None, f"{unique(0)}\n{COMMON}"), (None, f"{COMMON}\n{unique(1)}"), (None, f"{unique(2)}\n{unique(3)}"), (7, f"{unique(4)}\n{COMMON}"), (7, f"{unique(5)}\n{unique(6)}")]
    got = [r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    # ordered by id, null first, then by line: the third row has the first occurrence
    assert sorted(got) == sorted(["", unique(0), f"{COMMON}\n{unique(1)}", f"{unique(2)}\n{unique(3)}", unique(4), f"{unique(5)}\n{unique(6)}"])


def test_lines_recur_among_rows_without_id(spark):
    rows = [(None, f"{COMMON}\n{unique(i)}") for i in range(4)]
    got = [r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sum(COMMON in t for t in got) == 1 and all(any(unique(i) in t for t in got) for i in range(4))


def test_a_null_id_is_not_the_least_id(spark):
    rows = [(-(2**63), COMMON), (None, f"{unique(0)}\n{COMMON}"), (0, f"{unique(1)}\n{COMMON}")]
    got = sorted(r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted([f"{unique(0)}\n{COMMON}", "", unique(1)])
