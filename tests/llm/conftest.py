import pytest

from pairlab.llm.common import importable


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    importable(spark)


TYPES = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, size string, rank string, _text string, salt string, key string, d string, p string"
LONG = " ".join(f"word{i % 977} and the of" for i in range(30000))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; extra columns with names used inside."""
    plain = "The cat sat on the mat and it was a good day for the cat and for the dog in the yard."
    rows = [
        (1, plain, "en", "src0"),
        (2, None, "en", "src0"),
        (3, "", None, None),
        (4, LONG, "en", "src1"),
        (5, plain, "en", "src0"),
        (5, plain, "en", "src0"),
        (None, plain + " And then some more words follow here.", None, "src2"),
        (6, " \t\n ", "fr", ""),
        (7, "x", "de", None),
        (8, "Zeile eins ist hier\nZeile zwei ist da\nZeile eins ist hier", "de", "src1"),
        (9, "Ünïcode 🙂 text mit ein paar Wörtern und 𝔘nicode", "de", "src1"),
    ]
    return [(i, t, la, s, None if t is None else len(t), "f", "s", "r", "t", "sa", None, "d", "p") for i, t, la, s in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), TYPES).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
