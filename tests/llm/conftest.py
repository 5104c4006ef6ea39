import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, block string, component string, rank int"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, odd white space, and
    further columns whose names clash with inner ones."""
    long_text = " ".join(f"word{i % 977} item{i}" for i in range(12_000))
    some = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = ["", None, "   \n\t ", "one", "One TWO three", some, some, some + " phi", some.lower(), "été à la plage\nune ligne\n\nune ligne",
             "中文文本 测试", "a\x0bb\x1cc\xa0d e", "<|endoftext|> released under the MIT license. CC BY-NC", long_text, long_text + " end",
             "12345 678", "!!! ??? ...", "x" * 5000, "café\x85next", "tab\tsep\r\nline"]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3 + 1, t, "en" if i % 3 else None, ["a", "b", None, "\U0001f600", "￮"][i % 5], len(t or ""), i, "b", None, None))
    rows.append(rows[5])
    rows.append(rows[5])
    rows.append((None, some, None, None, None, None, None, None, None))
    rows.append((None, None, None, "a", None, None, None, None, None))
    rows.append((7, "the same id again", "en", "b", None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def part(documents):
    """A small fixture for the quadratic brute-force versions."""
    return documents.where(F.col("doc_id") < 250).withColumn("rank", F.lit("clash"))
