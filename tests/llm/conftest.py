import pytest

from tests.conftest import spark, tmpdir_run  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):  # noqa: F811
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):  # noqa: F811
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):  # noqa: F811
    return spark.read.parquet(f"{SF}/benchmark.parquet")


LONG = "lorem ipsum dolor " * 30_000  # half a megabyte

# null and repeated ids, null / empty / blank / very long texts, repeated rows, odd characters
EDGE_ROWS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "one"), (5, "one"), (None, "no id here at all"), (None, None),
    (6, "zero\x00byte and ퟿ \U0001F600 emoji"), (7, "\n\n\n"), (8, "A" * 5000), (9, "é" * 300 + " ß"),
]


@pytest.fixture(scope="session")
def edge(spark):  # noqa: F811
    """Edge rows with columns whose names clash with those the operators use."""
    from pyspark.sql import functions as F
    d = spark.createDataFrame(EDGE_ROWS, "doc_id long, text string")
    for c in ("score", "tail", "n_words", "hits", "runs", "key", "line", "id", "row", "_gone_id", "hit_share", "pii_kinds",
              "line_row", "n_chars", "gone", "class_id", "spans", "label"):
        d = d.withColumn(c, F.lit(None).cast("string") if c != "n_chars" else F.length("text").cast("long"))
    return d


@pytest.fixture(scope="session")
def empty(spark):  # noqa: F811
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
