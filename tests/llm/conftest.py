import os

import pytest

SF = "/root/testdata/sf0.001"

SAME = "Equal words stand here again and again for a tie of two rows"
LONG = " ".join(f"wörd{i % 977} und" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t  "), (4, "word"), (5, SAME), (5, SAME), (6, SAME), (None, "a row without an id, but with words"),
    (7, LONG), (8, "x" * 100_000), (9, "<|endoftext|> marks  and   runs\n\n\n of\u00a0space \r\n"), (10, "naïve 😀 e\u0301 Σ İ 's they're"),
    (11, None), (12, "\0 zero \x1c unit"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string")
    names = ["score", "label", "kept", "n_words", "node", "version", "row", "hash", "size", "start", "part", "open", "key", "print", "lang"]
    return df.select("*", *[F.lit(n).alias(n) for n in names]).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    """The same columns, no rows."""
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables absent")
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def table(spark, docs):
    return lambda name, sf=SF: spark.read.parquet(f"{sf}/{name}.parquet")
