import random

import pytest
from pyspark.sql import Row, types as T

from tests.conftest import SF

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("shard", T.StringType()),
    ]
)


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like outputs."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    prose = " ".join(rng.choice(words) for _ in range(300))
    near = prose.replace(prose.split()[150], "changed", 1)
    rows = [
        (1, prose, "a"),
        (2, prose.upper(), "a"),
        (3, near, "b"),
        (4, None, "b"),
        (5, "", None),
        (None, "no id " * 20, "c"),
        (None, None, None),
        (6, "x\t\ny z \x0b\f\r", "ü"),
        (6, "x\t\ny z \x0b\f\r", "ü"),
        (6, "another text of the same id", "ü"),
        (7, " ".join(rng.choice(words) for _ in range(60_000)), "long"),
        (8, "É é ß ǅ 🙂 " * 30, ""),
        (9, "a", "a"),
        (10, "a b c", "a"),
    ]
    rows += [(100 + k, "the very same page " * 30, "hot") for k in range(200)]
    rows += [(400 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 200))), f"s{k % 5}") for k in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([Row(*r, "s", "k", "r", "h") for r in odd_rows()], DOCUMENT).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
