import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that operators use inside must not disturb them
        T.StructField("node", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def corpus(n=120, seed=3):
    """Documents with nulls, empty and long texts, copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "straße", "zeta", "eta", "theta", "iota", "a", "of", "the"]
    prose = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(k))
    passage = " ".join(f"shared{i}" for i in range(55))
    texts = [None, "", "   ", "x", "X", "\t\n", "one two", "ONE two", prose(5000), "q" * 3000]
    texts += [prose(rng.randint(1, 120)) for _ in range(n // 2)]
    texts += [rng.choice(texts[10:]) for _ in range(n // 6)]
    texts += [rng.choice(texts[10:40]).upper() for _ in range(4)]
    texts += [f"{prose(30)} {passage} {prose(9)}" for _ in range(n // 6)]
    texts += ["loop " * 60, "loop " * 70, "a b c d e " * 12]
    rng.shuffle(texts)
    return [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["src1", "src1", "src2", "src13", None]), "n", "r", "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
