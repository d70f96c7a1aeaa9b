import random

import pytest

#: Names that operators use inside, as columns of the input: none may get in the way.
CLASHING = ["size", "_mark", "hash", "fp", "digit", "score", "n_words", "_row", "key", "_id", "_m", "_kept"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(("ta", "re", "mi", "so", "lu", "en", "da")) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "".join(w + (".\n" if i % 13 == 12 else " ") for i, w in enumerate(words))


def rows() -> list[tuple]:
    long = prose(1, 400)
    out = [(i, prose(100 + i, 30 + 7 * i), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(30)]
    out += [(30, long, "en", "s0"), (31, long, "en", "s1"), (32, long.replace("tare", "tari", 1), "en", "s0"), (33, long.upper(), "de", "s2")]
    out += [(40, None, "en", "s0"), (41, "", None, None), (42, " \t\n ", "en", None), (43, "one", "en", "s9"), (44, "É été ﬁn Straße  x", "fr", "s1"), (45, "é ÉTÉ fin STRASSE x\n", "fr", "s1")]
    out += [(50, "same same same", "en", "s3")] * 3 + [(None, "no id here " * 5, "en", "s3"), (None, None, None, None)]
    out += [(60, prose(7, 9000), "en", "s0"), (61, "a" * 700, "en", "s1"), (62, "x" * 5000 + " " + prose(8, 50), "en", "s2")]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, very long texts, copies, repeated rows, and extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="session")
def labels(spark):
    made = [(i, int(i % 5 != 0), 0) for i in range(30)] + [(3, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (7, None, None), (999, 1, 0)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
