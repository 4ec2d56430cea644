import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key long, row string, size string, words string, h1 string, struck string, _key string"
)


def words(seed, n, base="lorem ipsum dolor sit amet tempor magna aliqua elit sed".split()):
    rng = random.Random(seed)
    return " ".join(rng.choice(base) + rng.choice("abcdefgh") for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, and one text in a third of all rows."""
    common = words(0, 60)
    rows = [(i, words(i, 5 + i * 7 % 90), "en", f"s{i % 4}") for i in range(1, 30)]
    rows += [(i, common, "en", "s0") for i in range(30, 55)]
    rows += [(i, common.replace("lorem", "LOREM"), "en", None) for i in range(55, 60)]
    rows += [(60, None, "en", "s1"), (61, "", None, "s2"), (62, " \n\t", "de", None), (63, "12 !!", "de", "s3")]
    rows += [(None, words(99, 20), None, None), (None, None, None, None)]
    rows += [(64, words(64, 30), "fr", "s1")] * 3
    rows += [(65, words(65, 20000), "fr", "s2"), (66, "x" * 50000, "fr", "s2"), (-5, "solo", "en", "s9")]
    return [(d, t, l, s, None if t is None else len(t), 7, "r", "z", "w", "h", "s", "k") for d, t, l, s in rows]


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def given(spark, data):
    """The whole of the smallest given table."""
    return spark.read.parquet(f"{data}/documents.parquet")


def text_rows(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
