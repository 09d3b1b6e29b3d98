import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


def prose(r, n, words=None):
    words = words or ["the", "of", "and", "ing", "ration", "onder", "Est", "thea", "blend", "er", "house", "tion", "sha", "wou", "ered"]
    return " ".join(r.choice(words) + r.choice(["", "", "n", "s", "th"]) + str(r.randrange(9)) * (r.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows(rng):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties."""
    long = prose(rng, 30_000)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", "s", 1) for i in range(40)]
    rows += [(100, None, "en", "s", 1), (101, "", None, None, None), (102, "   \n\t ", "fr", "s", 1), (103, long, "en", "s", 1), (None, "no id here at all", "en", "s", 1)]
    rows += [(None, None, None, None, None), rows[3], rows[3], (104, rows[4][1], "en", "s", 1), (105, "é 你好 \U0001F600 ǅ İstanbul", "fr", "s", 1), (106, "x" * 50_000, "en", "s", 1)]
    return rows


#: Columns whose names clash with those that operators use inside.
CLASH = ["id", "fp", "block", "row", "score", "_id", "train", "lang_pred", "component_id", "key", "val", "h", "spans", "media", "ids", "_row", "_keep", "listed", "host", "_p", "_m", "_new", "_doc", "_of", "a.b", "payload", "feature", "rgb"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, DOCS).select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def key(rows):
    return sorted(rows, key=repr)
