import pytest

from cohortspan.llm.common import ship_code

LONG = "lorem ipsum dolor " * 12_000
# doc_id, text: nulls, nothing, blanks, one word, a repeated row, one id with two texts, a long text and a long word.
ODD = [
    (None, "a text without an id has words"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "The quick brown fox jumps over the lazy dog."),
    (5, "The quick brown fox jumps over the lazy dog."),
    (6, "one id"),
    (6, "two texts"),
    (7, LONG),
    (8, "x" * 30_000),
    (9, "naïve 日本語 \U0001f600   end  of\n\nlines"),
    (10, "12345 !!! ###"),
]
# Names that operators use inside, so that they clash if extra columns are dragged along.
CLASHES = "cell int, key string, score double, words array<string>, n_words long, term string, pos int, doc long, n long, host string, lines string, ids array<int>, guest boolean, x double, held_out int, predicted int, node long, component long, url_ string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_code(spark)


def with_clashes(df):
    from pyspark.sql import functions as F

    have = set(df.columns)
    extra = [c.rsplit(" ", 1) for c in CLASHES.split(", ")]
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in extra if name not in have])


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, "en" if d and d % 2 else None, "s", 0) for d, t in ODD]
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def documents(spark, texts):
    rows = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string")
