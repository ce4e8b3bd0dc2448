import pytest
from odd_rows import TEXTS

@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and extra columns with clashing names."""
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else "src", len(t or ""), n, n, "k", n, True, "x", n, n)
            for n, (i, t) in enumerate(TEXTS)]
    shape = ("doc_id long, text string, lang string, source string, n_chars long, row long, piece long, key string, label long, kept boolean, "
             "host string, n_words long, seq long")
    return spark.createDataFrame(rows, shape)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
