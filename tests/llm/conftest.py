import pytest

LONG = "wörd " * 3000 + "end"
BASE = "the quick brown fox jumps over the lazy dog while seven small ships sail slowly past the old stone harbour at dawn today"


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, repeated rows, ties, and odd characters."""
    texts = [
        BASE, BASE, "", None, "   \n\t ", LONG, LONG + " more", BASE + " with a tail", "Mail a.b+c@ex-1.co.uk or x@y, or a@b.c@d.e now",
        "ip 10.0.0.255 and 10.0.0.256 or 1.2.3.4.5.6.7.8, card 4111 1111 1111 1111, 4111-1111-1111-1112, phone +1 (017) 555-7713 x",
        "<|endoftext|> It's a TEST\x1cpiece ́é \U0001f600 你好 123 isn't x<|startoftext|>y", "a", "one two three",
        "see https://user@ex.com/a?b=1. Account no: 1234 5678 or IBAN DE89 3704 0044 0532 0130 00 end", BASE.upper(), BASE,
    ]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, BASE, None, None, None), (3, "again three", "en", "s", 1), (3, "again three", "en", "s", 1)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    """A folder like the driver's with small tables, for whole queries."""
    return "/root/testdata/sf0.001"
