import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from libris.functions import text


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f("v").alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_isbn(spark):
    assert apply(spark, text.normalize_isbn, ["978-0-441", "080442957x", "abc", "", None]) == ["9780441", "080442957X", "", "", None]
    assert apply(spark, text.unwrap_isbn, ['="9780441013593"', '=""', '="', " 978-1 ", None]) == ["9780441013593", None, None, "9781", None]
    assert apply(spark, text.isbn10_to_13, ["0441013597", "0-306-40615-2", "080442957X", "X234567890", "12345", None]) == ["9780441013593", "9780306406157", "9780804429573", None, None, None]
    assert apply(spark, text.looks_like_isbn, ["urn:isbn:9780441013593", "123456789X", "0123456789"]) == [True, False, True]


@pytest.mark.parametrize(
    ("line", "title", "author"),
    [
        ("Dune by Frank Herbert", "Dune", "Frank Herbert"),
        ("Dune BY Frank Herbert", "Dune", "Frank Herbert"),
        ("Driven by Data by Paul B", "Driven by Data", "Paul B"),
        ("1. Dune - Frank Herbert", "Dune", "Frank Herbert"),
        ("12) Dune", "Dune", None),
        ("İstanbul by Orhan Pamuk", "İstanbul", "Orhan Pamuk"),
        ("by someone", "by someone", None),
        ("2001: A Space Odyssey", "2001: A Space Odyssey", None),
    ],
)
def test_lines(spark, line, title, author):
    assert tuple(apply(spark, text.parse_line, [line])[0]) == (title, author)


def test_numbers(spark):
    assert apply(spark, text.position_number, ["1", "1.5", " 1 ", "1d", "nan", "inf", "-2", "1e2", None]) == [1.0, 1.5, None, None, None, None, -2.0, 100.0, None]
    assert apply(spark, lambda v: text.format_position(F.col(v).cast("double")), ["3.0", "1.5", "12345678.5", "0.1"]) == ["3", "1.5", "12345678.5", "0.1"]
    assert apply(spark, text.url_encode, ["a b&c/é"]) == ["a%20b%26c%2F%C3%A9"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_isbn_by_brute_force(spark, values):
    want = ["".join(c.upper() for c in v if c in "0123456789Xx") for v in values]
    assert apply(spark, text.normalize_isbn, values) == want
