"""Hand-computed cases for column expressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import dates as D
from corpuscope.functions import numeric as N
from corpuscope.functions import text as S
from corpuscope.functions.stemming import stem


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "day, week",
    [("2024-02-14", "2024-02-11"), ("2024-02-15", "2024-02-18"), ("2024-02-11", "2024-02-11")],
)
def test_round_week(spark, day, week):
    assert str(one(spark, D.round_week("d"), d=day)) == week


@pytest.mark.parametrize(
    "day, month",
    [("2024-02-15", "2024-02-01"), ("2023-02-15", "2023-03-01"), ("2024-12-31", "2025-01-01")],
)
def test_round_month(spark, day, month):
    assert str(one(spark, D.round_month("d"), d=day)) == month


def test_round_date_rejects_other_units():
    with pytest.raises(ValueError):
        D.round_date("d", "year")


def test_cursor(spark):
    assert one(spark, D.eastern_cursor(D.parse_utc("s")), s="2018-05-01T03:00:00Z") == "2018-04-30 23:00:00"


def test_parse_bad_stamp_is_null(spark):
    assert one(spark, D.parse_utc("s"), s="not a date") is None


def test_strip_html(spark):
    assert one(spark, S.strip_html("s"), s="a<br\n/>b <i>c</i>") == "a b  c "


def test_truncate(spark):
    cut = one(spark, S.str_trunc("s", 750), s="x" * 760)
    assert cut == "x" * 747 + "..."
    assert one(spark, S.str_trunc("s", 750), s="x" * 750) == "x" * 750


def test_squish(spark):
    assert one(spark, S.squish("s"), s="  a \n\t b  ") == "a b"


LOOKAHEAD = [
    ("(?!(?-i)Green River)(green)", "Green River", False),
    ("(?!(?-i)Green River)(green)", "green river", True),
    ("(?!(?-i)Green River)(riv)", "Green River", True),
    ("(?!(?-i)Old Mill)(old|new)", "The Old Mill turns", False),
]


@pytest.mark.parametrize("pattern, text, expected", LOOKAHEAD)
def test_lookahead(spark, pattern, text, expected):
    assert one(spark, S.detect("s", pattern, ignore_case=True), s=text) is expected


def test_membership_of_null(spark):
    df = spark.createDataFrame([("PUNCT",), (None,), ("NOUN",)], "pos string")
    assert {r.pos for r in df.filter(N.not_in("pos", ["PUNCT"])).collect()} == {None, "NOUN"}
    assert df.filter(N.is_in("pos", ["PUNCT"])).count() == 1


def test_log_ratio(spark):
    assert one(spark, N.log1kp("a") - N.log1kp("b"), a=0.1, b=0.0) == pytest.approx(4.00004, abs=1e-5)
    assert one(spark, F.log1p("a") - F.log1p("b"), a=0.5, b=0.0) == pytest.approx(0.405465, abs=1e-6)


def test_signs(spark):
    assert [one(spark, N.binary_hash("x"), x=v) for v in (-3, 0, 9)] == [-1, 0, 1]
    assert one(spark, N.signed_sqrt("x"), x=-9.0) == -3.0


def test_cell(spark):
    assert one(spark, S.count_with_percent("n", "t"), n=1234, t=2200) == "1,234 (56%)"
    assert one(spark, S.count_with_percent("n", "t"), n=145, t=1000) == "145 (15%)"


def test_parts(spark):
    assert one(spark, S.last_part("s"), s="good_old_science") == "science"
    assert one(spark, S.file_ext("s"), s="https://x.org/a.b.PDF") == "PDF"
    assert one(spark, S.file_ext("s"), s="https://x.org/abc") == ""
    assert one(spark, S.lower_keep_na("s"), s="NA") == "NA"


@pytest.mark.parametrize(
    "word, expected",
    [("caresses", "caress"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"),
     ("electricity", "electr"), ("agreed", "agre"), ("science", "scienc"), ("sky", "sky")],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_dates_are_dates(spark):
    assert isinstance(one(spark, D.round_week("d"), d="2024-02-14"), datetime.date)
