import datetime

import pytest
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators.text_search import like_pattern


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_count_of(spark):
    assert [one(spark, S.count_of(F.lit(x))) for x in ("", "3.0", "3.5", "x", " 7 ")] == [0, 3, None, None, 7]


def test_calendar_date(spark):
    make = lambda *x: one(spark, S.calendar_date(*map(F.lit, x)))
    assert make(2023, 2, 31) is None and make(1999, 1, 1) is None
    assert make(2023, 2, 28) == datetime.date(2023, 2, 28)


def test_iso_week(spark):
    assert one(spark, S.iso_week(F.lit("2016-01-01").cast("date"))) == "2015-W53"


def test_cosine(spark):
    z, o = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, S.cosine(z, z)) == 1 and one(spark, S.cosine(z, o)) == 0
    assert one(spark, S.cosine(o, o)) == pytest.approx(1)


def test_haversine(spark):
    assert one(spark, S.haversine_km(*map(F.lit, (0.0, 0.0, 0.0, 180.0)))) == pytest.approx(20015.1, abs=0.1)


def test_half_up(spark):
    assert one(spark, S.half_up(F.lit(-2.5), 0)) == -2


def test_like_pattern():
    assert like_pattern("a_b") == "%a\\_b%" and like_pattern("a*b?") == "a%b_"
