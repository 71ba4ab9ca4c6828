import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.functions import cells

TEXT = T.StringType()
# every kind of blank, words, numbers and things that only look like numbers
PIECES = [
    " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​",
    "a", "Ä", "7", "-5", "+.5", "1e3", "1e", ".", "1d", "NaN", "Infinity", "0x1", "1_0", "é x",
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def run(spark, values, make, kind="string"):
    df = column(spark, values, kind).select("i", make(F.col("v")).alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def py_number(text):
    import re

    if not re.fullmatch(r"[ \t-\r]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[ \t-\r]*", text, re.ASCII):
        return None
    return float(text) if abs(float(text)) < float("inf") else None


def test_text_rules_follow_python(spark):
    rng = random.Random(11)
    values = ["".join(rng.choices(PIECES, k=rng.randint(0, 5))) for _ in range(3000)] + PIECES
    assert run(spark, values, cells.squeeze_blanks) == [" ".join(v.split()) for v in values]
    assert run(spark, values, cells.strip_blanks) == [v.strip() for v in values]
    assert run(spark, values, cells.is_untidy) == [" ".join(v.split()) != v for v in values]
    assert run(spark, values, lambda c: cells.is_null_like(c, TEXT)) == [v.strip() == "" for v in values]
    assert run(spark, values, lambda c: cells.to_number(c, TEXT)) == [py_number(v) for v in values]


def test_null_like(spark):
    assert run(spark, [None, "", " \t", "x"], lambda c: cells.is_null_like(c, TEXT)) == [True, True, True, False]
    doubles = run(spark, [None, math.nan, 0.0], lambda c: cells.is_null_like(c, T.DoubleType()), "double")
    assert doubles == [True, True, False]
    assert run(spark, [None, 0], lambda c: cells.is_null_like(c, T.LongType()), "long") == [True, False]


def test_numbers_of_other_types(spark):
    assert run(spark, [math.nan, math.inf, 2.5, None], lambda c: cells.to_number(c, T.DoubleType()), "double") == [
        None, None, 2.5, None,
    ]
    assert run(spark, [True], lambda c: cells.to_number(c, T.BooleanType()), "boolean") == [None]
    assert run(spark, ["1e999"], lambda c: cells.to_number(c, TEXT)) == [None]


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("28.0", "28.000001", True),
        ("Alice", "alice ", True),
        (None, None, True),
        (None, "5", False),
        ("28", "28.0", True),
        ("10", "999", False),
        ("", None, False),
        ("abc", "5", False),
        ("0", "0.0", True),
    ],
)
def test_values_match(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(cells.values_match(F.col("a"), TEXT, F.col("b"), TEXT).alias("r")).first()["r"]
    assert got is expected


def test_values_match_number_with_text(spark):
    df = spark.createDataFrame([(28.0, "28"), (28.0, "x"), (math.nan, None)], "a double, b string")
    got = df.select(cells.values_match(F.col("a"), T.DoubleType(), F.col("b"), TEXT).alias("r")).collect()
    assert [r["r"] for r in got] == [True, False, True]


def test_guess_dtype(spark):
    got = run(spark, [None, "3", "3.0", "3.5", "x"], lambda c: cells.guess_dtype(c, TEXT))
    assert got == ["unknown", "int", "int", "float", "str"]


def test_as_column_type(spark):
    got = run(spark, ["28", "28.0", "28.6", "9007199254740993", "x"], lambda c: cells.as_column_type(c, T.LongType()))
    assert got == [28, 28, None, 9007199254740993, None]


def test_round_to_breaks_ties_on_the_decimal(spark):
    assert run(spark, [2.675, 0.30065], lambda c: cells.round_to(c, 2), "double") == [2.68, 0.3]


def test_issue_id(spark):
    df = spark.range(1).select(
        cells.issue_id(F.lit("t"), F.lit(5), F.lit(None).cast("string"), F.lit("duplicate")).alias("r")
    )
    assert df.first()["r"] == "t_5_row_duplicate"
