import random

import pytest
from samples import SCHEMA, passenger_rows
from pyspark.sql import functions as F

from mendframe.operators import detect, profile as prof, repair


def issues_of(df, **kw):
    rows = detect.detect(df, "passengers", **kw).collect()
    return {(r["row_id"], r["column"], r["issue_type"]): r for r in rows}


def test_hard_level_on_the_dirty_fixture(dirty):
    found = issues_of(dirty)
    expected = {
        (1, "age", "null"): (None, None, "any", 0.9),
        (3, "age", "type_error"): (None, 28.5, "set", 1.0),
        (4, "age", "constraint"): (None, 5.0, "set", 0.95),
        (5, "fare", "outlier"): (None, 10.5, "set", 0.99),
        (8, "name", "duplicate"): (None, None, "delete", 1.0),
    }
    got = {k: (r["correct"], r["correct_num"], r["action"], r["confidence"]) for k, r in found.items()}
    assert got == expected
    assert found[(5, "fare", "outlier")]["issue_id"] == "passengers_5_fare_outlier"


def test_levels(dirty):
    assert set(issues_of(dirty, level="easy")) == {(1, "age", "null"), (3, "age", "type_error")}
    assert len(issues_of(dirty, level="medium")) == 4


def test_clean_table_has_no_issues(clean):
    for level in detect.LEVELS:
        assert issues_of(clean, level=level) == {}


def test_two_table_fixture(spark, classes):
    df = spark.createDataFrame(passenger_rows(fare5=12.0, name8="Heidi"), SCHEMA)
    found = issues_of(df, references={"classes": classes})
    assert set(found) == {(1, "age", "null"), (3, "age", "type_error"), (4, "age", "constraint")}


def test_structural_nulls_have_low_confidence(spark):
    rows = [(i, f"p{i}", "C1" if i > 8 else None) for i in range(1, 11)]
    found = issues_of(spark.createDataFrame(rows, "id long, name string, cabin string"), checks=("null",))
    assert len(found) == 8
    assert {r["confidence"] for r in found.values()} == {0.2}


def test_numeric_nulls_get_the_median(spark):
    rows = [(1, 1.0), (2, None), (3, 4.0), (4, float("nan"))]
    found = issues_of(spark.createDataFrame(rows, "id long, x double"), checks=("null",))
    assert {k[0]: r["correct_num"] for k, r in found.items()} == {2: 2.5, 4: 2.5}


def test_mostly_text_column_has_no_type_errors(spark):
    rows = [(i, "12" if i % 2 else "abc") for i in range(10)]
    assert issues_of(spark.createDataFrame(rows, "id long, t string"), checks=("type_error",)) == {}


def test_real_negative_balances_are_kept_unless_forced(spark):
    df = spark.createDataFrame([(1, -5.0), (2, 7.0), (3, 9.0), (4, 1.0)], "id long, balance double")
    assert issues_of(df, checks=("constraint",)) == {}
    rules = detect.learn(df, "t", checks=("constraint",), force_positive=["balance"])
    found = detect.detect(df, "t", checks=("constraint",), rules=rules).collect()
    assert [(r["row_id"], r["correct_num"]) for r in found] == [(1, 5.0)]


def test_whitespace_and_categories(spark):
    rows = [(1, "male"), (2, "male"), (3, "Male"), (4, " male "), (5, "FEMALE"), (6, "female"), (7, "a  b")]
    df = spark.createDataFrame(rows, "id long, sex string")
    spaces = issues_of(df, checks=("whitespace",))
    assert {k[0]: r["correct"] for k, r in spaces.items()} == {4: "male", 7: "a b"}
    kinds = issues_of(df, checks=("inconsistent_category",))
    # a tie goes to the spelling seen first
    assert {k[0]: r["correct"] for k, r in kinds.items()} == {3: "male", 6: "FEMALE"}


def test_more_than_twenty_values_are_no_category(spark):
    rows = [(i, f"v{i % 21}" if i else "V1") for i in range(100)]
    assert issues_of(spark.createDataFrame(rows, "id long, t string"), checks=("inconsistent_category",)) == {}
    rows = [(i, f"v{i % 19}" if i else "V1") for i in range(100)]
    assert len(issues_of(spark.createDataFrame(rows, "id long, t string"), checks=("inconsistent_category",))) == 1


def test_orphans(spark):
    orders = spark.createDataFrame([(i, i % 4 if i != 5 else None) for i in range(12)], "id long, cust_id int")
    custs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "cust_key long, name string")
    other = spark.createDataFrame([(3,)], "x long")
    found = issues_of(orders, checks=("fk_violation",), references={"other": other, "customers_cust": custs})
    assert {k[0] for k in found} == {3, 7, 11}
    # text keys compare with numbers by value
    texts = orders.select("id", F.col("cust_id").cast("string").alias("cust_id"))
    again = issues_of(texts, checks=("fk_violation",), references={"cust": custs})
    assert {k[0] for k in again} == {3, 7, 11}


def test_foreign_keys_fall_back_to_the_first_table():
    assert detect.foreign_keys(["id", "city_id"], "id", ["towns", "places"]) == {"city_id": "towns"}
    assert detect.foreign_keys(["id", "city_id"], "id", ["towns", "city"]) == {"city_id": "city"}
    assert detect.foreign_keys(["id", "city_id"], "id", []) == {}


@pytest.mark.parametrize("hot_rows", [10, 10_000_000])
def test_duplicates_with_a_hot_key(spark, hot_rows):
    """A third of all rows share one key; the salted and the plain join agree with brute force."""
    rng = random.Random(3)
    rows = [(i, "HOT " if rng.random() < 0.33 else f"k{rng.randint(0, 400)}") for i in range(1200)]
    rows[7] = (7, None)
    df = spark.createDataFrame(rows, "id long, code string").repartition(6)
    profile = prof.profile_table(df, "t", unique=None)
    rules = detect.Rules(profile, natural_key="code")
    got = {r["row_id"] for r in detect.detect_duplicates(df, rules, hot_rows=hot_rows).collect()}
    seen, expected = set(), set()
    for i, code in rows:
        if code is None:
            continue
        key = code.strip().lower()
        expected |= {i} if key in seen else set()
        seen.add(key)
    assert got == expected


@pytest.mark.parametrize("hot_rows", [10, 10_000_000])
def test_orphans_with_a_hot_key(spark, hot_rows):
    rng = random.Random(4)
    rows = [(i, -1 if rng.random() < 0.4 else rng.randint(0, 50)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, ref_id long")
    ref = spark.createDataFrame([(i,) for i in range(45)], "key long")
    rules = detect.Rules(prof.profile_table(df, "t", unique=None))
    got = {r["row_id"] for r in detect.detect_orphans(df, rules, {"ref": ref}, hot_rows=hot_rows).collect()}
    assert got == {i for i, k in rows if not 0 <= k < 45}


def test_same_issues_on_any_partitioning(dirty):
    key = ["issue_id", "correct_num", "confidence"]
    one = detect.detect(dirty.coalesce(1), "t").select(*key).orderBy("issue_id").collect()
    many = detect.detect(dirty.repartition(8), "t").select(*key).orderBy("issue_id").collect()
    assert one == many


def test_repaired_table_has_nothing_open(dirty):
    rules = detect.learn(dirty, "passengers")
    found = detect.detect(dirty, "passengers", rules=rules)
    fixed = repair.apply_corrections(dirty, found)
    assert detect.issues_remaining(found, fixed, rules.profile).where("remaining").count() == 0
    assert detect.issues_remaining(found, dirty, rules.profile).where("remaining").count() == 5


def test_outlier_fences_are_strict_and_need_spread(spark):
    flat = spark.createDataFrame([(i, 5.0 if i else 99.0) for i in range(8)], "id long, x double")
    assert issues_of(flat, checks=("outlier",)) == {}
    few = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 900.0)], "id long, x double")
    assert issues_of(few, checks=("outlier",)) == {}


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(i, None if i == 2 else f"n{i}") for i in range(6)], "id long, `full name.x` string")
    assert {k[:2] for k in issues_of(df)} == {(2, "full name.x")}


def test_rules_know_their_checks_and_repeated_ids_repeat_no_finding(spark, dirty):
    easy = detect.learn(dirty, "passengers", checks=detect.EASY)
    with pytest.raises(ValueError):
        detect.detect(dirty, "passengers", level="medium", rules=easy)
    twice = spark.createDataFrame([(1, None), (1, None), (2, 5.0), (3, 7.0)], "id long, x double")
    found = detect.detect(twice, "t", checks=("null",)).collect()
    assert [(r["issue_id"], r["correct_num"], r["confidence"]) for r in found] == [("t_1_x_null", 6.0, 0.5)]


def test_wide_tables(spark):
    """Cells are looked up by name without an expression per column."""
    names = [f"c{i}" for i in range(2000)]
    profile = prof.TableProfile("t", "id", 2, dict.fromkeys(names))
    kinds = [F.lit(str(i)) if i % 3 else F.lit(float(i)) for i in range(2000)]
    wide = spark.range(1, 3).select("id", *[k.alias(c) for k, c in zip(kinds, names, strict=True)])
    rows = [(1, "c1999", "null"), (2, "c0", "null"), (2, "nowhere", "null"), (9, "c1", "null"), (1, None, "duplicate")]
    asked = spark.createDataFrame(rows, "row_id long, column string, issue_type string")
    got = {(r["row_id"], r["column"]): (r["present"], r["cell"], r["cell_num"], r["cell_null"]) for r in detect.with_cell(asked, wide, profile).collect()}
    assert got == {
        (1, "c1999"): (True, "1999", 1999.0, False),
        (2, "c0"): (True, "0.0", 0.0, False),
        (2, "nowhere"): (True, None, None, True),
        (9, "c1"): (False, None, None, True),
        (1, None): (True, None, None, True),
    }
