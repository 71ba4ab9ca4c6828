"""Tables stored by id: what joins them moves no rows."""

import re

import pytest

from mendframe.operators import detect, repair, score
from mendframe.plans import flow
from mendframe.session import STEPS, drop_steps, materialize_by
from samples import SCHEMA, passenger_rows


@pytest.fixture
def sort_merge(spark):
    """Joins as large tables have them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df):
    """What is dealt out by a key; gathering one row per task for a final sum is not."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Exchange (\w+)", plan) if x != "SinglePartition"]


@pytest.fixture
def scanned(spark, dirty, sort_merge):
    return flow.scan(dirty, "passengers", store=True)


def test_round_trip(spark, dirty):
    stored = materialize_by(dirty, "id", "Odd name!", buckets=3)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, dirty.collect()))
    assert stored.columns == dirty.columns
    assert len(stored.inputFiles()) <= 3
    empty = materialize_by(dirty.limit(0), "id")
    assert empty.count() == 0 and empty.columns == dirty.columns


def test_odd_key_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "`my id.x` long, v string")
    assert materialize_by(df, "my id.x").count() == 2


def test_diff_counts_move_nothing(spark, scanned):
    cleaned = flow.store_version(scanned, repair.apply_corrections(scanned.data, scanned.issues))
    counts = score.change_counts(scanned.data, cleaned, scanned.issues)
    assert exchanges(counts) == []
    plain = flow.scan(spark.createDataFrame(passenger_rows(), SCHEMA), "passengers")
    same = score.change_counts(plain.data, repair.apply_corrections(plain.data, plain.issues), plain.issues)
    assert exchanges(same) != []
    assert counts.collect() == same.collect()


def test_corrections_and_resolution_move_nothing(scanned):
    fixed = repair.apply_corrections(scanned.data, scanned.issues)
    assert exchanges(fixed) == []
    cleaned = flow.store_version(scanned, fixed, placed=True)
    assert exchanges(score.resolve(scanned.issues, cleaned, scanned.profile)) == []
    assert exchanges(detect.issues_remaining(scanned.issues, cleaned, scanned.profile)) == []
    assert exchanges(score.resolution_scores(score.resolve(scanned.issues, cleaned, scanned.profile), {"all": None, "easy": detect.EASY})) == []
    assert {r["id"] for r in cleaned.collect()} == {r["id"] for r in fixed.collect()}


def test_reported_rows_and_dropped_columns(spark, scanned):
    removed = spark.createDataFrame([(2,), (3,)], "row_id long")
    after = flow.store_version(scanned, scanned.data.where("id NOT IN (2, 3, 4)").drop("name"))
    counts = score.change_counts(scanned.data, after, scanned.issues, removed=removed).head()
    # three rows are gone: two were reported, the fourth has an issue
    assert (counts["changes"], counts["false_positives"]) == (3, 0)


def test_unique_ids_spare_the_merge_of_findings(dirty):
    rules = detect.learn(dirty, "passengers")
    once = detect.detect(dirty, "passengers", rules=rules)
    spared = detect.detect(dirty, "passengers", rules=rules, unique_ids=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, spared.collect()))


def test_resolution_scores_of_no_issues(spark, scanned):
    none = score.resolve(scanned.issues.limit(0), scanned.data, scanned.profile)
    rows = score.resolution_scores(none, {"all": None, "easy": detect.EASY}).collect()
    assert [tuple(r) for r in rows] == [("all", 1.0), ("easy", 1.0)]


def test_steps_are_dropped(spark, dirty):
    materialize_by(dirty, "id")
    assert spark.sql(f"SHOW TABLES IN {STEPS}").count() > 0
    drop_steps(spark)
    assert STEPS not in {d.name for d in spark.catalog.listDatabases()}
    assert materialize_by(dirty, "id").count() == 10


def test_scan_of_several_tables(spark, dirty, classes):
    rides = dirty.withColumn("classes_id", dirty["id"])
    found = flow.scan_tables({"rides": rides, "classes": classes})
    assert found.table == "rides"
    assert {r["row_id"] for r in found.issues.where("issue_type = 'fk_violation'").collect()} == {6, 7, 8, 9, 10}
    assert flow.scan_tables({"rides": rides, "classes": classes}, "classes").table == "classes"
    for tables, primary in (({}, None), ({"rides": rides}, "classes")):
        with pytest.raises(ValueError):
            flow.scan_tables(tables, primary)
