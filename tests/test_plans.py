"""The physical plans of the operators that must stay cheap on large tables."""

import pytest
from pyspark.sql import functions as F

from mendframe.operators import actions, detect, frequency, profile as prof, repair


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory, dirty):
    path = str(tmp_path_factory.mktemp("plans") / "t.parquet")
    dirty.withColumn("unused", F.lit("x")).write.parquet(path)
    return spark.read.parquet(path)


def test_cell_rules_and_in_place_repair_do_not_shuffle(stored):
    df = stored.drop("unused")
    rules = detect.learn(df, "t", checks=detect.MEDIUM)
    for frame in (detect.detect_cells(df, rules, detect.MEDIUM), repair.repair_in_place(df, rules)):
        text = plan(frame)
        assert "Exchange" not in text and "unused" not in text


def test_z_scores_read_only_numeric_columns(stored):
    text = plan(prof.z_scores(stored, prof.profile_table(stored, "t", unique=None)))
    assert "Exchange" not in text and "name" not in text.split("ReadSchema")[1]


def test_frequencies_aggregate_before_the_shuffle(stored):
    text = plan(frequency.distinct_counts(stored, ["name", "age"]))
    before, after = text.index("Exchange"), text.rindex("HashAggregate")
    assert after > before  # a partial aggregate below the exchange


def test_capped_steps_limit_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    spark.range(100).selectExpr("'e' episode", "id step", "'inspect' action_type").write.parquet(path)
    text = plan(actions.capped_steps(spark.read.parquet(path)))
    assert "WindowGroupLimit" in text and text.rindex("WindowGroupLimit") > text.rindex("Exchange")


def test_small_issue_table_is_broadcast_against_the_large_one(spark, stored, tmp_path):
    df = stored.drop("unused")
    found = detect.detect(df, "t")
    path = str(tmp_path / "issues.parquet")
    found.write.parquet(path)
    state = detect.with_cell(spark.read.parquet(path), df, prof.profile_table(df, "t", unique=None))
    assert "BroadcastHashJoin" in plan(state) and "LeftSemi" in plan(state)
