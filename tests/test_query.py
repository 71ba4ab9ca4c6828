import random

import pytest
from pyspark.sql import functions as F

from mendframe.operators import dimension, profile as prof, query, report, skew


@pytest.mark.parametrize(
    "sql",
    ["", "  ", "DELETE FROM t", "SELECT 1; SELECT 2", "DROP TABLE classes", "with x as (select 1) select * from x",
        "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM range(3)", "SELECT java_method('java.lang.System', 'gc')", "SELECT (SELECT reflect('a', 'b'))",
        "SELECT * FROM parquet.`/tmp/x`", "SELECT 1 WHERE 1 IN (SELECT a FROM nowhere)", "SET a=b", "INSERT INTO t SELECT 1", "CACHE TABLE t"],
)
def test_refused_queries(spark, sql):
    with pytest.raises(query.QueryError):
        query.query(spark, sql)


def test_query_reads_registered_tables(spark, classes):
    classes.createOrReplaceTempView("classes")
    got = query.query(spark, 'SELECT "class_name", min_fare FROM classes ORDER BY min_fare DESC').collect()
    assert len(got) == 5 and got[0]["class_name"] == "First"
    assert query.query(spark, "SELECT * FROM range(200)").count() == 200
    assert query.query(spark, "SELECT * FROM range(200)", limit=50).count() == 50
    many = spark.range(100).selectExpr("id", "cast(id as string) AS c", "1.0 AS x")
    assert query.category_counts(many, "c").count() == 100 and query.group_summary(many, "c", "x").count() == 100
    with pytest.raises(query.QueryError):
        query.query(spark, "SELECT nope FROM classes")
    assert "classes" in query.table_names(spark) and query.columns(spark, "classes")[0] == "id"
    assert query.select_tables(spark, ["classes", "zzz"]) == (["classes"], ["zzz"])
    with pytest.raises(query.QueryError):
        query.rows(spark, "zzz")


def test_join_of_the_two_table_fixture(spark, dirty, classes):
    joined = query.join_tables(dirty, classes, "id")
    assert joined.rows.count() == 10 and "t2_id" in joined.rows.columns
    d = joined.diagnostics.first()
    assert d["match_rate"] == 0.5 and d["key_unique"] and d["valid"] and d["rows_joined"] == 10
    with pytest.raises(query.QueryError):
        query.join_tables(dirty, classes, "nope")


def test_cartesian_join_is_invalid(spark):
    a = spark.createDataFrame([(1,), (1,), (1,)], "k int")
    d = query.join_tables(a, a, "k").diagnostics.first()
    assert d["rows_joined"] == 9 and not d["valid"] and not d["key_unique"]


def test_key_resolution():
    assert query.other_key("k", ["id", "k"]) == "k"
    assert query.other_key("kind_ref", ["x", "kind_id"]) == "kind_id"
    assert query.other_key("kind_ref", ["id", "kind_id"]) == "id"
    assert query.other_key("a", ["b", "c"]) == "b" and query.other_key("a", []) is None
    assert query.shared_key(["id", "a", "b"], ["b", "id"]) == "b"
    assert query.shared_key(["id", "a"], ["c"]) == "a"


@pytest.mark.parametrize("hot_rows", [20, 10_000_000])
def test_left_join_with_hot_and_null_keys(spark, hot_rows):
    rng = random.Random(8)
    keys = [None if rng.random() < 0.2 else 1 if rng.random() < 0.5 else rng.randint(2, 40) for _ in range(600)]
    left = spark.createDataFrame(list(enumerate(keys)), "id long, k long").repartition(4)
    right = spark.createDataFrame([(i, f"r{i}") for i in range(30)] + [(1, "again")], "k long, name string")
    got = query.join_tables(left, right, "k", t1_rows=600, hot_rows=hot_rows).rows
    names = {}
    for k, n in [(i, f"r{i}") for i in range(30)] + [(1, "again")]:
        names.setdefault(k, []).append(n)
    expected = sorted((i, k or -1, n or "") for i, k in enumerate(keys) for n in (names.get(k) or [None]))
    assert sorted((r["id"], r["k"] or -1, r["name"] or "") for r in got.collect()) == expected


def test_joins_spread_without_being_told(spark):
    left = spark.createDataFrame([(i, None if i % 5 == 0 else 1) for i in range(100)], "id long, k long")
    joined = query.join_tables(left, spark.createDataFrame([(1, "a")], "k long, v string"), "k", hot_rows=20).rows
    assert "_salt" in joined._jdf.queryExecution().analyzed().toString()
    assert joined.where("v = 'a'").count() == 80 and joined.count() == 100


def test_hot_threshold_bounds_the_broadcast():
    assert skew.hot_threshold(100) == skew.HOT_ROWS
    assert skew.hot_threshold(10**12) * skew.MAX_HOT_KEYS >= 10**12


def test_summaries(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.005), (3, "b", 9.0), (4, None, 4.0)], "id long, c string, Fare double")
    rows = query.group_summary(df, "c", "Fare").collect()
    assert rows[0]["c"] == "a" and rows[0]["count"] == 2 and rows[0]["max_fare"] == 2.01
    assert [r["id"] for r in query.top_rows(df, "Fare", 2).collect()] == [3, 4]
    assert [r["id"] for r in query.top_rows(df, "Fare", 2, largest=False).collect()] == [1, 2]
    assert query.category_counts(df, "c").first()["count"] == 2


def test_dimension(spark):
    rows = [(1, "Red"), (2, "blue"), (3, "RED "), (4, None), (5, "green"), (6, "blue")]
    df = spark.createDataFrame(rows, "id long, colour string")
    dim = dimension.extract(df, prof.profile_table(df, "t"))
    assert dim.lookup_name == "colour_context"
    assert [tuple(r) for r in dim.lookup.orderBy("id").collect()] == [(1, "Red"), (2, "blue"), (3, "green")]
    refs = {r["id"]: r["colour_ref"] for r in dim.facts.collect()}
    assert refs == {1: 1, 2: 2, 3: 1, 4: None, 5: 3, 6: 2}
    wide = spark.range(50).select("id", F.col("id").cast("string").alias("t"))
    p = prof.profile_table(wide, "t")
    assert dimension.extract(wide, p) is None
    with pytest.raises(ValueError):
        dimension.extract(wide, p, "t")


def test_dimension_prefers_the_fewest_values(spark):
    rows = [(i, i % 2, i % 5, f"k{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, two long, five long, three string")
    assert dimension.pick_column(prof.profile_table(df, "t")) == "three"


def test_reports(dirty):
    from mendframe.operators import detect

    rules = detect.learn(dirty, "passengers")
    found = detect.detect(dirty, "passengers", rules=rules)
    row = report.quality_report(found, rules.profile).first()
    assert row["issues"] == 5 and row["quality"] == pytest.approx(87.5) and row["grade"] == "Good"
    health = {r["column"]: r["health"] for r in report.column_health(found, rules.profile).collect()}
    assert health == {"name": "Fair", "age": "Poor", "fare": "Fair", "survived": "Good"}
    roles = dict(report.column_roles(prof.profile_table(dirty, "p")))
    assert roles["survived"] == "target" and roles["fare"] == "metric"
    assert report.issue_sample(found).count() == 5 and report.preview(dirty, n=3).count() == 3
