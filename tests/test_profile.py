import random
import statistics

import pytest
from pyspark.sql import functions as F

from mendframe.operators import detect, frequency, profile as prof, quantiles


def test_fixture_profile(spark, dirty):
    p = prof.profile_table(dirty, "passengers", medians="all", modes="all", samples=True)
    assert [p[c].dtype for c in dirty.columns] == ["int", "str", "str", "float", "int"]
    assert p["fare"].mean == pytest.approx(59.908) and p["fare"].must_be_positive
    assert p["age"].null_count == 1 and p["age"].castable == 8
    assert p["name"].unique_count == 9 and p["name"].all_unique is False and p["id"].all_unique
    assert p["fare"].median == pytest.approx(10.125)
    assert p["name"].mode == "Alice" and p["survived"].mode == "1"
    assert p["age"].sample_values == ["25", "FORTY", "-5", "28", "45"]
    table = p.to_df(spark)
    assert table.count() == 5
    assert table.where("column = 'age'").first()["mean"] is None


def test_dtypes_of_other_columns(spark):
    df = spark.sql(
        "select id, cast(id as double) whole, id + 0.5D frac, cast(null as string) empty, id > 2 flag, "
        "current_date() d, cast(id as string) txt, cast(id as decimal(10,2)) dec from range(5)"
    )
    p = prof.profile_table(df, "t", unique=None)
    got = {c: p[c].dtype for c in df.columns}
    assert got == {
        "id": "int", "whole": "int", "frac": "float", "empty": "unknown", "flag": "bool", "d": "unknown",
        "txt": "int", "dec": "int",
    }


def test_zero_std_gives_zero_z(spark):
    df = spark.createDataFrame([(i, 4.0) for i in range(5)], "id long, x double")
    p = prof.profile_table(df, "t", unique=None)
    z = prof.z_scores(df, p).where("column = 'x'").collect()
    assert len(z) == 5 and {r["z"] for r in z} == {0.0}


def test_natural_key(spark, dirty):
    p = prof.profile_table(dirty, "t", unique=None)
    assert prof.natural_key(dirty, p)[0] == "name"
    numbers = spark.createDataFrame([(i, 2.0 * i, 3.0 * i) for i in range(1, 6)], "id long, x double, y double")
    assert prof.natural_key(numbers, prof.profile_table(numbers, "t", unique=None))[0] is None


def test_primary_key(spark):
    df = spark.createDataFrame([(1, 7, "a"), (1, 8, "b")], "cust_id long, order_id long, x string")
    assert prof.primary_key(df) == "order_id"
    assert prof.primary_key(df.select("x", "cust_id")) == "x"


def test_long_texts_are_counted_exactly(spark):
    texts = ["x" * 100 + str(i % 3) for i in range(9)] + ["short"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    counts = {r["column"]: r["unique_count"] for r in frequency.distinct_counts(df, ["t"]).collect()}
    assert counts == {"t": 4}
    mode = frequency.modes(df, ["t"], "id").first()
    # ties go to the value seen first
    assert mode["mode"] == "x" * 100 + "0" and mode["n"] == 3


def test_samples_of_sparse_columns(spark):
    rows = [(i, f"v{i}" if i % 40 == 0 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    p = prof.profile_table(df, "t", unique=None)
    got = prof.sample_values(df, p, head_rows=50).where("column = 't'").orderBy("position").collect()
    assert [r["value"] for r in got] == ["v0", "v40", "v80", "v120", "v160"]


def test_approximate_counts(spark):
    df = spark.range(2000).select("id", F.col("id").cast("string").alias("t"))
    p = prof.profile_table(df, "t", unique="approx")
    assert abs(p["t"].unique_count - 2000) < 300


def test_null_cells_leave_out_the_id(spark):
    df = spark.createDataFrame([(None, None), (1, " ")], "id long, t string")
    assert prof.null_cells(prof.profile_table(df, "t", unique=None)) == 2


@pytest.mark.parametrize("kind", ["ties", "spread", "skewed", "negative", "two"])
def test_order_statistics_against_sorting(spark, kind):
    rng = random.Random(kind)
    make = {
        "ties": lambda i: float(rng.choice([1, 2, 2, 2, 3])),
        "spread": lambda i: rng.uniform(-1e6, 1e6),
        "skewed": lambda i: 10.0 ** rng.randint(-8, 12) if i % 3 else 7.0,
        "negative": lambda i: -float(i),
        "two": lambda i: 0.0 if i % 2 else 1e308,
    }[kind]
    for n in (4, 5, 97, 1000):
        values = [make(i) for i in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
        ranks = sorted({0, n - 1, *quantiles.quartile_ranks(n), *quantiles.median_ranks(n)})
        ordered = sorted(values)
        want, ends = {("x", k): ordered[k] for k in ranks}, {"x": (min(values), max(values), n)}
        # tiny limits force several narrowing rounds
        assert quantiles.narrowed(df, {"x": F.col("x")}, {"x": ranks}, ends, exact_up_to=10, bins=8) == want
        # coarse sketches make wide brackets, which may touch
        for accuracy in (5, 40, None):
            assert quantiles.values_at_ranks(df, {"x": F.col("x")}, {"x": ranks}, ends, accuracy=accuracy) == want


def test_ranks_of_several_columns_take_two_scans(spark, monkeypatch):
    """Heavy ties, wide spreads and whole numbers: no rank has to be narrowed down."""
    df = spark.range(100_000).selectExpr(
        "(id * 7919) % 100000 + 0.5D x", "case when id % 3 = 0 then 7D else pow(10, id % 20 - 8) end y", "id % 4 z", "cast(null as double) none"
    ).repartition(6)
    monkeypatch.setattr(quantiles, "_narrow", None)
    ranks = {c: [0, 25_000, 49_999, 50_000, 75_000, 99_999] for c in "xyz"}
    rows = {c: sorted(r[c] for r in df.select(c).collect()) for c in "xyz"}
    ends = {c: (v[0], v[-1], len(v)) for c, v in rows.items()}
    group = "two scans"
    spark.sparkContext.setJobGroup(group, group)
    got = quantiles.values_at_ranks(df, {c: F.col(c) for c in "xyz"}, ranks, ends)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(c, k): rows[c][k] for c in "xyz" for k in ranks[c]}
    assert 0 < len(jobs) <= 8  # the stages of two queries


def test_a_missed_bracket_is_narrowed_down(spark, monkeypatch):
    df = spark.range(1000).selectExpr("cast(id as double) x")
    monkeypatch.setattr(quantiles, "_brackets", lambda *a: {"x": [(10.0, 20.0)]})
    got = quantiles.values_at_ranks(df, {"x": F.col("x")}, {"x": [5, 15, 700]}, {"x": (0.0, 999.0, 1000)})
    assert got == {("x", 5): 5.0, ("x", 15): 15.0, ("x", 700): 700.0}


def test_median_of_several_columns(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1), rng.randint(0, 9)) for i in range(301)]
    df = spark.createDataFrame(rows, "id long, a double, b long")
    p = prof.profile_table(df, "t", unique=None, medians="all")
    assert p["a"].median == statistics.median(r[1] for r in rows)
    assert p["b"].median == statistics.median(r[2] for r in rows)


def test_approximate_order_statistics_are_near(spark):
    n = 60_001
    df = spark.range(n).select("id", ((F.col("id") * 7919) % n).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    p = prof.profile_table(df, "t", unique=None, medians="approx")
    assert abs(p["x"].median - n // 2) <= 2 * n / 10_000 and p["none"].median is None
    near, exact = (detect.learn(df, "t", checks=("outlier",), approx=a).fences["x"] for a in (True, False))
    assert abs(near.low - exact.low) <= 10 * n / 10_000 and abs(near.high - exact.high) <= 10 * n / 10_000


def test_one_column_has_the_statistics_of_the_whole_profile(dirty):
    whole = prof.profile_table(dirty, "t", medians="all", modes="all", samples=True)
    for c in dirty.columns:
        one = prof.profile_column(dirty, "t", c)
        assert (one.mean, one.median, one.mode, one.unique_count, one.sample_values) == (
            whole[c].mean, whole[c].median, whole[c].mode if c != "id" else one.mode, whole[c].unique_count, whole[c].sample_values,
        )
