import pytest
from pyspark.sql import functions as F

from mendframe.operators import compare, detect, profile as prof, repair


def values(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def fixes(spark, rows):
    return spark.createDataFrame(rows, "row_id long, column string, value string, step long")


def test_last_fix_wins_and_null_empties(spark, dirty):
    log = fixes(spark, [(2, "age", "30", 1), (2, "age", "31", 2), (3, "age", None, 3), (5, "fare", "12.5", 4)])
    out = repair.apply_fixes(dirty, log)
    assert out.schema == dirty.schema
    assert values(out, "age")[2] == "31" and values(out, "age")[3] is None
    assert values(out, "fare")[5] == 12.5 and values(out, "fare")[1] == 10.5


def test_values_take_the_type_of_the_column(spark, clean):
    sent = fixes(spark, [(1, "age", "28.0", 1), (2, "age", "abc", 1), (3, "age", None, 1)])
    report = repair.fix_report(clean, sent)
    before, after = values(clean, "age"), values(report.table, "age")
    # what does not fit leaves the cell as it was, and is told
    assert after[1] == 28 and after[2] == before[2] and after[3] is None
    assert [r["value"] for r in report.rejected.collect()] == ["abc"]


def test_a_perfect_repair_of_whole_numbers_resolves_them(spark):
    from mendframe.operators import detect, score

    df = spark.createDataFrame([(i, n, f"k{i}") for i, n in enumerate([10, None, 11, 12, 13, None])], "id long, n int, k string")
    rules = detect.learn(df, "t", checks=("null",))
    issues = detect.detect(df, "t", rules=rules, checks=("null",))
    done = repair.apply_corrections(df, issues)
    assert values(done, "n")[1] == 11.5 and values(repair.auto_impute(df, rules.profile), "n")[5] == 11.5
    got = score.resolve(issues, done, rules.profile).collect()
    assert len(got) == 2 and all(r["resolved"] == r["confidence"] for r in got)


def test_columns_that_come_and_go_are_changes(spark):
    from mendframe.operators import compare

    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, k string, gone string")
    new = spark.createDataFrame([(1, "a", "n"), (2, "b", "")], "id long, k string, extra string")
    found = sorted((r["row_id"], r["column"], r["change"]) for r in compare.changes(old, new).collect())
    assert found == [(1, "extra", "changed"), (1, "gone", "dropped")]


def test_unknown_targets_are_reported(spark, dirty):
    report = repair.fix_report(dirty, fixes(spark, [(99, "age", "1", 1), (1, "nope", "1", 1), (1, "age", "9", 1)]))
    assert [r["row_id"] for r in report.unknown_rows.collect()] == [99]
    assert [r["column"] for r in report.unknown_columns.collect()] == ["nope"]
    assert values(report.table, "age")[1] == "9"


def test_fix_column(spark):
    df = spark.createDataFrame([(1, None, ""), (2, 3.0, "x"), (3, 4.0, None)], "id long, n double, t string")
    p = prof.profile_table(df, "t", unique=None)
    assert values(repair.fix_column(df, p, "n", "5"), "n") == {1: 5.0, 2: 3.0, 3: 4.0}
    assert values(repair.fix_column(df, p, "t", "u"), "t") == {1: "u", 2: "x", 3: "u"}
    assert repair.fix_column_counts(df, p, "t", "u").first().asDict() == {
        "nulls_fixed": 2, "type_errors_fixed": 0, "negatives_fixed": 0, "total_fixed": 2,
    }
    with pytest.raises(ValueError):
        repair.fix_column(df, p, "missing", 1)


def test_fix_column_repairs_a_later_version(spark):
    """The profile is the one of the loaded table; new defects are still repaired."""
    loaded = spark.createDataFrame([(1, "3"), (2, "4")], "id long, n string")
    p = prof.profile_table(loaded, "t", unique=None)
    broken = spark.createDataFrame([(1, "x"), (2, "-4"), (3, None)], "id long, n string")
    assert values(repair.fix_column(broken, p, "n", "5"), "n") == {1: "5", 2: "4.0", 3: "5"}
    assert repair.fix_column_counts(broken, p, "n", "5").first()["total_fixed"] == 3


def test_delete_rows(spark, dirty):
    ids = spark.createDataFrame([(2,), (99,)], "row_id long")
    assert sorted(values(repair.delete_rows(dirty, ids), "name")) == [1, 3, 4, 5, 6, 7, 8, 9, 10]


def test_imputation_policy(spark):
    rows = [(i, float(i) if i < 4 else None, "a" if i < 3 else None, "z" if i == 0 else None, 7 if i else None) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, t string, sparse string, k long")
    p = prof.profile_table(df, "t", unique=None)
    assert repair.imputation_values(df, p) == {"x": 1.5, "t": "a", "sparse": "Unknown", "k": 7.0}
    out = repair.auto_impute(df, p)
    assert prof.null_cells(prof.profile_table(out, "t", unique=None)) == 0


def test_all_corrections(dirty):
    found = detect.detect(dirty, "passengers")
    out = repair.apply_corrections(dirty, found)
    assert out.count() == 9
    assert values(out, "age")[1] == "0" and values(out, "age")[3] == "28.5" and values(out, "fare")[5] == 10.5


def test_in_place_repair_equals_the_joined_one(spark):
    rows = [(i, "a" if i % 3 else " A", None if i % 7 == 0 else str(i - 2), 1.0 if i != 9 else 5000.0 + i) for i in range(1, 60)]
    rows = [(r[0], r[1], r[2], r[3] + r[0] % 4) for r in rows]
    df = spark.createDataFrame(rows, "id long, t string, n string, x double")
    rules = detect.learn(df, "t", checks=detect.MEDIUM)
    found = detect.detect(df, "t", checks=detect.MEDIUM, rules=rules)
    joined = repair.apply_corrections(df, found)
    in_place = repair.repair_in_place(df, rules)
    assert found.count() > 20
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, in_place.collect()))


def test_changes(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None)], "id long, t string, x double")
    after = spark.createDataFrame([(1, "A ", 1.00001), (2, "z", None), (4, "n", 1.0)], "id long, t string, x double")
    got = {(r["row_id"], r["column"], r["change"]) for r in compare.changes(before, after).collect()}
    assert got == {(2, "t", "changed"), (2, "x", "changed"), (3, None, "removed"), (4, None, "added")}
    assert compare.cell_diff(before, before.repartition(3)).count() == 0


def test_type_change_is_no_difference(spark):
    before = spark.createDataFrame([(1, 28)], "id long, x long")
    after = before.select("id", F.col("x").cast("string").alias("x"))
    assert compare.cell_diff(before, after).count() == 0
