"""Profiles and open issues from a diff, against profiling and judging again."""

import math
import random
from dataclasses import asdict

import pytest

from mendframe.operators import delta, detect, profile as prof, repair
from mendframe.session import materialize
from samples import SCHEMA, passenger_rows

WIDE = "id long, n long, x double, f float, t string, b boolean, c string"


def rows_of(rng, n):
    text = ["1", " 2.5 ", "", None, "word", "-3", "1e3", "Word"]
    return [
        (i, rng.choice([None, rng.randrange(-50, 50)]), rng.choice([None, rng.random() * 100, float("nan")]), rng.choice([None, 0.1, 2.7]), rng.choice(text), rng.choice([None, True, False]), rng.choice("abc"))
        for i in range(n)
    ]


def altered(rng, rows):
    out = []
    for r in rows:
        if rng.random() < 0.15:
            continue
        r = list(r)
        for at, values in ((1, [None, 7, 900]), (2, [None, 1e6, -5.5]), (3, [None, 9.25]), (4, [None, "", "4", "text"]), (5, [None, True]), (6, ["d", None])):
            if rng.random() < 0.2:
                r[at] = rng.choice(values)
        out.append(tuple(r))
    return out + rows_of(rng, 3)[:0] + [(10_000 + i, *r[1:]) for i, r in enumerate(rows_of(rng, 5))]


def same_profile(got, want):
    skipped = {"hash_bits", "median", "mode", "sample_values", "unique_count"}
    assert set(got.columns) == set(want.columns) and got.row_count == want.row_count
    for c, p in want.columns.items():
        for k, v in asdict(p).items():
            mine = getattr(got[c], k)
            if k in skipped:
                continue
            if isinstance(v, float) and mine is not None:
                assert math.isclose(mine, v, rel_tol=1e-9, abs_tol=1e-7), (c, k, mine, v)
            else:
                assert mine == v, (c, k, mine, v)


@pytest.mark.parametrize("seed", range(4))
def test_profile_follows_random_changes(spark, seed):
    rng = random.Random(seed)
    old = rows_of(rng, 120)
    before, after = spark.createDataFrame(old, WIDE), spark.createDataFrame(altered(rng, old), WIDE)
    diff = materialize(delta.cell_changes(before, after))
    counts = delta.updated_value_counts(delta.value_counts(before, ["t", "c"]), diff, ["t", "c"])
    got = delta.updated_profile(prof.profile_table(before, "t", unique=None), diff, after, counts)
    want = prof.profile_table(after, "t")
    same_profile(got, want)
    assert [got[c].unique_count for c in "tc"] == [want[c].unique_count for c in "tc"]
    fresh = delta.value_counts(after, ["t", "c"])
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, fresh.collect()))


def test_changes_of_a_repeated_application_add_up(spark):
    rng = random.Random(9)
    versions = [rows_of(rng, 80)]
    for _ in range(3):
        versions.append(altered(rng, [r for r in versions[-1] if r[0] < 10_000]))
    frames = [spark.createDataFrame(v, WIDE) for v in versions]
    profile = prof.profile_table(frames[0], "t", unique=None)
    for a, b in zip(frames, frames[1:]):
        profile = delta.updated_profile(profile, materialize(delta.cell_changes(a, b)), b)
    same_profile(profile, prof.profile_table(frames[-1], "t", unique=None))


def test_only_a_lost_extreme_is_read_again(spark, monkeypatch):
    before = spark.createDataFrame([(i, float(i), float(i)) for i in range(50)], "id long, x double, y double")
    after = before.selectExpr("id", "case when x = 49 then 3 else x end x", "case when y = 20 then 3 when y = 49 then 99 else y end y")
    profile = prof.profile_table(before, "t", unique=None)
    diff = materialize(delta.cell_changes(before, after))
    read = []
    real = prof.number_columns
    monkeypatch.setattr(prof, "number_columns", lambda df, columns: read.append(list(columns)) or real(df, columns))
    got = delta.updated_profile(profile, diff, after)
    assert read == [["x"]] and (got["x"].max, got["y"].max, got["x"].min) == (48.0, 99.0, 0.0)
    read.clear()
    low = before.selectExpr("id", "case when x = 5 then 6 else x end x", "y")
    delta.updated_profile(profile, materialize(delta.cell_changes(before, low)), low)
    assert read == []


def test_nothing_changed_or_everything_gone(spark, dirty):
    profile = prof.profile_table(dirty, "p", unique=None)
    none = delta.updated_profile(profile, materialize(delta.cell_changes(dirty, dirty)), dirty)
    same_profile(none, profile)
    empty = dirty.limit(0)
    gone = delta.updated_profile(profile, materialize(delta.cell_changes(dirty, empty)), empty)
    same_profile(gone, prof.profile_table(empty, "p", unique=None))
    back = delta.updated_profile(gone, materialize(delta.cell_changes(empty, dirty)), dirty)
    same_profile(back, profile)


def test_columns_that_come_and_go(spark, dirty):
    after = dirty.withColumnRenamed("fare", "price").drop("survived")
    got = delta.updated_profile(prof.profile_table(dirty, "p", unique=None), materialize(delta.cell_changes(dirty, after)), after)
    same_profile(got, prof.profile_table(after, "p", unique=None))


def test_open_issues_follow_a_repair(spark, dirty):
    rules = detect.learn(dirty, "passengers")
    issues = detect.detect(dirty, "passengers", rules=rules)
    found = materialize(delta.open_issues(issues, dirty, rules.profile))
    versions = [
        dirty,
        repair.apply_corrections(dirty, issues),
        spark.createDataFrame([r for r in passenger_rows(fare5=20.0) if r[0] not in (3, 8)], SCHEMA),
        dirty.drop("age"),
    ]
    for after in versions:
        diff = materialize(delta.cell_changes(dirty, after))
        got = {r["issue_id"]: r["remaining"] for r in delta.updated_issues(found, diff, rules.profile).collect()}
        if "age" in after.columns:
            want = {r["issue_id"]: r["remaining"] for r in detect.issues_remaining(issues, after, rules.profile).collect()}
            assert got == want
        else:
            assert got == {r["issue_id"]: True if r["column"] != "age" else r["issue_type"] == "null" for r in issues.collect()}


def test_the_plan_reads_the_diff_only(spark, dirty):
    rules = detect.learn(dirty, "passengers")
    found = materialize(delta.open_issues(detect.detect(dirty, "passengers", rules=rules), dirty, rules.profile), "found")
    diff = materialize(delta.cell_changes(dirty, dirty.where("id > 2")), "diff")
    files = delta.updated_issues(found, diff, rules.profile).inputFiles()
    assert files and all("/found-" in f or "/diff-" in f for f in files)
    assert all("/diff-" in f for f in delta.change_sums(diff).inputFiles())
