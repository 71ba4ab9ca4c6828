import random

import pytest
from pyspark.sql import functions as F

from mendframe.operators import actions, compare, detect, inject, profile as prof, repair

LOG = "episode string, step long, action_type string, row_id long, column string, value string, checks_passed int, total_checks int, join_valid boolean, open_issues long"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(i, f"n{i}", rng.uniform(10, 20), rng.randint(1, 9)) for i in range(200)]
    return spark.createDataFrame(rows, "id long, name string, x double, k long")


def test_injection_is_ground_truth(table):
    p = prof.profile_table(table, "t")
    dirty, planted = inject.inject_errors(table, p, 30, natural_key="name")
    truth = planted.collect()
    assert len(truth) == 30 and {r["issue_type"] for r in truth} == set(inject.PLANT_ORDER)
    assert not {r["column"] for r in truth} & {"id", "name"}
    assert len({(r["row_id"], r["column"]) for r in truth}) == 30
    changed = {(r["row_id"], r["column"]) for r in compare.cell_diff(table, dirty).collect()}
    assert changed == {(r["row_id"], r["column"]) for r in truth}
    cells = {(r["id"], c): r[c] for r in dirty.collect() for c in ("x", "k")}
    for r in truth:
        value = cells[(r["row_id"], r["column"])]
        if r["issue_type"] == "null":
            assert value is None
        elif r["issue_type"] == "type_error":
            assert value == inject.INVALID_TEXT
        else:
            assert float(value) == -r["correct_num"]


def test_same_seed_same_cells(table):
    p = prof.profile_table(table, "t")
    pick = lambda df, seed: {r["issue_id"] for r in inject.inject_errors(df, p, 12, seed)[1].collect()}
    assert pick(table, 42) == pick(table.repartition(7), 42) != pick(table, 43)


def test_injected_errors_are_detected(table):
    p = prof.profile_table(table, "t")
    dirty, planted = inject.inject_errors(table, p, 12, checks=("null", "type_error"), natural_key="name")
    found = detect.detect(dirty, "t", checks=("null", "type_error"))
    assert planted.join(found, ["row_id", "column", "issue_type"], "left_anti").count() == 0


def test_cells_with_issues_are_left_alone(spark, table):
    p = prof.profile_table(table, "t")
    taken = table.where("id < 195").select(
        F.col("id").alias("row_id"), F.explode(F.array(F.lit("x"), F.lit("k"))).alias("column")
    )
    _, planted = inject.inject_errors(table, p, 4, issues=taken, natural_key="name")
    assert all(r["row_id"] >= 195 for r in planted.collect())


def test_top_up_reaches_the_minimum(clean):
    dirty, found = inject.top_up(clean, "passengers", "hard")
    assert found.count() == 7
    again, same = inject.top_up(clean, "passengers", "easy")
    assert same.count() == 3 and again.count() == 10


def test_decoy(table):
    p = prof.profile_table(table, "t")
    issues = detect.empty_issues(table)
    out, decoys = inject.inject_decoy(table, p, issues)
    d = decoys.first()
    assert d["decoy_value"] == round(d["original"] * 2, 2)
    diff = compare.cell_diff(table, out).collect()
    assert [(r["row_id"], r["column"]) for r in diff] == [(d["row_id"], d["column"])]
    assert inject.decoy_column(p, busy=["x"]) == "k" and inject.decoy_column(p, busy=["x", "k"]) == "x"


# -- action log --------------------------------------------------------------


@pytest.fixture(scope="module")
def audit(spark, dirty):
    rules = detect.learn(dirty, "passengers")
    found = detect.detect(dirty, "passengers", rules=rules)
    rows = found.collect()
    return dirty, rules.profile, spark.createDataFrame(rows, found.schema)


def rewards(spark, audit, rows, **kw):
    dirty, profile, issues = audit
    full = [("e", i + 1, *r, *([None] * (8 - len(r)))) for i, r in enumerate(rows)]
    log = spark.createDataFrame(full, LOG)
    out = actions.action_rewards(log, issues, {"passengers": dirty}, profile, **kw)
    return [r["total"] for r in out.orderBy("step").collect()]


def test_investigation_caps(spark, audit):
    assert rewards(spark, audit, [("inspect",)] * 5) == [0.02, 0.02, 0.02, 0, 0]
    assert rewards(spark, audit, [("profile_column",)] * 4) == [0.03, 0.03, 0.03, 0]
    assert rewards(spark, audit, [("select_tables",)] * 3, n_tables=2) == [0.02, 0.02, 0]
    assert rewards(spark, audit, [("select_tables",)]) == [0]
    check = ("validate", None, None, None, 3, 6)
    assert rewards(spark, audit, [check] * 3) == [0.025, 0.025, 0]


def test_fix_rewards(spark, audit):
    got = rewards(
        spark, audit,
        [
            ("fix_cell", 1, "age", "30"), ("fix_cell", 1, "age", " "), ("fix_cell", 3, "age", "forty"),
            ("fix_cell", 3, "age", "40"), ("fix_cell", 4, "age", "5"), ("fix_cell", 5, "fare", "12"),
            ("fix_cell", 5, "fare", "900"), ("fix_cell", 2, "name", "Rob"), ("fix_cell", 2, "name", "bob"),
            ("fix_cell", 99, "name", "x"), ("fix_cell", None, "name", "x"), ("fix_cell", 2, None, "x"),
        ],
    )
    assert got == [0.15, -0.1, -0.1, 0.15, 0.15, 0.15, -0.1, -0.2, 0, -0.2, -0.2, -0.2]


def test_other_rewards(spark, audit):
    got = rewards(
        spark, audit,
        [
            ("delete_row", 8), ("delete_row", 2), ("delete_row",), ("fix_column", None, "age"),
            ("fix_column", None, "fare"), ("fix_column",), ("submit", None, None, None, None, None, None, 0),
            ("submit", None, None, None, None, None, None, 2), ("join_tables", None, None, None, None, None, True),
            ("join_tables", None, None, None, None, None, False), ("join_tables",), ("export",), ("dance",),
        ],
    )
    # two of five issues are nulls or type errors in that column
    assert got == [0.15, -0.2, -0.2, 0.27, -0.1, -0.2, 0.1, -0.1, 0.2, -0.2, 0, 0, 0]


def test_intents(spark, audit):
    log = [
        ("fix_cell", 1, "age", "30"), ("fix_cell", 5, "fare", "12"), ("delete_row", 8), ("fix_column", None, "age"),
        ("classify_intent", None, None, "Visualization "), ("classify_intent", None, None, "ml_training"),
        ("classify_intent", None, None, "??"),
    ]
    got = rewards(spark, audit, log, intent="visualization", correct_intent="visualization")
    assert got == pytest.approx([0.20, 0.15, 0.12, 0.32, 0.10, -0.10, -0.05])
    assert rewards(spark, audit, log[4:])[:2] == [0, 0]


def test_decoys_cost_most(spark, audit):
    decoys = spark.createDataFrame([(2, "fare", 14.5)], "row_id long, column string, decoy_value double")
    assert rewards(spark, audit, [("fix_cell", 2, "fare", "7.25")], decoys=decoys) == [-0.4]


def test_hot_cells_and_long_episodes(spark, audit):
    """Most of the log is one cell of one episode; spread and plain joins agree."""
    log = [("fix_cell", 1, "age", "30")] * 60 + [("inspect",)] * 60 + [("fix_cell", 2, "name", "x")] * 5
    spread = rewards(spark, audit, log, hot_rows=10)
    assert spread == rewards(spark, audit, log) == [0.15] * 60 + [0.02] * 3 + [0] * 57 + [-0.2] * 5


def test_episode_totals(spark, audit):
    dirty, profile, issues = audit
    rows = [("a", 1, "inspect"), ("a", 2, "submit"), ("b", 1, "run_sql"), ("b", 2, "run_sql")]
    log = spark.createDataFrame(rows, "episode string, step long, action_type string")
    out = actions.action_rewards(log, issues, {"passengers": dirty}, profile)
    finals = spark.createDataFrame([("a", 0.9)], "episode string, score double")
    got = {r["episode"]: r for r in actions.episode_totals(out, finals).collect()}
    assert got["a"]["reward"] == pytest.approx(0.92) and got["a"]["investigations"] == 1 and got["a"]["penalty"] == -0.1
    assert got["b"]["reward"] == pytest.approx(0.06) and got["b"]["steps"] == 2
    assert actions.episode_totals(out).where("episode = 'a'").first()["reward"] == pytest.approx(-0.08)


def test_injected_lookup_errors(spark):
    from mendframe.operators import dimension

    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(12)], "id long, t string")
    dim = dimension.extract(df, prof.profile_table(df, "t"))
    facts, lookup = inject.inject_lookup_errors(dim)
    assert facts.where("t_ref = 1002").count() == 1 and lookup.where("label is null").count() == 1
    assert repair.delete_rows(facts, facts.where("t_ref = 1002").select(F.col("id").alias("row_id"))).count() == 11


def test_repeated_steps_are_not_multiplied(spark, audit):
    dirty, profile, issues = audit
    log = spark.createDataFrame([("e", 1, "inspect"), ("e", 1, "inspect"), ("e", 1, "run_sql"), ("e", 2, "inspect")], "episode string, step long, action_type string")
    out = actions.action_rewards(log, issues, {"passengers": dirty}, profile)
    assert sorted(r["total"] for r in out.collect()) == [0.02, 0.02, 0.02, 0.03]


def test_cells_that_share_a_place_go_by_row_id(table):
    p = prof.profile_table(table, "t")
    _, planted = inject.inject_errors(table, p, 7, checks=("null",), natural_key="name", order=F.lit(5).cast("long"))
    found = sorted((r["column"], r["row_id"]) for r in planted.collect())
    assert len(found) == 7
    assert all([row for c, row in found if c == column] == list(range(sum(c == column for c, _ in found))) for column in "xk")


def test_more_errors_wanted_than_cells(table):
    p = prof.profile_table(table, "t")
    _, planted = inject.inject_errors(table.limit(0), p, 7, checks=("null",), natural_key="name")
    assert planted.count() == 0
    few = table.where("id < 3")
    assert inject.inject_errors(few, prof.profile_table(few, "t"), 50, checks=("null",), natural_key="name")[1].count() == 6


def test_planting_ranks_only_cells_that_share_a_place(table):
    p = prof.profile_table(table, "t")
    plan = inject.inject_errors(table, p, 30, natural_key="name")[1]._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window [") :]
    assert "tie" in window and window.count("Window [") == 1
