import pytest
from pyspark.sql import functions as F

from mendframe.operators import detect, outcome, profile as prof, repair, score, validate
from mendframe.plans import flow


@pytest.fixture(scope="module")
def scanned(dirty):
    s = flow.scan(dirty, "passengers")
    rows = s.issues.collect()
    return flow.Scan(s.table, s.data, s.rules, dirty.sparkSession.createDataFrame(rows, s.issues.schema))


def graded(scanned, cleaned, level="hard", **kw):
    parts = score.components(
        scanned.data, cleaned, scanned.issues, scanned.profile, scanned.rules.natural_key, **kw
    )
    return score.score(level, parts).first()


def with_cell(df, row_id, column, value):
    return df.withColumn(column, F.when(F.col("id") == row_id, F.lit(value)).otherwise(F.col(column)))


@pytest.mark.parametrize("level", ["easy", "medium", "hard", "generic"])
def test_no_change_scores_the_minimum(scanned, level):
    row = graded(scanned, scanned.data, level)
    assert row["raw"] == 0.0 and row["score"] == 0.01


def test_full_fix_scores_high(scanned):
    fixed = repair.apply_corrections(scanned.data, scanned.issues)
    assert graded(scanned, fixed, "easy")["score"] >= 0.59
    assert graded(scanned, fixed, "medium")["score"] >= 0.50
    assert 0 < graded(scanned, fixed, "hard")["score"] < 1
    assert graded(scanned, fixed)["false_positives"] == 0


def test_untouched_clean_table_is_not_punished(clean):
    s = flow.scan(clean, "passengers")
    assert graded(s, clean, "easy")["score"] > 0.9


def test_false_positives_lower_the_score_up_to_a_cap(scanned):
    fixed = repair.apply_corrections(scanned.data, scanned.issues)
    one = graded(scanned, with_cell(fixed, 2, "name", "Zed"))
    assert one["false_positives"] == 1 and one["fp_penalty"] == pytest.approx(0.05)
    many = graded(scanned, fixed.withColumn("fare", F.col("fare") + 100))
    assert many["fp_penalty"] == pytest.approx(0.35)
    assert many["score"] < one["score"] < graded(scanned, fixed)["score"]


def test_unreported_deletion_counts_reported_does_not(spark, scanned):
    fixed = repair.apply_corrections(scanned.data, scanned.issues).where("id <> 2")
    assert graded(scanned, fixed)["false_positives"] == 1
    told = spark.createDataFrame([(2,), (8,)], "row_id long")
    assert graded(scanned, fixed, removed=told)["false_positives"] == 0


def test_skipping_validation_halves_that_part(scanned):
    fixed = repair.apply_corrections(scanned.data, scanned.issues)
    yes, no = graded(scanned, fixed), graded(scanned, fixed, validated=False)
    assert no["validation"] == pytest.approx(yes["validation"] / 2, abs=1e-4) and no["score"] < yes["score"]


def test_decoy_and_reasoning(spark, scanned):
    fixed = repair.apply_corrections(scanned.data, scanned.issues)
    decoys = spark.createDataFrame(
        [("passengers", 2, "fare", 7.25, 3.6)], "table string, row_id long, column string, decoy_value double, original double"
    )
    kept = graded(scanned, fixed, decoys=decoys)
    touched = graded(scanned, with_cell(fixed, 2, "fare", 3.6), decoys=decoys)
    assert kept["decoy_penalty"] == 0.0 and touched["decoy_penalty"] == 0.4 and touched["score"] < kept["score"]
    log = spark.createDataFrame([("looked at the Z-Score",), (None,)], "reason string")
    assert graded(scanned, fixed, log=log)["reasoning_bonus"] == 0.05


def test_unknown_level(scanned):
    with pytest.raises(ValueError):
        graded(scanned, scanned.data, "nightmare")


def test_resolution_rules(spark, scanned):
    """Each rule on a hand-made cleaned table."""
    cleaned = scanned.data.where("id <> 8")
    cleaned = with_cell(cleaned, 1, "age", "40")
    cleaned = with_cell(cleaned, 3, "age", "1")
    cleaned = with_cell(cleaned, 4, "age", "26")
    cleaned = with_cell(cleaned, 5, "fare", 500.0)
    got = {r["issue_type"]: r["resolved"] for r in score.resolve(scanned.issues, cleaned, scanned.profile).collect()}
    assert got["null"] == 0.9 and got["type_error"] == 1.0 and got["duplicate"] == 1.0
    # positive but more than five times the correct value
    assert got["constraint"] == pytest.approx(0.7 * 0.95)
    # 3.2 std from the median
    assert got["outlier"] == pytest.approx(0.7 * 0.99)
    gone = {
        r["issue_type"]: r["resolved"]
        for r in score.resolve(scanned.issues, scanned.data.limit(0), scanned.profile).collect()
    }
    assert gone == {
        "null": 0.45, "type_error": 0.5, "constraint": pytest.approx(0.475), "outlier": pytest.approx(0.495),
        "duplicate": 1.0,
    }


def test_validation_before_and_after(scanned):
    checks = {r["name"]: r for r in validate.validate(scanned.data, scanned.issues, scanned.profile, "name").collect()}
    assert {n for n, r in checks.items() if not r["passed"]} == {
        "null_check", "type_check", "range_check", "duplicate_check",
    }
    fixed = repair.apply_corrections(scanned.data, scanned.issues)
    checks = {r["name"]: r for r in validate.validate(fixed, scanned.issues, scanned.profile, "name").collect()}
    assert checks["null_check"]["passed"] and checks["duplicate_check"]["after"] == {"rows": 0.0}
    # replacing the outlier moves the mean
    assert not checks["distribution_check"]["passed"]
    assert any("fare" in w for w in checks["distribution_check"]["warnings"])
    touched = validate.validate(fixed, scanned.issues, scanned.profile, "name", touched=["fare"])
    assert not any("fare" in w for w in touched.where("name = 'distribution_check'").first()["warnings"])


def test_overall(spark):
    def of(*passed):
        frame = spark.createDataFrame([(p,) for p in passed], "passed boolean")
        return validate.overall(frame).first()["overall"]

    assert (of(True, True), of(False, False), of(True, False)) == ("PASS", "FAIL", "PARTIAL")


def test_flow_end_to_end(dirty):
    done = flow.clean(flow.scan(dirty, "passengers", store=True), "medium")
    assert done.cleaned.count() == 9 and done.checks.count() == 6
    assert done.score.first()["score"] >= 0.50
    # the repair itself moved the mean of the fares, so no check calls them untouched
    assert not any(w.startswith(("fare", "age")) for r in done.checks.collect() for w in r["warnings"])
    decoys = dirty.sparkSession.createDataFrame([(2, "fare", 14.5)], "row_id long, column string, decoy_value double")
    marked = flow.clean(flow.scan(dirty, "passengers", store=True), "hard", decoys=decoys)
    assert marked.score.first()["decoy_penalty"] == 0.4


def test_intent_alignment(scanned):
    fixed = repair.apply_corrections(scanned.data, scanned.issues)

    def of(intent, cleaned):
        return outcome.intent_alignment(intent, scanned.data, cleaned, scanned.issues, scanned.profile).first()[0]

    assert of("dashboard", fixed) == 1.0 and of("visualization", scanned.data.limit(8)) == 0.85
    assert of("visualization", scanned.data.limit(5)) == 0.5
    # the outlier of the fixture is within three std of the mean it inflated
    assert of("ml_training", fixed) == 1.0 and of("ml_training", scanned.data) == pytest.approx(1 / 3)
    assert of("reporting", fixed) == 1.0 and of(None, fixed) == 0.8


def test_over_cleaning_and_nulls(scanned, clean):
    pen = outcome.over_cleaning(scanned.data, scanned.data.limit(5), scanned.issues).first()[0]
    assert pen == pytest.approx(0.20)
    assert outcome.over_cleaning(scanned.data, scanned.data.limit(8), scanned.issues).first()[0] == 0.0
    p = prof.profile_table(clean, "t", unique=None)
    assert outcome.downstream_nulls(clean, p).first()["downstream"] == 1.0
    assert outcome.downstream_nulls(clean.limit(0), p).first()["downstream"] == 0.0
    holes = clean.withColumn("fare", F.when(F.col("id") > 6, F.col("fare")))
    assert outcome.downstream_nulls(holes, p).first()["downstream"] == 0.5


def test_join_quality(spark):
    schema = "table1 string, table2 string, valid boolean"
    def of(rows, table="ctx"):
        return outcome.join_quality(spark.createDataFrame(rows, schema), table).first()[0]

    assert of([("a", "ctx", True)]) == 1.0 and of([("a", "ctx", False)]) == 0.3 and of([]) == 0.5
    assert of([], None) == 1.0


def test_ml_bands():
    assert outcome.ml_band(0.0) == 0.75 and outcome.ml_band(0.04) == pytest.approx(0.85)
    assert outcome.ml_band(0.5) == 1.0 and outcome.ml_band(-0.1) == pytest.approx(0.5) and outcome.ml_band(-0.9) == 0.30


def test_downstream_ml(spark):
    rows = [(i, float(i), float(i % 3), "yes" if i > 20 else "no") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y string")
    p = prof.profile_table(df, "t")
    row = outcome.downstream_ml(df, df, p).first()
    assert row["target"] == "y" and row["downstream"] == 0.75 and row["accuracy_before"] > 0.9
    assert outcome.downstream_ml(df.drop("b"), df.drop("b"), prof.profile_table(df.drop("b"), "t")).first()["downstream"] == 0.75


def test_issue_free_resolution(spark, scanned):
    none = scanned.issues.limit(0)
    resolved = score.resolve(none, scanned.data, scanned.profile)
    assert score.resolution_score(resolved).first()["score"] == 1.0


def test_levels_are_known():
    assert set(detect.LEVELS) == {"easy", "medium", "hard"}


def test_classifier_has_the_default_l2_term(spark):
    """Separable rows, which without a penalty have no finite optimum."""
    assert outcome.penalty_strength(50) == 0.02
    rows = [(i, float(i), float(i % 3), "yes" if i > 5 else "no") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y string")
    row = outcome.downstream_ml(df, df.withColumn("a", F.lit(0.0)), prof.profile_table(df, "t")).first()
    assert row["accuracy_before"] == 1.0 and row["downstream"] == 0.30
