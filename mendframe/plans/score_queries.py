"""Registered queries: validation, scoring and outcome measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from mendframe.operators import detect, outcome, profile as prof, repair, score, validate
from mendframe.plans import check_sql as sql, inputs
from mendframe.plans.flow import store_version
from mendframe.plans.profile_queries import PARTS, REMAINING, orders_scan
from mendframe.plans.registry import register

# -- validation --------------------------------------------------------------

# state of the cleaned table, per column that a check looks at
_AFTER = f"""WITH {sql.ORDERS}, {sql.ISSUES}, {sql.CLEANED},
 kx AS (SELECT *, {sql.number("amount")} AS x FROM k),
 st AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(customer_id) AS cm, stddev_pop(customer_id) AS cs,
  avg(id) AS im FROM d),
 af AS (SELECT count(*) filter (where {sql.blank("amount")}) AS nulls,
  count(*) filter (where not {sql.blank("amount")} and x is null) AS bad, count(*) filter (where x<0) AS neg,
  avg(price) AS pm2, avg(customer_id) AS cm2, avg(id) AS im2,
  count(order_code)-count(distinct lower(order_code)) AS dups FROM kx),
 o AS (SELECT i."column", case i."column" when 'price' then abs(k.price-pm)/ps else abs(k.customer_id-cm)/cs end AS z
  FROM i JOIN st ON true LEFT JOIN k ON i.row_id=k.id WHERE issue_type='outlier'),
 b AS (SELECT (SELECT count(*) FROM d WHERE {sql.blank("amount")}) AS nulls,
  (SELECT max(confidence) FROM i WHERE issue_type='null') AS nc,
  (SELECT count(*) FROM i WHERE issue_type='type_error') AS bad, (SELECT count(*) FROM i WHERE issue_type='constraint') AS neg,
  (SELECT count(*) FROM i WHERE issue_type='duplicate') AS dups, (SELECT count(*) FROM i WHERE issue_type='outlier') AS outs,
  (SELECT count(*) FROM o WHERE z>5) AS outs2),
 ck AS (
 SELECT 'null_check' AS name, not (nc>0.5) or af.nulls=0 AS passed, 'amount' AS what, b.nulls::DOUBLE AS before, af.nulls::DOUBLE AS after FROM af, b
 UNION ALL SELECT 'type_check', b.bad=0 or af.bad=0, 'amount', b.bad, af.bad FROM af, b
 UNION ALL SELECT 'range_check', b.neg=0 or af.neg=0, 'amount', b.neg, af.neg FROM af, b
 UNION ALL SELECT 'distribution_check', abs(pm2-pm)/pm<0.2 and abs(cm2-cm)/cm<0.2 and abs(im2-im)/im<0.2, 'price', round(pm,4), round(pm2,4) FROM af, st
 UNION ALL SELECT 'distribution_check', abs(pm2-pm)/pm<0.2 and abs(cm2-cm)/cm<0.2 and abs(im2-im)/im<0.2, 'customer_id', round(cm,4), round(cm2,4) FROM af, st
 UNION ALL SELECT 'distribution_check', abs(pm2-pm)/pm<0.2 and abs(cm2-cm)/cm<0.2 and abs(im2-im)/im<0.2, 'id', round(im,4), round(im2,4) FROM af, st
 UNION ALL SELECT 'duplicate_check', b.dups=0 or af.dups<b.dups or af.dups=0, 'rows', b.dups, af.dups FROM af, b
 UNION ALL SELECT 'outlier_check', outs2=0, 'rows', outs, outs2 FROM b)"""


def _checks(spark, sf_dir):
    s = orders_scan(spark, sf_dir, store=True)
    cleaned = store_version(s, inputs.orders_cleaned(spark, sf_dir))
    return validate.validate(cleaned, s.issues, s.profile, s.rules.natural_key)


@register("validate_checks", f"{_AFTER} SELECT * FROM ck")
def validate_checks(spark, sf_dir):
    checks = _checks(spark, sf_dir)
    return checks.select(
        "name", "passed", "after", F.explode("before").alias("what", "before")
    ).select(
        "name",
        "passed",
        "what",
        F.round("before", 4).alias("before"),
        F.round(F.try_element_at("after", F.col("what")), 4).alias("after"),
    )


_OVERALL = """t AS (SELECT count(*) AS total_checks, count(*) filter (where passed) AS checks_passed
 FROM (SELECT DISTINCT name, passed FROM ck))"""


@register(
    "validate_overall",
    f"""{_AFTER}, {_OVERALL} SELECT checks_passed, total_checks, case when checks_passed=total_checks then 'PASS'
 when checks_passed=0 then 'FAIL' else 'PARTIAL' end AS overall FROM t""",
)
def validate_overall(spark, sf_dir):
    return validate.overall(_checks(spark, sf_dir))


# -- scoring -----------------------------------------------------------------

_HIT = f"""coalesce(case when x is not null and coalesce(correct_num,{sql.number("correct")}) is not null
 then abs(x-coalesce(correct_num,{sql.number("correct")})) <= 1e-4*greatest(abs(x),abs(coalesce(correct_num,{sql.number("correct")})))
 else lower({sql.strip("cell")})=lower({sql.strip("coalesce(correct, cast(correct_num as varchar))")}) end, false)"""
_RESOLVED = f"""case
 when issue_type in ('duplicate','fk_violation') then case when present then 0.0 else 1.0 end
 when issue_type='null' then case when not present then 0.5*confidence when {sql.blank("cell")} then 0.0
  when action='any' or {_HIT} then confidence else 0.0 end
 when issue_type='type_error' then case when not present then 0.5 when not {sql.blank("cell")} and x is not null then 1.0 else 0.0 end
 when issue_type='constraint' then case when not present then 0.5*confidence when x is null or x<0 then 0.0
  when correct_num is null or x<=abs(correct_num)*5 then confidence else 0.7*confidence end
 when issue_type='outlier' then case when not present then 0.5*confidence when x is null then 0.0
  when {_HIT} or abs(x-correct_num)/std<=2.0 then confidence when abs(x-correct_num)/std<=4.0 then 0.7*confidence
  when abs(x-mean)/std<=3.0 then confidence when abs(x-mean)/std<=5.0 then 0.5*confidence else 0.0 end
 when issue_type='whitespace' then case when not present or {sql.blank("cell")} or {sql.squeeze("cell")}<>cell then 0.0 else confidence end
 else case when not present or {sql.blank("cell")} then 0.0 when {_HIT} then confidence else 0.0 end end"""
_ISSUE_STATE = f"{REMAINING}, rs AS (SELECT *, cast({_RESOLVED} as double) AS resolved FROM c)"


@register("resolution_per_issue", f"{_ISSUE_STATE} SELECT issue_id, resolved FROM rs")
def resolution_per_issue(spark, sf_dir):
    s = orders_scan(spark, sf_dir, store=True)
    return score.resolve(s.issues, inputs.orders_cleaned(spark, sf_dir), s.profile).select("issue_id", "resolved")


def _share_sql(types):
    listed = ",".join(f"'{t}'" for t in types)
    return f"sum(resolved*confidence) filter (where issue_type in ({listed}))/sum(confidence) filter (where issue_type in ({listed}))"


@register(
    "resolution_score",
    f"""{_ISSUE_STATE} SELECT 'all' AS issues, round(sum(resolved*confidence)/sum(confidence),6) AS score FROM rs
 UNION ALL SELECT 'easy', round({_share_sql(detect.EASY)},6) FROM rs
 UNION ALL SELECT 'medium', round({_share_sql(detect.MEDIUM)},6) FROM rs""",
)
def resolution_score(spark, sf_dir):
    s = orders_scan(spark, sf_dir, store=True)
    resolved = score.resolve(s.issues, store_version(s, inputs.orders_cleaned(spark, sf_dir)), s.profile)
    return score.resolution_scores(resolved, {"all": None, "easy": detect.EASY, "medium": detect.MEDIUM}).select(
        "issues", F.round("score", 6).alias("score")
    )


def _differs(column, text):
    a, b = f"d.{column}", f"k.{column}"
    if not text:
        return f"(d.{column}<>k.{column} and abs(d.{column}-k.{column})>1e-4*greatest(abs(d.{column}),abs(k.{column})))"
    na, nb = sql.number(a), sql.number(b)
    return f"""not (case when {a} is null and {b} is null then true when {a} is null or {b} is null then false
 when {na} is not null and {nb} is not null then abs({na}-{nb}) <= 1e-4*greatest(abs({na}),abs({nb}))
 else lower({sql.strip(a)})=lower({sql.strip(b)}) end)"""


_CHANGES = (
    "ch AS ("
    + " UNION ALL ".join(
        f"""SELECT d.id, '{c}' AS col FROM d JOIN k ON d.id=k.id WHERE {_differs(c, t)}"""
        for c, t in (
            ("customer_id", False), ("amount", True), ("price", False), ("priority", True), ("order_code", True),
        )
    )
    + """), gone AS (SELECT id FROM d WHERE id NOT IN (SELECT id FROM k)),
 fp AS (SELECT (SELECT count(*) FROM ch)+(SELECT count(*) FROM gone) AS changes,
  (SELECT count(*) FROM ch WHERE not exists (SELECT 1 FROM i WHERE i.row_id=ch.id AND i."column"=ch.col))
  +(SELECT count(*) FROM gone WHERE not exists (SELECT 1 FROM i WHERE i.row_id=gone.id)) AS false_positives)"""
)


@register(
    "fp_penalty",
    f"""WITH {sql.ORDERS}, {sql.ISSUES}, {sql.CLEANED}, {_CHANGES}
 SELECT changes, false_positives, round(least(false_positives*0.05,0.35),4)::DOUBLE AS fp_penalty FROM fp""",
)
def fp_penalty(spark, sf_dir):
    s = orders_scan(spark, sf_dir)
    counts = score.change_counts(s.data, inputs.orders_cleaned(spark, sf_dir), s.issues)
    return counts.withColumn("fp_penalty", F.round(score.fp_penalty(F.col("false_positives")), 4))


@register(
    "fp_penalty_below_cap",
    f"""WITH {sql.ORDERS}, {sql.ISSUES}, ch AS (SELECT id FROM d WHERE id%4001=7),
 fp AS (SELECT count(*) AS changes, count(*) filter (where not exists
  (SELECT 1 FROM i WHERE i.row_id=ch.id AND i."column"='customer_id')) AS false_positives FROM ch)
 SELECT changes, false_positives, round(least(false_positives*0.05,0.35),4)::DOUBLE AS fp_penalty FROM fp""",
)
def fp_penalty_below_cap(spark, sf_dir):
    """A cleaner that touches few cells, each a customer."""
    s = orders_scan(spark, sf_dir, store=True)
    touched = F.when(F.col("id") % 4001 == 7, F.col("customer_id") + 5_000_000).otherwise(F.col("customer_id"))
    counts = score.change_counts(s.data, s.data.withColumn("customer_id", touched), s.issues)
    return counts.withColumn("fp_penalty", F.round(score.fp_penalty(F.col("false_positives")), 4))


# high prices stand in for planted decoys: real values that must not be touched
_DECOYS = "dc AS (SELECT id AS row_id, 'price' AS col, price AS decoy_value FROM d WHERE price between 495000 and 500000)"


def _decoys(spark, sf_dir):
    dirty = inputs.orders_dirty(spark, sf_dir)
    return dirty.where("price between 495000 and 500000").select(
        F.lit("orders_dirty").alias("table"),
        F.col("id").alias("row_id"),
        F.lit("price").alias("column"),
        F.col("price").alias("decoy_value"),
        (F.col("price") / 2).alias("original"),
    )


_DECOY_HIT = """dh AS (SELECT case when count(*) filter (where k.id is null or abs(k.price-decoy_value)>1e-4*greatest(k.price,decoy_value))>0
 then 0.4 else 0.0 end::DOUBLE AS decoy_penalty FROM dc LEFT JOIN k ON dc.row_id=k.id)"""


@register("decoy_penalty", f"WITH {sql.ORDERS}, {sql.CLEANED}, {_DECOYS}, {_DECOY_HIT} SELECT decoy_penalty FROM dh")
def decoy_penalty(spark, sf_dir):
    profile = prof.profile_table(inputs.orders_dirty(spark, sf_dir), "orders_dirty", unique=None)
    return score.decoy_penalty(_decoys(spark, sf_dir), inputs.orders_cleaned(spark, sf_dir), profile)


@register(
    "decoy_penalty_touched",
    f"""WITH {sql.ORDERS}, {sql.CLEANED}, dc AS (SELECT id AS row_id, price AS decoy_value FROM d WHERE price>100000000),
 {_DECOY_HIT} SELECT (SELECT count(*) FROM dc) AS decoys, decoy_penalty FROM dh""",
)
def decoy_penalty_touched(spark, sf_dir):
    """Decoys among the prices that the cleaner does change."""
    dirty = inputs.orders_dirty(spark, sf_dir)
    profile = prof.profile_table(dirty, "orders_dirty", unique=None)
    decoys = dirty.where("price > 100000000").select(
        F.lit("orders_dirty").alias("table"), F.col("id").alias("row_id"), F.lit("price").alias("column"), F.col("price").alias("decoy_value")
    )
    penalty = score.decoy_penalty(decoys, inputs.orders_cleaned(spark, sf_dir), profile)
    both = decoys.agg(F.count(F.lit(1)).alias("decoys")).unionByName(penalty, allowMissingColumns=True)
    return both.agg(F.max("decoys").alias("decoys"), F.max("decoy_penalty").alias("decoy_penalty"))


_TERMS = " or ".join(f"contains(lower(text),'{t}')" for t in score.REASON_TERMS)
_BONUS = f"rb AS (SELECT case when count(*) filter (where {_TERMS})>0 then 0.05 else 0.0 end::DOUBLE AS reasoning_bonus FROM conversations)"


def _reasons(spark, sf_dir):
    """What was said in the conversations, as the reasons of an action log."""
    return inputs.table(spark, sf_dir, "conversations").select(F.col("text").alias("reason"))


@register("reasoning_bonus", f"WITH {_BONUS} SELECT reasoning_bonus FROM rb")
def reasoning_bonus(spark, sf_dir):
    return score.reasoning_bonus(_reasons(spark, sf_dir))


_REASON = "event_type || case when value > 100 then ' is above the Mean' else ' is as usual' end"


@register(
    "reasoning_bonus_by_event",
    f"""SELECT event_type, case when count(*) filter (where {_TERMS.replace("text", f"({_REASON})")})>0 then 0.05 else 0.0 end::DOUBLE AS reasoning_bonus
 FROM events GROUP BY event_type""",
)
def reasoning_bonus_by_event(spark, sf_dir):
    """Reasons that name a statistic, for each kind of event."""
    reasons = inputs.table(spark, sf_dir, "events").select("event_type", F.expr(_REASON).alias("reason"))
    return score.reasoning_bonus(reasons, by=["event_type"])


_LEVELS = f"""{_AFTER}, {_OVERALL}, {_CHANGES}, {_DECOYS}, {_DECOY_HIT}, {_BONUS},
 s0 AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(customer_id) AS cm, stddev_pop(customer_id) AS cs FROM d),
 c AS (SELECT i.*, k.id IS NOT NULL AS present,
   case "column" when 'amount' then {sql.number("k.amount")} when 'price' then k.price when 'customer_id' then k.customer_id end AS x,
   case "column" when 'price' then ps when 'customer_id' then cs end AS std,
   case "column" when 'price' then pm when 'customer_id' then cm end AS mean,
   case "column" when 'amount' then k.amount when 'priority' then k.priority when 'order_code' then k.order_code
    when 'price' then cast(k.price as varchar) when 'customer_id' then cast(k.customer_id as varchar) end AS cell
  FROM i LEFT JOIN k ON i.row_id=k.id, s0),
 rs AS (SELECT *, cast({_RESOLVED} as double) AS resolved FROM c),
 r AS (SELECT sum(resolved*confidence)/sum(confidence) AS ra, {_share_sql(detect.EASY)} AS re, {_share_sql(["constraint"])} AS rc,
  {_share_sql(["outlier"])} AS ro, {_share_sql(["duplicate"])} AS rd, {_share_sql(["fk_violation"])} AS rf FROM rs),
 v AS (SELECT round(checks_passed*1.0/total_checks,4) AS val FROM t),
 p0 AS (SELECT least(false_positives*0.05,0.35) AS fp FROM fp),
 e AS (SELECT greatest(0.0,least(1.0,cast(round(cast(0.70*re+0.30*val-fp as decimal(38,10)),4) as double))) AS easy FROM r, v, p0),
 m AS (SELECT greatest(0.0,least(1.0,cast(round(cast(0.70*easy+0.30*(coalesce(rc,1)+coalesce(ro,1)+coalesce(rd,1))/3-fp as decimal(38,10)),4) as double))) AS medium FROM e, r, p0),
 h AS (SELECT greatest(0.0,least(1.0,cast(round(cast(case when rf is null then medium+reasoning_bonus-decoy_penalty
   else 0.70*medium+0.30*rf+reasoning_bonus-decoy_penalty end as decimal(38,10)),4) as double))) AS hard FROM m, r, dh, rb),
 g AS (SELECT greatest(0.0,least(1.0,cast(round(cast(0.60*ra+0.30*val+0.10*reasoning_bonus-fp-decoy_penalty as decimal(38,10)),4) as double))) AS generic FROM r, v, p0, dh, rb)"""


def _components(spark, sf_dir):
    s = orders_scan(spark, sf_dir, store=True)
    cleaned = store_version(s, inputs.orders_cleaned(spark, sf_dir))
    parts = score.components(
        s.data,
        cleaned,
        s.issues,
        s.profile,
        natural_key=s.rules.natural_key,
        decoys=_decoys(spark, sf_dir),
        log=_reasons(spark, sf_dir),
    )
    return s, cleaned, parts


def _level(spark, sf_dir, level):
    return score.score(level, _components(spark, sf_dir)[2]).select("level", "raw", "score")


def _level_sql(level, source):
    return f"{_LEVELS} SELECT '{level}' AS level, {level} AS raw, cast(round(cast(0.01+0.98*{level} as decimal(38,10)),4) as double) AS score FROM {source}"


@register("score_easy", _level_sql("easy", "e"))
def score_easy(spark, sf_dir):
    return _level(spark, sf_dir, "easy")


@register("score_medium", _level_sql("medium", "m"))
def score_medium(spark, sf_dir):
    return _level(spark, sf_dir, "medium")


@register("score_hard", _level_sql("hard", "h"))
def score_hard(spark, sf_dir):
    return _level(spark, sf_dir, "hard")


@register("score_generic", _level_sql("generic", "g"))
def score_generic(spark, sf_dir):
    return _level(spark, sf_dir, "generic")


@register(
    "score_summary",
    f"""{_LEVELS}, a AS (SELECT 'easy' AS level, cast(round(cast(0.01+0.98*easy as decimal(38,10)),4) as double) AS score FROM e
  UNION ALL SELECT 'medium', cast(round(cast(0.01+0.98*medium as decimal(38,10)),4) as double) FROM m UNION ALL SELECT 'hard', cast(round(cast(0.01+0.98*hard as decimal(38,10)),4) as double) FROM h),
 w AS (SELECT * FROM a UNION ALL SELECT 'average', cast(round(cast(avg(score) as decimal(38,10)),4) as double) FROM a)
 SELECT level, score, case when score>=0.5 then 'Pass' else 'Fail' end AS result FROM w""",
)
def score_summary(spark, sf_dir):
    parts = score.with_levels(_components(spark, sf_dir)[2])
    levels = F.array(
        *[
            F.struct(F.lit(n).alias("level"), score.scaled(F.col(n)).alias("score"))
            for n in ("easy", "medium", "hard")
        ]
    )
    return score.summary(parts.select(F.explode(levels).alias("s")).select("s.*"))


@register(
    "score_unchanged",
    f"""WITH {sql.ORDERS}, {sql.ISSUES} SELECT 'easy' AS level, count(*) AS total_issues, cast(0 as bigint) AS changes,
 0.0::DOUBLE AS raw, 0.01::DOUBLE AS score FROM i""",
)
def score_unchanged(spark, sf_dir):
    """The dirty table handed back as it was."""
    s = orders_scan(spark, sf_dir, store=True)
    parts = score.components(s.data, s.data, s.issues, s.profile, natural_key=s.rules.natural_key)
    return score.score("easy", parts).select("level", "total_issues", "changes", "raw", "score")


# -- outcome -----------------------------------------------------------------

_SETTLED = f"""coalesce(case when not present then issue_type in ('duplicate','fk_violation')
 when issue_type='null' then not {sql.blank("cell")} when issue_type='type_error' then x is not null
 when issue_type='constraint' then x>=0 when issue_type='outlier' then std is null or std=0 or abs(x-mean)/std<=3.0
 when issue_type='whitespace' then not {sql.blank("cell")} and {sql.squeeze("cell")}=cell
 when issue_type='inconsistent_category' then {_HIT} else false end, false)"""


def _intent_sql(types):
    listed = ",".join(f"'{t}'" for t in types)
    return f"(SELECT count(*) filter (where {_SETTLED})*1.0/count(*) FROM c WHERE issue_type in ({listed}))"


_INTENTS = f"""{REMAINING}, kr AS (SELECT (SELECT count(*) FROM k)*1.0/(SELECT count(*) FROM d) AS kept),
 ia AS (SELECT 'visualization' AS intent, case when kept>=0.9 then 1.0 when kept>=0.8 then 0.85 when kept>=0.7 then 0.6 else kept end AS v FROM kr
 UNION ALL SELECT 'ml_training', {_intent_sql(outcome.ML_TYPES)}
 UNION ALL SELECT 'business_query', {_intent_sql(outcome.REPORTING_TYPES)}
 UNION ALL SELECT 'none', 0.8)"""


@register("intent_alignment", f"{_INTENTS} SELECT intent, round(cast(v as double),6) AS intent_alignment FROM ia")
def intent_alignment(spark, sf_dir):
    s = orders_scan(spark, sf_dir, store=True)
    cleaned, out = inputs.orders_cleaned(spark, sf_dir), None
    for intent in ("visualization", "ml_training", "business_query", "none"):
        row = outcome.intent_alignment(intent, s.data, cleaned, s.issues, s.profile).select(
            F.lit(intent).alias("intent"), F.round("intent_alignment", 6).alias("intent_alignment")
        )
        out = row if out is None else out.unionByName(row)
    return out


_RATIO = "case when r=0 then 1.0 when r<=0.05 then 0.9 when r<=0.15 then 0.7 when r<=0.3 then 0.5 else greatest(0.2,1.0-r) end"


@register(
    "downstream_nulls",
    f"""WITH {sql.PARTS}, c AS (SELECT 2*count(*) AS cells,
  count(*) filter (where size is null)+count(*) filter (where retail is null) AS null_cells FROM p),
 x AS (SELECT 'dirty' AS version, cells, null_cells, null_cells*1.0/cells AS r FROM c
  UNION ALL SELECT 'imputed', cells, 0, 0.0 FROM c)
 SELECT version, cells, null_cells, cast({_RATIO} as double) AS downstream FROM x""",
)
def downstream_nulls(spark, sf_dir):
    df = inputs.part_dirty(spark, sf_dir)
    profile = prof.profile_table(df, PARTS, unique=None)
    before = outcome.downstream_nulls(df, profile).select(F.lit("dirty").alias("version"), "*")
    after = outcome.downstream_nulls(repair.auto_impute(df, profile), profile)
    return before.unionByName(after.select(F.lit("imputed").alias("version"), "*"))


@register(
    "over_cleaning",
    f"""WITH {sql.ORDERS}, {sql.ISSUES}, n AS (SELECT (SELECT count(*) FROM d) AS a,
  (SELECT count(*) FROM d WHERE price>=150000) AS b, (SELECT count(*) FROM i WHERE action='delete') AS due)
 SELECT round(cast(case when (a-b)*1.0/a<=0.2 then 0.0 else least(0.2, 0.5*greatest(a-b-due,0)/a) end as double),6) AS over_cleaning FROM n""",
)
def over_cleaning(spark, sf_dir):
    """A cleaner that throws away every order below 150 000."""
    s = orders_scan(spark, sf_dir)
    kept = s.data.where("price >= 150000")
    return outcome.over_cleaning(s.data, kept, s.issues).select(F.round("over_cleaning", 6).alias("over_cleaning"))


_ATTEMPTS = "att AS (SELECT 'orders' AS table1, event_type AS table2, value>100 AS valid FROM events)"
_JOINS = """SELECT '{0}' AS context, cast(case when count(*)=0 then 0.5
 when count(*) filter (where valid and (table1='{0}' or table2='{0}'))>0 then 1.0 else 0.3 end as double) AS join_quality FROM att"""


def _attempts(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select(
        F.lit("orders").alias("table1"), F.col("event_type").alias("table2"), (F.col("value") > 100).alias("valid")
    )


@register(
    "join_quality",
    f"WITH {_ATTEMPTS} " + " UNION ALL ".join(_JOINS.format(t) for t in ("view", "customer")),
)
def join_quality(spark, sf_dir):
    """Join attempts read from the event log, for two context tables."""
    attempts, out = _attempts(spark, sf_dir), None
    for context in ("view", "customer"):
        row = outcome.join_quality(attempts, context).select(F.lit(context).alias("context"), "join_quality")
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "score_composite",
    f"""{_LEVELS}, jq AS (SELECT join_quality FROM (WITH {_ATTEMPTS} {_JOINS.format("view")})),
 kr AS (SELECT (SELECT count(*) FROM k)*1.0/(SELECT count(*) FROM d) AS kept),
 iv AS (SELECT case when kept>=0.9 then 1.0 when kept>=0.8 then 0.85 when kept>=0.7 then 0.6 else kept end AS ia FROM kr),
 oc AS (SELECT case when a-b <= 0.2*a then 0.0 else least(0.2, 0.5*greatest(a-b-due,0)/a) end AS oc FROM
  (SELECT (SELECT count(*) FROM d) AS a, (SELECT count(*) FROM k) AS b, (SELECT count(*) FROM i WHERE action='delete') AS due))
 SELECT hard AS base, join_quality, round(cast(ia as double),6) AS intent_alignment, 1.0::DOUBLE AS downstream,
 round(cast(oc as double),6) AS over_cleaning,
 greatest(0.0,least(1.0,cast(round(cast(0.4*hard+0.2*join_quality+0.2*ia+0.2*1.0-oc as decimal(38,10)),4) as double))) AS composite
 FROM h, jq, iv, oc""",
)
def score_composite(spark, sf_dir):
    s, cleaned, parts = _components(spark, sf_dir)
    row = outcome.composite(
        score.score("hard", parts),
        outcome.join_quality(_attempts(spark, sf_dir), "view"),
        outcome.intent_alignment("visualization", s.data, cleaned, s.issues, s.profile),
        outcome.downstream_nulls(cleaned, s.profile),
        outcome.over_cleaning(s.data, cleaned, s.issues),
    )
    return row.select(
        "base",
        "join_quality",
        F.round("intent_alignment", 6).alias("intent_alignment"),
        "downstream",
        F.round("over_cleaning", 6).alias("over_cleaning"),
        "composite",
    )


@register("downstream_ml")
def downstream_ml(spark, sf_dir):
    """Accuracy of a classifier trained before and after imputation of the line items."""
    items = inputs.table(spark, sf_dir, "lineitem")
    df = items.select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").alias("id"),
        F.when(F.col("l_quantity") > 2, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("price"),
        "l_discount",
        F.col("l_linestatus").alias("status"),
    )
    profile = prof.profile_table(df, "lineitem", unique=["status"], medians="all")
    return outcome.downstream_ml(df, repair.auto_impute(df, profile), profile)


_SHARE = "(SELECT greatest(avg(y), 1-avg(y)) AS m FROM (SELECT case when o_totalprice>120000 then 1.0 else 0.0 end AS y FROM orders))"


@register(
    "downstream_ml_bands",
    f"""SELECT 'gain' AS version, m AS accuracy_before, 1.0::DOUBLE AS accuracy_after, least(1.0, 0.75+2.5*(1-m))::DOUBLE AS downstream FROM {_SHARE}
 UNION ALL SELECT 'same', m, m, 0.75 FROM {_SHARE}
 UNION ALL SELECT 'loss', 1.0, m, greatest(0.30, 0.75+2.5*(m-1)) FROM {_SHARE}""",
)
def downstream_ml_bands(spark, sf_dir):
    """A target that one column decides: with that column a classifier is always right, without it the larger class is all it has."""
    orders = inputs.table(spark, sf_dir, "orders")
    dear = F.col("o_totalprice") > 120000
    told = orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(dear, F.lit("dear")).otherwise(F.lit("cheap")).alias("price_class"),
        F.when(dear, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign"),
        (F.col("o_orderkey") % 3).alias("turn"),
    )
    untold = told.withColumn("sign", F.lit(0.0))
    out = None
    for name, before, after in (("gain", untold, told), ("same", untold, untold), ("loss", told, untold)):
        profile = prof.profile_table(before, "orders", unique=["price_class"])
        row = outcome.downstream_ml(before, after, profile).select(F.lit(name).alias("version"), "accuracy_before", "accuracy_after", "downstream")
        out = row if out is None else out.unionByName(row)
    return out
