"""Registered queries: issue detection, repair and injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from mendframe.operators import compare, detect, dimension, inject, profile as prof, repair
from mendframe.plans import check_sql as sql, inputs
from mendframe.plans.profile_queries import ORDERS, PARTS, orders_scan
from mendframe.plans.registry import register

_D = f"WITH {sql.ORDERS}"
_DP = f"WITH {sql.ORDERS}, {sql.PARTS}"


def _detect(spark, sf_dir, check, parts=False):
    orders = detect.detect(
        inputs.orders_dirty(spark, sf_dir),
        ORDERS,
        checks=(check,),
        references={"customer": inputs.table(spark, sf_dir, "customer")},
    )
    if not parts:
        return orders
    return orders.unionByName(detect.detect(inputs.part_dirty(spark, sf_dir), PARTS, checks=(check,)))


@register("detect_null", f"{_DP} {sql.ORDER_NULLS} UNION ALL {sql.PART_NULLS}")
def detect_null(spark, sf_dir):
    return _detect(spark, sf_dir, "null", parts=True)


@register("detect_type_error", f"{_D} {sql.ORDER_TYPES}")
def detect_type_error(spark, sf_dir):
    return _detect(spark, sf_dir, "type_error")


@register("detect_constraint", f"{_D} {sql.ORDER_NEGATIVES}")
def detect_constraint(spark, sf_dir):
    return _detect(spark, sf_dir, "constraint")


@register("detect_outlier", f"{_DP} {sql.ORDER_OUTLIERS} UNION ALL {sql.PART_OUTLIERS}")
def detect_outlier(spark, sf_dir):
    return _detect(spark, sf_dir, "outlier", parts=True)


@register("detect_duplicate", f"{_D} {sql.ORDER_DUPLICATES}")
def detect_duplicate(spark, sf_dir):
    return _detect(spark, sf_dir, "duplicate")


@register("detect_fk_violation", f"{_D} {sql.ORDER_ORPHANS}")
def detect_fk_violation(spark, sf_dir):
    return _detect(spark, sf_dir, "fk_violation")


@register("detect_whitespace", f"{_DP} {sql.ORDER_SPACES} UNION ALL {sql.PART_SPACES}")
def detect_whitespace(spark, sf_dir):
    return _detect(spark, sf_dir, "whitespace", parts=True)


@register("detect_category", f"{_DP} {sql.ORDER_CATEGORIES} UNION ALL {sql.PART_CATEGORIES}")
def detect_category(spark, sf_dir):
    return _detect(spark, sf_dir, "inconsistent_category", parts=True)


@register(
    "detect_whitespace_documents",
    f"""{sql.whitespace("documents", "documents", "text", "doc_id")}
 UNION ALL {sql.whitespace("pages", "pages", "html", "page_id")}
 UNION ALL {sql.whitespace("(SELECT *, conv_id*1000000+turn AS id FROM conversations)", "conversations", "text")}""",
)
def detect_whitespace_documents(spark, sf_dir):
    """Whole texts: documents, web pages and conversations."""
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    pages = inputs.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")
    talks = inputs.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("id"), "text"
    )
    out = None
    for name, df in (("documents", docs), ("pages", pages), ("conversations", talks)):
        found = detect.detect(df, name, checks=("whitespace",))
        out = found if out is None else out.unionByName(found)
    return out


@register("detect_all_easy", f"{_D} {sql.issues(sql.EASY)}")
def detect_all_easy(spark, sf_dir):
    return orders_scan(spark, sf_dir, "easy").issues


@register("detect_all_medium", f"{_D} {sql.issues(sql.MEDIUM)}")
def detect_all_medium(spark, sf_dir):
    return orders_scan(spark, sf_dir, "medium").issues


@register("detect_all_hard", f"{_D} {sql.issues(sql.HARD)}")
def detect_all_hard(spark, sf_dir):
    return orders_scan(spark, sf_dir, "hard").issues


# -- repair ------------------------------------------------------------------


@register(
    "fix_cells",
    f"""{_D}, f AS (SELECT l_orderkey AS row_id, max(l_extendedprice) AS v FROM lineitem GROUP BY 1)
 SELECT d.id, d.customer_id, d.amount, coalesce(f.v, d.price) AS price, d.priority, d.order_code
 FROM d LEFT JOIN f ON d.id=f.row_id""",
)
def fix_cells(spark, sf_dir):
    """Prices corrected from the line items: many fixes per cell, the last step wins."""
    items = inputs.table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    fixes = items.select(
        F.col("l_orderkey").alias("row_id"),
        F.lit("price").alias("column"),
        price.cast("string").alias("value"),
        F.round(price * 100).cast("long").alias("step"),
    )
    return repair.apply_fixes(inputs.orders_dirty(spark, sf_dir), fixes)


@register(
    "unknown_fixes",
    f"""{_D} SELECT l_orderkey*2 AS row_id, count(*) AS fixes FROM lineitem
 WHERE l_orderkey*2 NOT IN (SELECT id FROM d) GROUP BY 1""",
)
def unknown_fixes(spark, sf_dir):
    """Fixes that name no row of the table: half of the doubled order keys are beyond it."""
    items = inputs.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("row_id"))
    fixes = items.select("row_id", F.lit("price").alias("column"), F.lit("1").alias("value"))
    lost = repair.fix_report(inputs.orders_dirty(spark, sf_dir), fixes).unknown_rows
    return lost.groupBy("row_id").agg(F.count(F.lit(1)).alias("fixes"))


@register(
    "fix_column",
    f"WITH {sql.PARTS} SELECT id, part_name, kind, size, coalesce(retail, 950.0) AS retail, brand FROM p",
)
def fix_column(spark, sf_dir):
    df = inputs.part_dirty(spark, sf_dir)
    return repair.fix_column(df, prof.profile_table(df, PARTS, unique=None), "retail", 950)


@register(
    "fix_column_counts",
    f"""{_DP}
 SELECT 'retail' AS "column", count(*) filter (where retail is null) AS nulls_fixed, 0::BIGINT AS type_errors_fixed,
  0::BIGINT AS negatives_fixed, count(*) filter (where retail is null) AS total_fixed FROM p
 UNION ALL SELECT 'brand', count(*) filter (where {sql.blank("brand")}), 0, 0,
  count(*) filter (where {sql.blank("brand")}) FROM p
 UNION ALL SELECT 'amount', count(*) filter (where {sql.blank("amount")}), 0, 0,
  count(*) filter (where {sql.blank("amount")}) FROM d""",
)
def fix_column_counts(spark, sf_dir):
    orders, parts = inputs.orders_dirty(spark, sf_dir), inputs.part_dirty(spark, sf_dir)
    out = None
    for df, name, column, value in (
        (parts, PARTS, "retail", 950),
        (parts, PARTS, "brand", "Unknown"),
        (orders, ORDERS, "amount", "0"),
    ):
        profile = prof.profile_table(df, name, unique=None)
        counts = repair.fix_column_counts(df, profile, column, value).select(F.lit(column).alias("column"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out


def _clean_amounts(spark, sf_dir):
    """The profile of the orders before they became dirty: amounts are numbers, none is negative."""
    clean = inputs.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "cast(cast(o_totalprice as decimal(18,2)) as string) AS amount")
    return prof.profile_table(clean, ORDERS, unique=None)


@register(
    "fix_column_by_clean_profile",
    f"""{_D} SELECT id, case when {sql.blank("amount")} or {sql.number("amount")} is null then 0.0
 else abs({sql.number("amount")}) end AS amount FROM d""",
)
def fix_column_by_clean_profile(spark, sf_dir):
    """Empty, invalid and negative amounts are told apart by what the clean table was like."""
    df = inputs.orders_dirty(spark, sf_dir)
    fixed = repair.fix_column(df, _clean_amounts(spark, sf_dir), "amount", "0")
    return fixed.select("id", F.col("amount").try_cast("double").alias("amount"))


@register(
    "fix_counts_by_clean_profile",
    f"""{_D}, c AS (SELECT count(*) filter (where {sql.blank("amount")}) AS nulls_fixed,
  count(*) filter (where not {sql.blank("amount")} and {sql.number("amount")} is null) AS type_errors_fixed,
  count(*) filter (where {sql.number("amount")}<0) AS negatives_fixed FROM d)
 SELECT *, nulls_fixed+type_errors_fixed+negatives_fixed AS total_fixed FROM c""",
)
def fix_counts_by_clean_profile(spark, sf_dir):
    df = inputs.orders_dirty(spark, sf_dir)
    return repair.fix_column_counts(df, _clean_amounts(spark, sf_dir), "amount", "0")


@register(
    "delete_rows",
    f"""{_D}, x AS ({sql.ORDER_DUPLICATES} UNION ALL {sql.ORDER_ORPHANS})
 SELECT * FROM d WHERE id NOT IN (SELECT row_id FROM x)""",
)
def delete_rows(spark, sf_dir):
    s = orders_scan(spark, sf_dir)
    return repair.delete_rows(s.data, repair.rows_to_delete(s.issues))


@register(
    "auto_impute",
    f"""WITH {sql.PARTS} SELECT id, part_name, kind,
 coalesce(cast(size as double), (SELECT round(median(size),4) FROM p)) AS size,
 coalesce(retail, (SELECT round(median(retail),4) FROM p)) AS retail,
 case when {sql.blank("brand")} then (SELECT brand FROM p WHERE not {sql.blank("brand")}
  GROUP BY 1 ORDER BY count(*) DESC, min(id) LIMIT 1) else brand end AS brand FROM p""",
)
def auto_impute(spark, sf_dir):
    df = inputs.part_dirty(spark, sf_dir)
    # whole sizes stay integers unless the median is not whole; compared as numbers
    return repair.auto_impute(df, prof.profile_table(df, PARTS, unique=None)).withColumn("size", F.col("size").cast("double"))


# amounts are compared as numbers: engines print doubles differently
_FIXED = f"""w AS (SELECT row_id, "column", correct, correct_num, action FROM (SELECT *, row_number() over (
  partition by row_id, "column" order by case issue_type when 'null' then 0 when 'type_error' then 1
   when 'constraint' then 2 when 'outlier' then 3 when 'whitespace' then 6 else 7 end desc) AS r
  FROM i WHERE action <> 'delete') WHERE r=1),
 a AS (SELECT * FROM w WHERE "column"='amount'), b AS (SELECT * FROM w WHERE "column"='price'),
 c AS (SELECT * FROM w WHERE "column"='priority'), e AS (SELECT * FROM w WHERE "column"='customer_id')
 SELECT d.id, case when e.row_id is null then d.customer_id else cast(round(e.correct_num) as bigint) end AS customer_id,
 case when a.row_id is null then {sql.number("d.amount")} when a.action='any' then 0.0
  else coalesce(a.correct_num, {sql.number("a.correct")}) end AS amount,
 coalesce(b.correct_num, d.price) AS price, coalesce(c.correct, d.priority) AS priority, d.order_code
 FROM d LEFT JOIN a ON d.id=a.row_id LEFT JOIN b ON d.id=b.row_id LEFT JOIN c ON d.id=c.row_id
 LEFT JOIN e ON d.id=e.row_id"""


def _amount_as_number(df):
    return df.withColumn("amount", F.col("amount").try_cast("double"))


@register(
    "apply_corrections",
    f"""WITH {sql.ORDERS}, {sql.ISSUES}, {_FIXED}
 WHERE d.id NOT IN (SELECT row_id FROM i WHERE action='delete')""",
)
def apply_corrections(spark, sf_dir):
    s = orders_scan(spark, sf_dir, store=True)
    return _amount_as_number(repair.apply_corrections(s.data, s.issues))


@register("repair_in_place", f"WITH {sql.ORDERS}, i AS ({sql.issues(sql.MEDIUM)}), {_FIXED}")
def repair_in_place(spark, sf_dir):
    df = inputs.orders_dirty(spark, sf_dir)
    rules = detect.learn(df, ORDERS, checks=detect.MEDIUM)
    return _amount_as_number(repair.repair_in_place(df, rules))


def _diff_sql(column, text):
    a, b = (f"d.{column}", f"k.{column}") if text else (f"cast(d.{column} as varchar)", f"cast(k.{column} as varchar)")
    na = sql.number(a) if text else f"cast(d.{column} as double)"
    nb = sql.number(b) if text else f"cast(k.{column} as double)"
    same = f"""case when {a} is null and {b} is null then true when {a} is null or {b} is null then false
 when {na} is not null and {nb} is not null then abs({na}-{nb}) <= 1e-4*greatest(abs({na}),abs({nb}))
 else lower({sql.strip(a)})=lower({sql.strip(b)}) end"""
    shown = f"{a} AS before, {b} AS after, null::DOUBLE AS before_num, null::DOUBLE AS after_num"
    if not text:
        shown = f"null::VARCHAR AS before, null::VARCHAR AS after, {na} AS before_num, {nb} AS after_num"
    return f"""SELECT d.id AS row_id, '{column}' AS "column", {shown} FROM d JOIN k ON d.id=k.id WHERE not ({same})"""


@register(
    "cell_diff",
    f"WITH {sql.ORDERS}, {sql.CLEANED} "
    + " UNION ALL ".join(
        _diff_sql(c, t)
        for c, t in (
            ("customer_id", False), ("amount", True), ("price", False), ("priority", True), ("order_code", True),
        )
    ),
)
def cell_diff(spark, sf_dir):
    diff = compare.cell_diff(inputs.orders_dirty(spark, sf_dir), inputs.orders_cleaned(spark, sf_dir))
    numeric = F.col("column").isin("customer_id", "price")
    return diff.select(
        "row_id",
        "column",
        F.when(~numeric, F.col("before")).alias("before"),
        F.when(~numeric, F.col("after")).alias("after"),
        F.when(numeric, F.col("before").try_cast("double")).alias("before_num"),
        F.when(numeric, F.col("after").try_cast("double")).alias("after_num"),
    )


# -- injection ---------------------------------------------------------------


@register("inject_errors")
def inject_errors(spark, sf_dir):
    """The planted errors; cells follow the engine's hash, so there is no checking SQL."""
    df = inputs.table(spark, sf_dir, "lineitem").select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").alias("id"),
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
    )
    profile = prof.profile_table(df, "lineitem", unique=None)
    return inject.inject_errors(df, profile, 300)[1]


_RULE = "(id*7919)%100003"
_PLANTED = f"""q AS (SELECT id, price, priority, {_RULE} AS pos FROM d WHERE price is not null),
 e AS (SELECT 'price' AS "column", case pos%3 when 0 then 'null' when 1 then 'type_error' else 'constraint' end AS issue_type,
   id, pos, cast(null as varchar) AS original, price AS original_num FROM q WHERE pos%3<2 or price>0
  UNION ALL SELECT 'priority', 'null', id, pos, priority, null FROM q WHERE not {sql.blank("priority")}),
 t AS (SELECT *, row_number() over (partition by issue_type, "column" order by pos, id) AS r FROM e),
 n AS (SELECT * FROM t WHERE r<=case when issue_type='null' then 10 else 20 end)"""


def _by_rule(spark, sf_dir):
    df = inputs.orders_dirty(spark, sf_dir).select("id", "price", "priority")
    profile = prof.profile_table(df, ORDERS, unique=None)
    return df, inject.inject_errors(df, profile, 60, order=F.pmod(F.col("row_id") * 7919, F.lit(100003)))


@register(
    "inject_by_rule",
    f"""{_D}, {_PLANTED} SELECT id AS row_id, "column", issue_type, original AS correct,
 case when issue_type='type_error' then round((SELECT median(price) FROM d),4) else round(original_num,4) end AS correct_num FROM n""",
)
def inject_by_rule(spark, sf_dir):
    """The planted errors where a rule over the row id, not a hash, picks the cells."""
    planted = _by_rule(spark, sf_dir)[1][1]
    return planted.select("row_id", "column", "issue_type", "correct", F.round("correct_num", 4).alias("correct_num"))


@register(
    "inject_by_rule_table",
    f"""{_D}, {_PLANTED} SELECT d.id, coalesce(x.issue_type='type_error',false) AS invalid,
 case when x.issue_type is null then round(d.price,4) when x.issue_type='constraint' then round(-abs(d.price),4) end AS price,
 case when y.id is null then d.priority end AS priority
 FROM d LEFT JOIN n x ON d.id=x.id AND x."column"='price' LEFT JOIN n y ON d.id=y.id AND y."column"='priority'""",
)
def inject_by_rule_table(spark, sf_dir):
    """The table with those errors in it."""
    dirty = _by_rule(spark, sf_dir)[1][0]
    return dirty.select(
        "id",
        F.coalesce(F.col("price") == inject.INVALID_TEXT, F.lit(False)).alias("invalid"),
        F.round(F.col("price").try_cast("double"), 4).alias("price"),
        "priority",
    )


@register(
    "inject_decoy_by_rule",
    f"""{_D} SELECT 'price' AS "column", id AS row_id, round(price*2,2) AS decoy_value, price AS original FROM d, (
  SELECT avg(price) AS m, stddev_pop(price) AS s FROM d)
 WHERE id NOT IN (SELECT id FROM d WHERE price>100000000) ORDER BY abs((price-m)/s)>=2, {_RULE}, id LIMIT 1""",
)
def inject_decoy_by_rule(spark, sf_dir):
    """The decoy among rows whose price is not already far off."""
    df = inputs.orders_dirty(spark, sf_dir).select("id", "price")
    issues = df.where("price > 100000000").select(F.col("id").alias("row_id"), F.lit("price").alias("column"))
    rule = F.pmod(F.col("row_id") * 7919, F.lit(100003))
    decoys = inject.inject_decoy(df, prof.profile_table(df, ORDERS, unique=None), issues, order=rule)[1]
    return decoys.select("column", "row_id", "decoy_value", "original")


@register(
    "inject_invariants",
    f"""WITH {sql.PARTS} SELECT count(*) AS rows, count(*)//50 AS planted, count(*)//50 AS recovered,
 (SELECT count(*) FROM p a JOIN p b ON a.id=b.id WHERE a.retail<>b.retail) AS other_changes FROM p""",
)
def inject_invariants(spark, sf_dir):
    """Planted cells differ from the original, undoing them restores the table."""
    df = inputs.part_dirty(spark, sf_dir)
    dirty, planted = inject.inject_errors(
        df, prof.profile_table(df, PARTS, unique=None), df.count() // 50, checks=("null", "constraint")
    )
    restored = repair.apply_fixes(dirty, repair.corrections(planted))
    changed = compare.cell_diff(df, dirty).select("row_id", "column").withColumn("changed", F.lit(1))
    left = compare.cell_diff(df, restored).agg(F.count(F.lit(1)).alias("other_changes"))
    hits = planted.join(changed, ["row_id", "column"], "left").agg(
        F.count(F.lit(1)).alias("planted"), F.count("changed").alias("recovered")
    )
    rows = dirty.agg(F.count(F.lit(1)).alias("rows"))
    stacked = rows.unionByName(hits, allowMissingColumns=True).unionByName(left, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in ("rows", "planted", "recovered", "other_changes")])


@register("inject_decoy")
def inject_decoy(spark, sf_dir):
    s = orders_scan(spark, sf_dir, store=True)
    return inject.inject_decoy(s.data, s.profile, s.issues)[1]


@register(
    "inject_lookup_errors",
    f"""WITH {sql.PARTS}, n AS (SELECT count(distinct lower({sql.strip("kind")})) AS n FROM p)
 SELECT n AS entries, n+999 AS bad_ref, cast(1 as bigint) AS orphans, cast(1 as bigint) AS blank_labels FROM n""",
)
def inject_lookup_errors(spark, sf_dir):
    df = inputs.part_dirty(spark, sf_dir)
    dim = dimension.extract(df, prof.profile_table(df, PARTS))
    facts, lookup = inject.inject_lookup_errors(dim)
    bad = facts.join(lookup, F.col(dim.ref_column) == lookup["id"], "left_anti").where(F.col(dim.ref_column).isNotNull())
    counted = bad.agg(F.max(dim.ref_column).alias("bad_ref"), F.count(F.lit(1)).alias("orphans"))
    blanks = lookup.agg(
        F.count(F.lit(1)).alias("entries"), F.count(F.when(F.col("label").isNull(), 1)).alias("blank_labels")
    )
    stacked = counted.unionByName(blanks, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in ("entries", "bad_ref", "orphans", "blank_labels")])
