"""Registered queries: profiling, keys and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from mendframe.operators import delta, detect, profile as prof, repair, report
from mendframe.plans import check_sql as sql, inputs
from mendframe.plans.registry import register
from mendframe.plans.flow import scan, scan_tables
from mendframe.session import materialize_by, new_path
from mendframe.sources import load_tables

ORDERS, PARTS = "orders_dirty", "part_dirty"

_STATS = f"""WITH {sql.ORDERS}, {sql.PARTS},
s AS ({sql.stats("d", ORDERS, sql.ORDER_COLUMNS)} UNION ALL {sql.stats("p", PARTS, sql.PART_COLUMNS)})"""
_NUMERIC = "dtype IN ('int','float')"


def _dirty(spark, sf_dir):
    return {ORDERS: inputs.orders_dirty(spark, sf_dir), PARTS: inputs.part_dirty(spark, sf_dir)}


def _profiles(spark, sf_dir, **options):
    frames = [
        prof.profile_table(df, name, **options).to_df(spark) for name, df in _dirty(spark, sf_dir).items()
    ]
    return frames[0].unionByName(frames[1])


def orders_scan(spark, sf_dir, level="hard", store=False):
    refs = {"customer": inputs.table(spark, sf_dir, "customer")}
    # the order key is the primary key of the given table
    return scan(inputs.orders_dirty(spark, sf_dir), ORDERS, level=level, references=refs, store=store, unique_ids=True)


@register(
    "profile_counts",
    f"""{_STATS} SELECT "table", "column", row_count, null_count,
 round(null_count*1.0/row_count,4) AS null_rate, unique_count,
 (null_count=0 AND unique_count=row_count) AS all_unique FROM s""",
)
def profile_counts(spark, sf_dir):
    return _profiles(spark, sf_dir).select(
        "table", "column", "row_count", "null_count", "null_rate", "unique_count", "all_unique"
    )


@register(
    "profile_numeric",
    f"""{_STATS} SELECT "table", "column", round(mean,4) AS mean, round(std,4) AS std,
 lo AS min, hi AS max, (lo>=0 AND hi>0) AS must_be_positive FROM s WHERE {_NUMERIC}""",
)
def profile_numeric(spark, sf_dir):
    return (
        _profiles(spark, sf_dir, unique=None)
        .where(F.col("dtype").isin("int", "float"))
        .select(
            "table", "column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
            "min", "max", "must_be_positive",
        )
    )


@register("profile_dtype", f"""{_STATS} SELECT "table", "column", dtype FROM s""")
def profile_dtype(spark, sf_dir):
    return _profiles(spark, sf_dir, unique=None).select("table", "column", "dtype")


@register(
    "profile_median",
    f"""{_STATS} SELECT "table", "column", round(med,4) AS median FROM s WHERE {_NUMERIC}""",
)
def profile_median(spark, sf_dir):
    return (
        _profiles(spark, sf_dir, unique=None, medians="all")
        .where(F.col("dtype").isin("int", "float"))
        .select("table", "column", F.round("median", 4).alias("median"))
    )


# the text form of a double differs between engines, so these are compared as numbers
_DOUBLES = ("price", "retail")


def _shown(c):
    return ("null::VARCHAR", c) if c in _DOUBLES else (f"cast({c} as varchar)", "null::DOUBLE")


def _number_apart(name):
    double = F.col("column").isin(*_DOUBLES)
    return F.when(~double, F.col(name)).alias(name), F.when(double, F.col(name).try_cast("double")).alias(f"{name}_num")


def _mode_sql(source, table, columns):
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{table}' AS "table", '{c}' AS "column", {_shown(c)[0]} AS mode, {_shown(c)[1]} AS mode_num FROM {source}
  WHERE not ({null}) GROUP BY {c} ORDER BY count(*) DESC, min(id) LIMIT 1)"""
        for c, _, null in columns
    )


@register(
    "profile_mode",
    f"WITH {sql.ORDERS}, {sql.PARTS} {_mode_sql('d', ORDERS, sql.ORDER_COLUMNS)} "
    f"UNION ALL {_mode_sql('p', PARTS, sql.PART_COLUMNS)}",
)
def profile_mode(spark, sf_dir):
    frames = []
    for name, df in _dirty(spark, sf_dir).items():
        p = prof.profile_table(df, name, unique=None, modes=df.columns)
        frames.append(p.to_df(spark).select("table", "column", *_number_apart("mode")))
    return frames[0].unionByName(frames[1])


@register(
    "profile_column",
    f"""{_STATS} SELECT s."table", s."column", row_count, null_count, unique_count, round(mean,4) AS mean, round(std,4) AS std,
 lo AS min, hi AS max, round(med,4) AS median, (SELECT retail FROM p WHERE retail is not null GROUP BY 1 ORDER BY count(*) DESC, min(id) LIMIT 1) AS mode,
 (SELECT count(*) FROM (SELECT 1 FROM p WHERE retail is not null LIMIT 5)) AS samples FROM s WHERE s."column"='retail'""",
)
def profile_column(spark, sf_dir):
    """All statistics of one column."""
    found = prof.profile_column(inputs.part_dirty(spark, sf_dir), PARTS, "retail")
    return prof.TableProfile(PARTS, "id", found.row_count, {"retail": found}).to_df(spark).select(
        "table", "column", "row_count", "null_count", "unique_count",
        *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", "max", F.round("median", 4).alias("median"),
        F.col("mode").try_cast("double").alias("mode"), F.size("sample_values").cast("long").alias("samples"),
    )


@register(
    "profile_repaired",
    f"""WITH {sql.PARTS}, f AS (SELECT coalesce(retail, 950.0) AS retail FROM p)
 SELECT (SELECT count(*) FROM p WHERE retail is null) AS nulls_before, count(*) filter (where retail is null) AS nulls_after,
 round(avg(retail),4) AS mean, round(stddev_pop(retail),4) AS std, count(distinct retail) AS unique_count FROM f""",
)
def profile_repaired(spark, sf_dir):
    """One column profiled again after it was repaired."""
    df = inputs.part_dirty(spark, sf_dir)
    before = prof.profile_table(df, PARTS, unique=None)
    after = prof.profile_column(repair.fix_column(df, before, "retail", 950), PARTS, "retail")
    return prof.TableProfile(PARTS, "id", after.row_count, {"retail": after}).to_df(spark).select(
        F.lit(before["retail"].null_count).cast("long").alias("nulls_before"), F.col("null_count").alias("nulls_after"),
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "unique_count",
    )


def orders_diff(spark, sf_dir, data):
    """The diff of the dirty orders and the repaired ones, stored in buckets of the id."""
    changed = delta.cell_changes(data, inputs.orders_cleaned(spark, sf_dir))
    return materialize_by(changed, "row_id", "orders_diff")


@register(
    "profile_by_delta",
    f"""WITH {sql.ORDERS}, {sql.CLEANED}, s AS ({sql.stats("k", ORDERS, sql.ORDER_COLUMNS)})
 SELECT "column", dtype, row_count, null_count, unique_count, case when dtype in ('int','float') then round(mean,4) end AS mean,
 case when dtype in ('int','float') then round(std,4) end AS std, case when dtype in ('int','float') then lo end AS min,
 case when dtype in ('int','float') then hi end AS max FROM s WHERE "column" <> 'id'""",
)
def profile_by_delta(spark, sf_dir):
    """The profile of the repaired orders, from that of the dirty ones and the stored diff."""
    data = inputs.orders_dirty(spark, sf_dir)
    columns = [c for c in data.columns if c != "id"]
    before = prof.profile_table(data, ORDERS, unique=None)
    counts = delta.value_counts(data, columns)
    diff = orders_diff(spark, sf_dir, data)
    after = delta.updated_profile(before, diff, inputs.orders_cleaned(spark, sf_dir), delta.updated_value_counts(counts, diff, columns))
    return after.to_df(spark).where("column <> 'id'").select(
        "column", "dtype", "row_count", "null_count", "unique_count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max"
    )


def _z_sql(source, table, column):
    return f"""SELECT '{table}' AS "table", id AS row_id, '{column}' AS "column",
 round((cast({column} as double)-(SELECT avg({column}) FROM {source}))/(SELECT stddev_pop({column}) FROM {source}),4) AS z
 FROM {source} WHERE {column} is not null"""


@register(
    "profile_zscores",
    f"""WITH {sql.ORDERS}, {sql.PARTS} """
    + " UNION ALL ".join(
        [
            *[_z_sql("d", ORDERS, c) for c in ("id", "customer_id", "price")],
            *[_z_sql("p", PARTS, c) for c in ("id", "size", "retail")],
        ]
    ),
)
def profile_zscores(spark, sf_dir):
    frames = []
    for name, df in _dirty(spark, sf_dir).items():
        frames.append(prof.z_scores(df, prof.profile_table(df, name, unique=None)))
    return frames[0].unionByName(frames[1])


def _sample_sql(source, table, columns):
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{table}' AS "table", '{c}' AS "column",
 row_number() over (order by id) AS position, id AS row_id, {_shown(c)[0]} AS value, {_shown(c)[1]} AS value_num
 FROM {source} WHERE not ({null})) WHERE position <= 5"""
        for c, _, null in columns
    )


@register(
    "profile_samples",
    f"WITH {sql.ORDERS}, {sql.PARTS} {_sample_sql('d', ORDERS, sql.ORDER_COLUMNS)} "
    f"UNION ALL {_sample_sql('p', PARTS, sql.PART_COLUMNS)}",
)
def profile_samples(spark, sf_dir):
    frames = []
    for name, df in _dirty(spark, sf_dir).items():
        found = prof.sample_values(df, prof.profile_table(df, name, unique=None))
        frames.append(found.select(F.lit(name).alias("table"), "column", "position", "row_id", *_number_apart("value")))
    return frames[0].unionByName(frames[1])


@register(
    "table_summary",
    f"""{_STATS} SELECT "table", row_count, "column",
 case "column" {" ".join(f"when '{c}' then {i}" for i, (c, _, _) in enumerate(sql.ORDER_COLUMNS))}
 {" ".join(f"when '{c}' then {i}" for i, (c, _, _) in enumerate(sql.PART_COLUMNS) if c != "id")} end AS position,
 dtype FROM s""",
)
def table_summary(spark, sf_dir):
    profiles = [prof.profile_table(df, name, unique=None) for name, df in _dirty(spark, sf_dir).items()]
    return prof.table_summary(profiles, spark)


def _key_sql(table, source, key, hinted):
    natural = "case " + " ".join(
        f"when count(distinct {c})*1.0/count(*) >= 0.70 then '{c}'" for c in hinted
    ) + " end"
    return f"""SELECT '{table}' AS "table", '{key}' AS primary_key, {natural} AS natural_key FROM {source}"""


@register(
    "key_discovery",
    f"WITH {sql.ORDERS} "
    + " UNION ALL ".join(
        [
            _key_sql("orders_dirty", "d", "id", ["order_code"]),
            _key_sql("customer", "customer", "c_custkey", ["c_name", "c_nationkey"]),
            _key_sql("supplier", "supplier", "s_suppkey", ["s_name", "s_nationkey"]),
            _key_sql("part", "part", "p_partkey", ["p_name"]),
            """SELECT 'events' AS "table",
 case when count(distinct event_id)=count(*) then 'event_id' when count(distinct user_id)=count(*) then 'user_id'
 else 'event_id' end AS primary_key, cast(null as varchar) AS natural_key FROM events""",
        ]
    ),
)
def key_discovery(spark, sf_dir):
    tables = {"orders_dirty": inputs.orders_dirty(spark, sf_dir)}
    for name in ("customer", "supplier", "part", "events"):
        tables[name] = inputs.table(spark, sf_dir, name)
    rows = []
    for name, df in tables.items():
        key = prof.primary_key(df)
        natural, _ = prof.natural_key(df, prof.profile_table(df, name, key, unique=None))
        rows.append((name, key, natural))
    return spark.createDataFrame(rows, "table string, primary_key string, natural_key string")


_ISSUES = f"WITH {sql.ORDERS}, {sql.ISSUES}"


@register(
    "quality_report",
    f"""{_ISSUES}, q AS (SELECT count(*) AS n, (SELECT count(*) FROM d) AS r FROM i),
 s AS (SELECT n, r, greatest(0.0, least(1.0, 1.0-n*1.0/(r*5)))*100.0 AS pct FROM q)
 SELECT 'orders_dirty' AS "table", r AS rows, 5 AS columns, n AS issues, round(cast(pct as double),4) AS quality,
 case when pct>=90 then 'Excellent' when pct>=70 then 'Good' when pct>=50 then 'Fair' else 'Poor' end AS grade FROM s""",
)
def quality_report(spark, sf_dir):
    s = orders_scan(spark, sf_dir)
    return report.quality_report(s.issues, s.profile)


@register("issue_breakdown", f"{_ISSUES} SELECT issue_type, count(*) AS n FROM i GROUP BY 1")
def issue_breakdown(spark, sf_dir):
    return report.issue_breakdown(orders_scan(spark, sf_dir).issues)


@register("scan_of_loaded_tables", f"{_ISSUES} SELECT issue_type, count(*) AS n FROM i GROUP BY 1")
def scan_of_loaded_tables(spark, sf_dir):
    """Two tables exported, loaded and scanned together: orders refer to customers."""
    paths = {}
    for name, df in ((ORDERS, inputs.orders_dirty(spark, sf_dir)), ("customer", inputs.table(spark, sf_dir, "customer"))):
        paths[name] = new_path(spark, name)
        df.write.parquet(paths[name])
    loaded = load_tables(spark, paths, fmt="parquet")
    # customers are known by their own key, which is their first column behind the id that loading adds
    loaded["customer"] = loaded["customer"].select("c_custkey", "c_name")
    return report.issue_breakdown(scan_tables(loaded, ORDERS, unique_ids=True).issues)


@register("issue_sample", f'{_ISSUES} SELECT * FROM i ORDER BY issue_type, row_id, "column" LIMIT 15')
def issue_sample(spark, sf_dir):
    return report.issue_sample(orders_scan(spark, sf_dir).issues)


@register("table_preview", f"WITH {sql.ORDERS} SELECT * FROM d ORDER BY id LIMIT 10")
def table_preview(spark, sf_dir):
    return report.preview(inputs.orders_dirty(spark, sf_dir))


@register(
    "column_health",
    f"""WITH {sql.ORDERS}, {sql.ISSUES}, s AS ({sql.stats("d", ORDERS, sql.ORDER_COLUMNS)}),
 n AS (SELECT "column", count(*) AS issues FROM i GROUP BY 1),
 j AS (SELECT s."column", s.dtype, s.null_count*1.0/s.row_count AS r, coalesce(n.issues,0) AS issues
  FROM s LEFT JOIN n ON s."column"=n."column" WHERE s."column" <> 'id')
 SELECT "column", dtype, round(r,4) AS null_rate, issues,
 case when r<0.05 and issues=0 then 'Good' when r<0.30 and issues<=2 then 'Fair' else 'Poor' end AS health FROM j""",
)
def column_health(spark, sf_dir):
    s = orders_scan(spark, sf_dir)
    return report.column_health(s.issues, s.profile)


@register(
    "null_cells",
    f"""{_STATS} SELECT "table", sum(null_count)::BIGINT AS null_cells FROM s
 WHERE "column" <> 'id' GROUP BY 1""",
)
def null_cells(spark, sf_dir):
    rows = [
        (name, prof.null_cells(prof.profile_table(df, name, unique=None)))
        for name, df in _dirty(spark, sf_dir).items()
    ]
    return spark.createDataFrame(rows, "table string, null_cells long")


@register(
    "column_roles",
    f"""{_STATS}, o AS (SELECT *, min(case when "column"<>'id' and unique_count=2 then "column" end)
  over (partition by "table") AS target FROM s)
 SELECT "table", "column", case when "column"=target then 'target' when {_NUMERIC} then 'metric'
 when unique_count between 1 and 20 then 'dimension' else 'other' end AS role FROM o WHERE "column"<>'id'""",
)
def column_roles(spark, sf_dir):
    rows = []
    for name, df in _dirty(spark, sf_dir).items():
        rows += [(name, c, role) for c, role in report.column_roles(prof.profile_table(df, name))]
    return spark.createDataFrame(rows, "table string, column string, role string")


_REMAINING = f"""{_ISSUES}, {sql.CLEANED},
 st AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(customer_id) AS cm, stddev_pop(customer_id) AS cs FROM d),
 c AS (SELECT i.*, k.id IS NOT NULL AS present, k.amount, k.price, k.priority, k.order_code, k.customer_id,
   case "column" when 'amount' then {sql.number("k.amount")} when 'price' then k.price
    when 'customer_id' then k.customer_id end AS x,
   case "column" when 'price' then ps when 'customer_id' then cs end AS std,
   case "column" when 'price' then pm when 'customer_id' then cm end AS mean,
   case "column" when 'amount' then k.amount when 'priority' then k.priority when 'order_code' then k.order_code
    when 'price' then cast(k.price as varchar) when 'customer_id' then cast(k.customer_id as varchar) end AS cell
  FROM i LEFT JOIN k ON i.row_id=k.id, st)"""
REMAINING = _REMAINING
OPEN = f"""coalesce(case when issue_type in ('duplicate','fk_violation') then present
 when issue_type='null' then present and {sql.blank("cell")}
 when issue_type='type_error' then present and not {sql.blank("cell")} and x is null
 when issue_type='constraint' then x<0
 when issue_type='outlier' then std>0 and abs(x-correct_num)/std>2.0 else false end, false)"""


@register("issues_remaining_by_delta", f"{_REMAINING} SELECT issue_id, {OPEN} AS remaining FROM c")
def issues_remaining_by_delta(spark, sf_dir):
    """The open issues after a repair, from the issues and the stored diff alone."""
    s = orders_scan(spark, sf_dir, store=True)
    found = materialize_by(delta.open_issues(s.issues, s.data, s.profile), "row_id", "open_issues")
    return delta.updated_issues(found, orders_diff(spark, sf_dir, s.data), s.profile).select("issue_id", "remaining")


@register("issues_remaining", f"{_REMAINING} SELECT issue_id, {OPEN} AS remaining FROM c")
def issues_remaining(spark, sf_dir):
    s = orders_scan(spark, sf_dir, store=True)
    left = detect.issues_remaining(s.issues, inputs.orders_cleaned(spark, sf_dir), s.profile)
    return left.select("issue_id", "remaining")


@register(
    "cleaning_summary",
    f"""{_REMAINING}, r AS (SELECT {OPEN} AS remaining FROM c)
 SELECT count(*) AS issues, count(*) filter (where not remaining) AS resolved,
 cast(round(100.0*count(*) filter (where not remaining)/count(*)) as int) AS percent FROM r""",
)
def cleaning_summary(spark, sf_dir):
    s = orders_scan(spark, sf_dir, store=True)
    return report.cleaning_summary(
        detect.issues_remaining(s.issues, inputs.orders_cleaned(spark, sf_dir), s.profile)
    )
