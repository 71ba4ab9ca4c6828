"""Input tables of the registered queries.

The given tables are clean, so the dirty versions are made from whole tables by
SQL arithmetic that both engines evaluate alike.  `{text}` is the name of the
text type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MONEY = "cast(cast({0} as decimal(18,2)) as {{text}})"

ORDERS_DIRTY = {
    "id": "o_orderkey",
    "customer_id": "case when o_orderkey%211=0 then o_custkey+1000000 else o_custkey end",
    "amount": (
        "case when o_orderkey%97=0 then null when o_orderkey%101=1 then 'INVALID_TEXT' "
        "when o_orderkey%103=2 then '-'||" + MONEY.format("o_totalprice") + " "
        "else " + MONEY.format("o_totalprice") + " end"
    ),
    "price": "case when o_orderkey%107=3 then o_totalprice*1000 else o_totalprice end",
    "priority": (
        "case when o_orderkey%89=0 then lower(o_orderpriority) "
        "when o_orderkey%83=0 then ' '||o_orderpriority||'  ' else o_orderpriority end"
    ),
    "order_code": (
        "case when o_orderkey%113=5 then 'c'||cast(o_orderkey-1 as {text}) "
        "else 'C'||cast(o_orderkey as {text}) end"
    ),
}

# A careless cleaner: it repairs much, forgets some, and changes what was fine.
ORDERS_CLEANED = {
    "id": "id",
    "customer_id": "customer_id",
    "amount": (
        "case when amount is null or amount='INVALID_TEXT' then '0' "
        "when substr(amount,1,1)='-' and price<400000 then substr(amount,2) else amount end"
    ),
    "price": "case when price>100000000 then 250000.0 when price<2000 then 2000.0 else price end",
    "priority": "upper(trim(priority))",
    "order_code": "order_code",
}
ORDERS_KEPT = "not (substr(order_code,1,1)='c' and price<300000) and price>=1200"

PART_DIRTY = {
    "id": "p_partkey",
    "part_name": "p_name",
    "kind": (
        "case when p_partkey%17=0 then lower(p_type) when p_partkey%29=0 then p_type||' ' else p_type end"
    ),
    "size": "case when p_partkey%19=0 then null else p_size end",
    "retail": (
        "case when p_partkey%23=0 then null when p_partkey%31=0 then p_retailprice*100 "
        "else p_retailprice end"
    ),
    "brand": "case when p_partkey%37=0 then '  ' else p_brand end",
}

# An action log in the shape of the events: users are episodes, events are steps.
ACTION_LOG = {
    "episode": "cast(user_id as {text})",
    "step": "event_id",
    "action_type": (
        "case when event_type='view' and value<50 then 'inspect' "
        "when event_type='view' and value<100 then 'run_sql' when event_type='view' then 'select_tables' "
        "when event_type='click' and value<30 then 'profile_column' "
        "when event_type='click' and value<60 then 'fix_column' when event_type='click' then 'join_tables' "
        "when event_type='purchase' then 'fix_cell' when event_type='signup' then 'delete_row' "
        "when value<30 then 'validate' when value<60 then 'classify_intent' "
        "when value<70 then 'submit' else 'export' end"
    ),
    "row_id": "event_id",
    "column": "case when event_id%3=0 then 'amount' when event_id%3=1 then 'price' else 'priority' end",
    "value": (
        "case when event_type='error' and value<45 then 'ml_training' when event_type='error' then 'other' "
        "when event_id%3=0 then cast(cast(value as decimal(18,2)) as {text}) "
        "when event_id%3=1 then '250000' else '1-URGENT' end"
    ),
    "checks_passed": "cast(floor(value) as int)%7",
    "total_checks": "6",
    "join_valid": "value>100",
    "open_issues": "event_id%2",
}


def select_list(view: dict[str, str], text: str) -> list[str]:
    return [f'{expr.format(text=text)} AS {quote(name, text)}' for name, expr in view.items()]


def quote(name: str, text: str) -> str:
    mark = "`" if text == "string" else '"'
    return f"{mark}{name}{mark}"


def sql_view(view: dict[str, str], source: str, where: str | None = None) -> str:
    """The view as a query in the checking engine's dialect."""
    condition = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(select_list(view, 'varchar'))} FROM {source}{condition}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*select_list(ORDERS_DIRTY, "string"))


def orders_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = orders_dirty(spark, sf_dir)
    return dirty.where(ORDERS_KEPT).selectExpr(*select_list(ORDERS_CLEANED, "string"))


def part_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*select_list(PART_DIRTY, "string"))


def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*select_list(ACTION_LOG, "string"))
