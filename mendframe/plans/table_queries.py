"""Registered queries: SQL shapes, joins, summaries, dimensions, action logs, sources and sinks."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import functions as F

from mendframe.functions import cells
from mendframe.operators import actions, dimension, profile as prof, query
from mendframe.plans import check_sql as sql, inputs
from mendframe.plans.profile_queries import PARTS, orders_scan
from mendframe.plans.registry import register
from mendframe.session import new_path
from mendframe.sources import coerce_types, ensure_id, export_table, load_table, load_tables

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# -- read-only SQL -----------------------------------------------------------

# One text per shape; both engines run the same text.
SHAPES = {
    "sql_projection": "SELECT s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_name",
    "sql_filter": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem "
        "WHERE l_discount >= 0.08 AND l_returnflag = 'R' AND l_quantity < 10"
    ),
    "sql_is_null": (
        "SELECT o.o_orderkey, o.o_totalprice FROM orders o "
        "LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000 WHERE c.c_custkey IS NULL"
    ),
    "sql_left_join": (
        'SELECT c."c_custkey", c.c_name, o.o_orderkey FROM customer c '
        'LEFT JOIN orders o ON c."c_custkey" = o.o_custkey AND o.o_totalprice > 400000'
    ),
    "sql_inner_join": (
        "SELECT r.r_name, count(*) AS customers, round(avg(c.c_acctbal), 4) AS balance FROM region r "
        "JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name"
    ),
    "sql_group": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS avg_qty, "
        "max(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10 ORDER BY n DESC"
    ),
    "sql_setops": (
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier "
        "UNION ALL SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation"
    ),
    "sql_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "sql_case": (
        "SELECT CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'large' END AS band, "
        "count(*) AS n FROM orders GROUP BY 1"
    ),
    "sql_window": (
        "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders"
    ),
    "sql_subquery": (
        "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) "
        "AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"
    ),
    "sql_correlated": (
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)"
    ),
    "sql_string_functions": (
        "SELECT upper(substr(c_mktsegment, 1, 4)) AS s, length(c_name) AS n, replace(c_name, '#', '-') AS name FROM customer"
    ),
    "sql_date_functions": (
        "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)"
    ),
}


def _register_tables(spark, sf_dir, text):
    """The given tables that a text names, as views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            inputs.table(spark, sf_dir, name).createOrReplaceTempView(name)


def _shape(text):
    def run(spark, sf_dir):
        _register_tables(spark, sf_dir, text)
        return query.query(spark, text, limit=None)

    return run


for _name, _text in SHAPES.items():
    register(_name, _text)(_shape(_text))


@register("inspect_rows", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def inspect_rows(spark, sf_dir):
    """All rows and columns of the one wanted table that there is."""
    _register_tables(spark, sf_dir, "supplier")
    known, unknown = query.select_tables(spark, ["supplier", "suppliers"])
    if (known, unknown) != (["supplier"], ["suppliers"]):
        raise ValueError(f"tables {known} and not {unknown}")
    return query.rows(spark, known[0]).select(*query.columns(spark, known[0]))


# -- joins and summaries -----------------------------------------------------


@register(
    "join_tables",
    "SELECT c.*, n.* FROM customer c LEFT JOIN nation n ON c.c_nationkey=n.n_nationkey",
)
def join_tables(spark, sf_dir):
    customer, nation = inputs.table(spark, sf_dir, "customer"), inputs.table(spark, sf_dir, "nation")
    return query.join_tables(customer, nation, "c_nationkey").rows


_DIAGNOSTICS = """SELECT '{name}' AS pair, (SELECT count(*) FROM {a}) AS rows_left, (SELECT count(*) FROM {b}) AS rows_right,
 (SELECT count(*) FROM {a} x LEFT JOIN {b} y ON x.{k}=y.{k2}) AS rows_joined,
 (SELECT round(count(*) filter (where {k} in (SELECT {k2} FROM {b} WHERE {k2} is not null))*1.0/count(*),4)::DOUBLE FROM {a}) AS match_rate,
 (SELECT max(n)<=1 FROM (SELECT count(*) AS n FROM {b} WHERE {k2} is not null GROUP BY {k2})) AS key_unique, true AS valid"""


@register(
    "join_match_rate",
    f"WITH {sql.ORDERS} "
    + " UNION ALL ".join(
        [
            _DIAGNOSTICS.format(name="orders-customer", a="d", b="customer", k="customer_id", k2="c_custkey"),
            _DIAGNOSTICS.format(name="orders-events", a="d", b="events", k="id", k2="event_id"),
            _DIAGNOSTICS.format(name="supplier-customer", a="supplier", b="customer", k="s_nationkey", k2="c_nationkey"),
        ]
    ),
)
def join_match_rate(spark, sf_dir):
    orders, customer = inputs.orders_dirty(spark, sf_dir), inputs.table(spark, sf_dir, "customer")
    events, supplier = inputs.table(spark, sf_dir, "events"), inputs.table(spark, sf_dir, "supplier")
    by_nation = customer.withColumnRenamed("c_nationkey", "s_nationkey")
    out = None
    for name, a, b, key in (
        ("orders-customer", orders, customer, "customer_id"),
        ("orders-events", orders, events, "id"),
        ("supplier-customer", supplier, by_nation, "s_nationkey"),
    ):
        row = query.join_tables(a, b, key).diagnostics.select(F.lit(name).alias("pair"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_CHOSEN = """SELECT '{pair}' AS pair, '{key}' AS key, (SELECT count(*) FROM {a} x LEFT JOIN {b} y ON {on}) AS rows_joined,
 (SELECT round(count(*) filter (where exists (SELECT 1 FROM {b} y WHERE {on}))*1.0/count(*),4)::DOUBLE FROM {a} x) AS match_rate"""


@register(
    "join_key_choice",
    " UNION ALL ".join(
        [
            _CHOSEN.format(pair="labels-documents", key="doc_id", a="labels", b="documents", on="x.doc_id=y.doc_id"),
            _CHOSEN.format(pair="customer-customer", key="c_name", a="customer", b="customer", on="x.c_name=y.c_name"),
            _CHOSEN.format(
                pair="events-orders", key="event_id", a="events", b="orders", on="x.event_id=y.o_orderkey"
            ),
        ]
    ),
)
def join_key_choice(spark, sf_dir):
    """Pairs of tables joined on the key picked from their columns."""
    t = {n: inputs.table(spark, sf_dir, n) for n in ("events", "orders", "customer", "labels", "documents")}
    renamed = t["customer"].withColumnRenamed("c_custkey", "id")
    out = None
    for pair, a, b in (
        ("labels-documents", t["labels"], t["documents"]),
        ("customer-customer", renamed, renamed),
        ("events-orders", t["events"], t["orders"]),
    ):
        key = query.shared_key(a.columns, b.columns)
        row = query.join_tables(a, b, key).diagnostics.select(
            F.lit(pair).alias("pair"), F.lit(key).alias("key"), "rows_joined", "match_rate"
        )
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "group_summary",
    """SELECT l_quantity, count(*) AS "count", round(avg(l_extendedprice),2) AS avg_l_extendedprice,
 round(min(l_extendedprice),2) AS min_l_extendedprice, round(max(l_extendedprice),2) AS max_l_extendedprice
 FROM lineitem GROUP BY 1""",
)
def group_summary(spark, sf_dir):
    return query.group_summary(inputs.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@register("top_n", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(spark, sf_dir):
    return query.top_rows(inputs.table(spark, sf_dir, "orders"), "o_totalprice", id_col="o_orderkey")


@register("bottom_n", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def bottom_n(spark, sf_dir):
    return query.top_rows(
        inputs.table(spark, sf_dir, "orders"), "o_totalprice", largest=False, id_col="o_orderkey"
    )


@register(
    "category_counts",
    'SELECT p_name, count(*) AS "count" FROM part GROUP BY 1',
)
def category_counts(spark, sf_dir):
    return query.category_counts(inputs.table(spark, sf_dir, "part"), "p_name")


# -- dimensions --------------------------------------------------------------

_KIND = f"""e AS (SELECT lower({sql.strip("kind")}) AS key, min(id) AS f, arg_min(kind, id) AS label FROM p GROUP BY 1),
 l AS (SELECT key, label, row_number() over (order by f) AS id FROM e)"""


def _kind(spark, sf_dir):
    df = inputs.part_dirty(spark, sf_dir)
    profile = prof.profile_table(df, PARTS, unique=["part_name", "kind", "size", "brand"])
    return dimension.extract(df, profile)


@register("dimension_lookup", f"WITH {sql.PARTS}, {_KIND} SELECT id, label FROM l")
def dimension_lookup(spark, sf_dir):
    return _kind(spark, sf_dir).lookup


@register(
    "dimension_facts",
    f"""WITH {sql.PARTS}, {_KIND} SELECT p.*, l.id AS kind_ref FROM p LEFT JOIN l ON lower({sql.strip("p.kind")})=l.key""",
)
def dimension_facts(spark, sf_dir):
    return _kind(spark, sf_dir).facts


# -- action logs -------------------------------------------------------------

_WIN = """w AS (SELECT * FROM (SELECT *, row_number() over (partition by row_id, "column" order by case issue_type
  when 'null' then 0 when 'type_error' then 1 when 'constraint' then 2 when 'outlier' then 3 when 'duplicate' then 4
  when 'fk_violation' then 5 when 'whitespace' then 6 else 7 end desc) AS r FROM i) WHERE r=1)"""
_NUM = sql.number("value")
_WANT = f"coalesce(correct_num, {sql.number('correct')})"
_SAME = f"""(case when {_NUM} is not null and {_WANT} is not null then abs({_NUM}-{_WANT})<=1e-4*greatest(abs({_NUM}),abs({_WANT}))
 else lower(value)=lower(correct) end)"""
_SOLVES = f"""coalesce(case issue_type when 'null' then true when 'type_error' then {_NUM} is not null
 when 'constraint' then {_NUM}>=0 when 'outlier' then abs({_NUM}-{_WANT})/std<=2.0
 when 'whitespace' then {sql.squeeze("value")}=value when 'inconsistent_category' then {_SAME} end, false)"""
_ORIG = f"""(case when {_NUM} is not null and {sql.number("orig")} is not null
 then abs({_NUM}-{sql.number("orig")})<=1e-4*greatest(abs({_NUM}),abs({sql.number("orig")}))
 else lower({sql.strip("value")})=lower({sql.strip("orig")}) end)"""
_REWARDS = f"""WITH {sql.ORDERS}, {sql.ISSUES}, {sql.LOG}, {_WIN}, n AS (SELECT count(*) AS total FROM i),
 sd AS (SELECT stddev_pop(price) AS std FROM d),
 bk AS (SELECT "column", count(*) filter (where issue_type in ('null','type_error','whitespace')) AS nb FROM i GROUP BY 1),
 ed AS (SELECT distinct row_id FROM i WHERE action='delete'),
 x AS (SELECT lg.*, row_number() over (partition by episode, action_type order by step) AS nth, w.issue_type, w.correct,
   w.correct_num, w.row_id IS NOT NULL AS hit, d.id IS NOT NULL AS known, coalesce(bk.nb,0) AS nb, ed.row_id IS NOT NULL AS due, std, total,
   case lg."column" when 'amount' then d.amount when 'price' then cast(d.price as varchar) else d.priority end AS orig
  FROM lg LEFT JOIN w ON lg.row_id=w.row_id AND lg."column"=w."column" LEFT JOIN d ON lg.row_id=d.id
  LEFT JOIN bk ON lg."column"=bk."column" LEFT JOIN ed ON lg.row_id=ed.row_id, sd, n),
 y AS (SELECT *, case action_type when 'inspect' then case when nth<=3 then 0.02 else 0 end
   when 'profile_column' then case when nth<=3 then 0.03 else 0 end when 'run_sql' then case when nth<=3 then 0.03 else 0 end
   when 'select_tables' then case when nth<=2 then 0.02 else 0 end else 0 end::DOUBLE AS invest,
  case when action_type='fix_cell' and hit then case when {_SOLVES} then 0.15 else -0.1 end
   when action_type='delete_row' and due then 0.15
   when action_type='fix_column' and nb>0 then round(cast(0.15*(1.0+2.0*least(nb*1.0/total,1.0)) as double),4)
   when action_type='submit' and open_issues=0 then 0.1 else 0 end::DOUBLE AS fix_delta,
  case when action_type='validate' and nth<=2 then round(cast(0.05*checks_passed/total_checks as double),4) else 0 end::DOUBLE AS validate_b,
  case when action_type='fix_cell' and not hit and not (orig is not null and coalesce({_ORIG},false)) then -0.2
   when action_type='delete_row' and not due then -0.2 when action_type='fix_column' and nb=0 then -0.1
   when action_type='submit' and open_issues<>0 then -0.1 else 0 end::DOUBLE AS penalty,
  case when action_type='join_tables' then case when join_valid then 0.2 else -0.2 end else 0 end::DOUBLE AS join_r FROM x),
 z AS (SELECT *, case when action_type='classify_intent' then case when value='ml_training' then 0.1 else -0.05 end
   when action_type='fix_cell' and fix_delta>0 and issue_type in ('null','type_error','constraint','outlier','duplicate') then 0.05
   when action_type='fix_column' and fix_delta>0 and exists (SELECT 1 FROM i WHERE i."column"=y."column" and i.issue_type in ('null','type_error')) then 0.05
   else 0 end::DOUBLE AS intent_r FROM y),
 rw AS (SELECT episode, step, action_type, invest, fix_delta, validate_b, penalty, intent_r, join_r,
  greatest(-1.0,least(1.0,round(invest+fix_delta+validate_b+penalty+intent_r+join_r,4))) AS total FROM z)"""


def _rewards(spark, sf_dir):
    s = orders_scan(spark, sf_dir, store=True)
    log = inputs.action_log(spark, sf_dir)
    return actions.action_rewards(
        log, s.issues, {s.table: s.data}, s.profile, intent="ml_training", correct_intent="ml_training", n_tables=2
    )


@register("action_rewards", f"{_REWARDS} SELECT * FROM rw")
def action_rewards(spark, sf_dir):
    return _rewards(spark, sf_dir)


@register(
    "episode_totals",
    f"""{_REWARDS} SELECT episode, count(*) AS steps,
 count(*) filter (where action_type in ('inspect','profile_column','run_sql')) AS investigations,
 round(sum(invest),4) AS invest, round(sum(fix_delta),4) AS fix_delta, round(sum(validate_b),4) AS validate_b,
 round(sum(penalty),4) AS penalty, round(sum(intent_r),4) AS intent_r, round(sum(join_r),4) AS join_r,
 round(sum(case when action_type in ('submit','export') then 0.75 else total end),4) AS reward FROM rw GROUP BY 1""",
)
def episode_totals(spark, sf_dir):
    finals = (
        inputs.table(spark, sf_dir, "events")
        .select(F.col("user_id").cast("string").alias("episode"))
        .distinct()
        .withColumn("score", F.lit(0.75))
    )
    return actions.episode_totals(_rewards(spark, sf_dir), finals)


# -- scalar rules ------------------------------------------------------------


@register(
    "scalar_rules",
    f"""WITH {sql.ORDERS}, {sql.CLEANED} SELECT d.id, {sql.blank("d.amount")} AS null_like, {sql.number("d.amount")} AS number,
 {sql.squeeze("d.priority")} AS squeezed, lower({sql.strip("d.priority")}) AS folded,
 case when d.amount is null then 'unknown' when {sql.number("d.amount")} is null then 'str'
  when {sql.number("d.amount")}=floor({sql.number("d.amount")}) then 'int' else 'float' end AS guessed,
 case when k.price is null then false else abs(d.price-k.price)<=1e-4*greatest(d.price,k.price) end AS same_price,
 'orders_'||cast(d.id as varchar)||'_price_outlier' AS issue
 FROM d LEFT JOIN k ON d.id=k.id""",
)
def scalar_rules(spark, sf_dir):
    d, k = inputs.orders_dirty(spark, sf_dir), inputs.orders_cleaned(spark, sf_dir)
    types = dict(zip(d.columns, (f.dataType for f in d.schema.fields), strict=True))
    amount, priority = F.col("amount"), F.col("priority")
    after = k.select("id", F.col("price").alias("price_after"))
    return d.join(after, "id", "left").select(
        "id",
        cells.is_null_like(amount, types["amount"]).alias("null_like"),
        cells.to_number(amount, types["amount"]).alias("number"),
        cells.squeeze_blanks(priority).alias("squeezed"),
        cells.fold_key(priority, types["priority"]).alias("folded"),
        cells.guess_dtype(amount, types["amount"]).alias("guessed"),
        cells.values_match(F.col("price"), types["price"], F.col("price_after"), types["price"]).alias("same_price"),
        cells.issue_id(F.lit("orders"), F.col("id"), F.lit("price"), F.lit("outlier")).alias("issue"),
    )


# -- sources and sinks -------------------------------------------------------


@register(
    "coerce_types",
    """SELECT o_orderkey AS a, o_custkey AS b, cast(cast(o_totalprice as decimal(18,2)) as double) AS c,
 case when o_orderkey%7=0 then null else o_custkey end AS d, case when o_orderkey%7=0 then ' ' else o_orderstatus end AS e
 FROM orders""",
)
def coerce_types_query(spark, sf_dir):
    """Numbers and blanks that arrive as text."""
    texts = inputs.table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) a",
        "' ' || cast(o_custkey as string) b",
        "cast(cast(o_totalprice as decimal(18,2)) as string) c",
        "case when o_orderkey%7=0 then '  ' else cast(o_custkey as string) end d",
        "case when o_orderkey%7=0 then ' ' else o_orderstatus end e",
    )
    return coerce_types(texts)


@register(
    "ensure_id",
    """SELECT row_number() over (order by c_custkey) AS id, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""",
)
def ensure_id_query(spark, sf_dir):
    return ensure_id(inputs.table(spark, sf_dir, "customer"), scanned=True)


def _round_trip(fmt):
    def run(spark, sf_dir):
        customer = inputs.table(spark, sf_dir, "customer")
        done = export_table(customer, new_path(spark, "export"), "customer", output_format=fmt)
        loaded, _ = load_table(spark, done.path, name=f"customer_{fmt}")
        columns = ["id", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
        # text formats come back with the widest whole-number type
        return loaded.select(*columns).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))

    return run


for _fmt in ("csv", "json", "jsonl", "parquet"):
    register(
        f"round_trip_{_fmt}",
        """SELECT row_number() over (order by c_custkey) AS id, c_custkey, c_name, c_nationkey, c_acctbal,
 c_mktsegment FROM customer""",
    )(_round_trip(_fmt))


@register(
    "csv_breaks_in_fields",
    """SELECT doc_id AS id, md5(coalesce(text,'')) AS digest, length(coalesce(text,'')) AS n_chars, source FROM documents""",
)
def csv_breaks_in_fields(spark, sf_dir):
    """Whole documents as CSV, in which texts hold quotes, delimiters and line breaks; read again in byte ranges."""
    texts = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    path = new_path(spark, "documents.csv")
    texts.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    loaded, _ = load_table(spark, path, fmt="csv", name="documents_csv")
    text = F.coalesce("text", F.lit(""))
    return loaded.select("id", F.md5(text).alias("digest"), F.char_length(text).cast("long").alias("n_chars"), "source")


_ODD_ID = (
    "case when event_id%5=0 then null when event_id%7=1 then 'x'||cast(event_id as {text}) "
    "when event_id%3=2 then '42' else cast(event_id as {text}) end"
)


@register(
    "unique_ids",
    f"""WITH e AS (SELECT event_id, row_number() over (order by event_id) AS p, try_cast({_ODD_ID.format(text="varchar")} as bigint) AS c FROM events),
 f AS (SELECT *, coalesce(c, p + (SELECT case when max(c) is null or min(c) > count(*) or max(c) < 1 then 0 else greatest(max(c),0) end FROM e)) AS k FROM e),
 r AS (SELECT *, row_number() over (partition by k order by p) AS t FROM f)
 SELECT event_id, case when t=1 then k else (SELECT max(k) FROM f) + row_number() over (partition by t=1 order by p) end AS id FROM r""",
)
def unique_ids(spark, sf_dir):
    """Ids of which a third are one and the same, others NULL or no numbers: after loading, each row has its own."""
    events = inputs.table(spark, sf_dir, "events").select(F.expr(_ODD_ID.format(text="string")).alias("id"), "event_id")
    path = new_path(spark, "odd-ids")
    events.repartitionByRange("event_id").sortWithinPartitions("event_id").write.parquet(path)
    loaded, _ = load_table(spark, path, fmt="parquet", name="events_with_ids")
    return loaded.select("event_id", "id")


@register(
    "csv_text",
    "SELECT n_nationkey AS id, n_name, n_regionkey FROM nation",
)
def csv_text(spark, sf_dir):
    """CSV given as a string."""
    rows = inputs.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    text = "\n".join(["id,n_name,n_regionkey", *[f'{r[0]},"{r[1]}",{r[2]}' for r in rows]])
    loaded, _ = load_table(spark, text)
    return loaded.select("id", "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@register(
    "load_refused",
    """SELECT 'large' AS "table", count(*) AS n_rows FROM supplier
 UNION ALL SELECT 'just_enough', count(*) FROM region HAVING count(*) >= 5""",
)
def load_refused(spark, sf_dir):
    """Of four sources two are too small to be judged and are left out."""
    supplier, region = inputs.table(spark, sf_dir, "supplier"), inputs.table(spark, sf_dir, "region")
    frames = {"large": supplier, "just_enough": region, "four": region.where("r_regionkey < 4"), "none": supplier.where("s_suppkey < 0")}
    paths = {}
    for name, df in frames.items():
        paths[name] = new_path(spark, name)
        df.write.parquet(paths[name])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        loaded = load_tables(spark, paths, fmt="parquet")
    out = None
    for name, df in loaded.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "json_documents",
    """SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""",
)
def json_documents(spark, sf_dir):
    """JSON documents that wrap a list of up to 1 000 records each, one file per document."""
    customer = inputs.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    wrapped = customer.groupBy(F.floor(F.col("id") / 1000).alias("part")).agg(F.collect_list(F.struct("*")).alias("records"))
    path = new_path(spark, "documents.json")
    wrapped.select(F.to_json(F.struct("records"))).write.option("maxRecordsPerFile", 1).text(path)
    loaded, _ = load_table(spark, path, fmt="json", name="customer_documents")
    return loaded.select("id", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


_SOURCES = ("nation", "customer", "supplier", "part", "orders")


@register(
    "load_tables",
    " UNION ALL ".join(f"""SELECT '{t}_source' AS "table", count(*) AS n_rows, count(*) AS ids FROM {t}""" for t in _SOURCES),
)
def load_tables_query(spark, sf_dir):
    """Several sources at once: each table with as many distinct ids as rows."""
    loaded = load_tables(spark, {f"{t}_source": f"{sf_dir}/{t}.parquet" for t in _SOURCES})
    out = None
    for name, df in loaded.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("ids")).select(F.lit(name).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out
