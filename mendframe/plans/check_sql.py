"""Building blocks of the checking SQL (plain SQL over the given tables)."""

from __future__ import annotations

from mendframe.plans import inputs

# The blank characters, spelled out for an engine whose \s is ASCII only.
BLANK = (
    r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NUMBER = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"


def number(col: str) -> str:
    return f"(case when regexp_full_match({col}, '{NUMBER}') then try_cast(trim({col}) as double) end)"


def squeeze(col: str) -> str:
    inner = f"regexp_replace({col}, '{BLANK}+', ' ', 'g')"
    return f"regexp_replace({inner}, '^ | $', '', 'g')"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def blank(col: str) -> str:
    return f"({col} is null or regexp_full_match({col}, '{BLANK}*'))"


ORDERS = f"d AS ({inputs.sql_view(inputs.ORDERS_DIRTY, 'orders')})"
CLEANED = f"k AS ({inputs.sql_view(inputs.ORDERS_CLEANED, 'd', inputs.ORDERS_KEPT)})"
PARTS = f"p AS ({inputs.sql_view(inputs.PART_DIRTY, 'part')})"
LOG = f"lg AS ({inputs.sql_view(inputs.ACTION_LOG, 'events')})"

AMOUNT = number("amount")

# (column, numeric expression or NULL, null-like condition) of the two dirty tables
ORDER_COLUMNS = [
    ("id", "cast(id as double)", "id is null"),
    ("customer_id", "cast(customer_id as double)", "customer_id is null"),
    ("amount", AMOUNT, blank("amount")),
    ("price", "price", "price is null"),
    ("priority", number("priority"), blank("priority")),
    ("order_code", number("order_code"), blank("order_code")),
]
PART_COLUMNS = [
    ("id", "cast(id as double)", "id is null"),
    ("part_name", number("part_name"), blank("part_name")),
    ("kind", number("kind"), blank("kind")),
    ("size", "cast(size as double)", "size is null"),
    ("retail", "retail", "retail is null"),
    ("brand", number("brand"), blank("brand")),
]


def stats(source: str, table: str, columns) -> str:
    """One row per column: counts, logical type and moments of the numbers."""
    rows = []
    for c, x, null in columns:
        rows.append(f"""
SELECT '{table}' AS "table", '{c}' AS "column", count(*) AS row_count,
 count(*) filter (where {null}) AS null_count,
 count(distinct case when not ({null}) then {c} end) AS unique_count,
 count({x}) AS castable, count(case when {x} = floor({x}) then 1 end) AS whole,
 count(case when {x} >= 0 then 1 end) AS non_negative,
 avg({x}) AS mean, stddev_pop({x}) AS std, min({x}) AS lo, max({x}) AS hi, median({x}) AS med
FROM {source}""")
    body = " UNION ALL ".join(rows)
    return f"""SELECT *, case when row_count=null_count then 'unknown'
 when castable=row_count-null_count and whole=castable then 'int'
 when castable=row_count-null_count then 'float' else 'str' end AS dtype FROM ({body})"""


def ranked(source: str, column: str, x: str) -> str:
    """q1, q2, q3 at positions n//4, n//2, 3n//4 of the sorted values."""
    return f"""SELECT '{column}' AS "column", max(v) filter (where r = n//4) AS q1,
 max(v) filter (where r = n//2) AS q2, max(v) filter (where r = (3*n)//4) AS q3
FROM (SELECT {x} AS v, row_number() over (order by {x}) - 1 AS r, count(*) over () AS n
 FROM {source} WHERE {x} is not null)"""


def issue(kind, table, row_id, column, correct, number_, action, confidence) -> str:
    return f"""SELECT '{table}_'||cast({row_id} as varchar)||'_{column}_{kind}' AS issue_id,
 '{kind}' AS issue_type, '{table}' AS "table", {row_id} AS row_id, '{column}' AS "column",
 cast({correct} as varchar) AS correct, cast({number_} as double) AS correct_num,
 '{action}' AS action, cast({confidence} as double) AS confidence"""


def outliers(source: str, table: str, column: str, x: str) -> str:
    distance = "greatest(v-(q3+3*(q3-q1)), (q1-3*(q3-q1))-v)"
    score = f"least(0.99, round(0.60+{distance}/((q3-q1)*10.0+1e-9),4))"
    head = issue("outlier", table, "row_id", column, "null", "round(q2,4)", "set", score)
    return f"""{head}
FROM (SELECT t.id AS row_id, {x} AS v, q.* FROM {source} t, ({ranked(source, column, x)}) q)
WHERE q3-q1 <> 0 AND (v < q1-3*(q3-q1) OR v > q3+3*(q3-q1))"""


def categories(source: str, table: str, column: str) -> str:
    form = strip(column)
    return f"""{issue("inconsistent_category", table, "s.id", column, "w.form", "null", "set", 0.85)}
FROM (SELECT id, {form} AS form FROM {source} WHERE not {blank(column)}) s JOIN (
 SELECT folded, form FROM (SELECT lower(form) AS folded, form,
   row_number() over (partition by lower(form) order by n desc, first_id) AS r
  FROM (SELECT {form} AS form, count(*) AS n, min(id) AS first_id FROM {source}
   WHERE not {blank(column)} GROUP BY 1)) WHERE r=1) w
 ON lower(s.form)=w.folded
WHERE s.form <> w.form AND (SELECT count(distinct {column}) FROM {source} WHERE not {blank(column)}) <= 20"""


def whitespace(source: str, table: str, column: str, key: str = "id") -> str:
    fixed = squeeze(column)
    return f"""{issue("whitespace", table, key, column, fixed, "null", "set", 0.90)}
FROM {source} WHERE not {blank(column)} AND {fixed} <> {column}"""


ORDER_NULLS = f"""{issue("null", "orders_dirty", "id", "amount", "null", "null", "any",
 "(SELECT round(1.0-count(*) filter (where " + blank("amount") + ")*1.0/count(*),4) FROM d)")}
FROM d WHERE {blank("amount")}"""
ORDER_TYPES = f"""{issue("type_error", "orders_dirty", "id", "amount", "null",
 "(SELECT median(" + AMOUNT + ") FROM d)", "set", 1.0)}
FROM d WHERE not {blank("amount")} AND {AMOUNT} is null
 AND (SELECT count({AMOUNT})*1.0/count(*) filter (where not {blank("amount")}) FROM d) >= 0.80"""
ORDER_NEGATIVES = f"""{issue("constraint", "orders_dirty", "id", "amount", "null", "abs(" + AMOUNT + ")", "set", 0.95)}
FROM d WHERE {AMOUNT} < 0
 AND (SELECT count(*) filter (where {AMOUNT}>=0)*1.0/count({AMOUNT}) FROM d) >= 0.75"""
ORDER_OUTLIERS = " UNION ALL ".join(
    [
        outliers("d", "orders_dirty", "customer_id", "cast(customer_id as double)"),
        outliers("d", "orders_dirty", "price", "price"),
    ]
)
ORDER_DUPLICATES = f"""{issue("duplicate", "orders_dirty", "id", "order_code", "null", "null", "delete", 1.0)}
FROM (SELECT id, row_number() over (partition by lower({strip("order_code")}) order by id) AS r
 FROM d WHERE not {blank("order_code")}) WHERE r > 1"""
ORDER_ORPHANS = f"""{issue("fk_violation", "orders_dirty", "id", "customer_id", "null", "null", "delete", 0.90)}
FROM d WHERE customer_id is not null AND not exists (SELECT 1 FROM customer c WHERE c.c_custkey=d.customer_id)"""
ORDER_SPACES = " UNION ALL ".join(
    whitespace("d", "orders_dirty", c) for c in ("amount", "priority", "order_code")
)
ORDER_CATEGORIES = categories("d", "orders_dirty", "priority")

EASY = [ORDER_NULLS, ORDER_TYPES, ORDER_SPACES, ORDER_CATEGORIES]
MEDIUM = [*EASY, ORDER_NEGATIVES, ORDER_OUTLIERS]
HARD = [*MEDIUM, ORDER_DUPLICATES, ORDER_ORPHANS]


def issues(parts) -> str:
    return " UNION ALL ".join(parts)


ISSUES = f"i AS ({issues(HARD)})"


def middle_of(column: str, x: str, source: str) -> str:
    return f"(SELECT round(median({x}),4) FROM {source})"


PART_NULLS = " UNION ALL ".join(
    [
        f"""{issue("null", "part_dirty", "id", c, "null", middle, action,
 f"(SELECT round(1.0-count(*) filter (where {null})*1.0/count(*),4) FROM p)")}
FROM p WHERE {null}"""
        for c, null, middle, action in [
            ("size", "size is null", middle_of("size", "size", "p"), "set"),
            ("retail", "retail is null", middle_of("retail", "retail", "p"), "set"),
            ("brand", blank("brand"), "null", "any"),
        ]
    ]
)
PART_OUTLIERS = " UNION ALL ".join(
    [
        outliers("p", "part_dirty", "size", "cast(size as double)"),
        outliers("p", "part_dirty", "retail", "retail"),
    ]
)
PART_SPACES = " UNION ALL ".join(whitespace("p", "part_dirty", c) for c in ("part_name", "kind", "brand"))
PART_CATEGORIES = categories("p", "part_dirty", "kind")
