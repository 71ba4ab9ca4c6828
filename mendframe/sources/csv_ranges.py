"""CSV with line breaks inside quotes, read in byte ranges.

A physical line may end inside a quoted field, and whether it does depends on how it began.  So
each line is a function of two states, outside and inside of quotes: constant, identity or a
swap.  These compose; the state behind any line follows from the last constant before it and the
parity of the swaps since.  A first scan keeps the lines that are no identity, without their text,
composes them per file split (a byte range of Spark's own), and then the splits of each file in order: that
gives the state each split begins in.  A second scan deals the lines to tasks by split
and cuts them into records; a record that goes on in later splits takes its
rest from their heads.  Records are parsed by Spark's own CSV parser and stored in file order.

A field that is never closed ends with the file, without its last line break.

Files without a line that ends inside quotes need none of this and are scanned line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendframe.session import materialize

# One complete field: quoted, with what stands between its closing quote and the delimiter, or bare, or empty.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'
_FIELDS = f'(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
_LEFT_OPEN = f"{_FIELDS}{_QUOTED}\\z"
# begun outside of quotes, or inside
OPEN_FROM_OUTSIDE = f"\\A{_LEFT_OPEN}"
OPEN_FROM_INSIDE = f'\\A[^"]*+(?:""[^"]*+)*+(?:\\z|"[^,]*+,{_LEFT_OPEN})'

PARSING = {"escape": '"', "multiLine": "true"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, row, line): physical lines with their split; rows grow along a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def _with_function(lines: DataFrame) -> DataFrame:
    """Adds whether the line ends inside quotes, by how it began."""
    quote = F.contains("line", F.lit('"'))
    outside = quote & F.col("line").rlike(OPEN_FROM_OUTSIDE)
    inside = ~quote | F.col("line").rlike(OPEN_FROM_INSIDE)
    return lines.withColumn("from_outside", outside).withColumn("from_inside", inside)


def _composed(df: DataFrame, by: str, *order: str) -> DataFrame:
    """Adds `constant` and `swapped`: the composition of all functions of the group up to each row."""
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b = F.col("from_outside"), F.col("from_inside")
    df = df.withColumn("_swaps", F.sum((a & ~b).cast("long")).over(upto))
    last = F.last(F.when(a == b, F.struct(a.alias("value"), F.col("_swaps").alias("swaps"))), ignorenulls=True).over(upto)
    df = df.withColumn("_last", last)
    odd = F.col("_swaps") - F.coalesce(F.col("_last.swaps"), F.lit(0))
    return df.withColumn("constant", F.col("_last.value")).withColumn("swapped", odd % 2 == 1).drop("_last", "_swaps")


def _behind(incoming: Column) -> Column:
    """The state behind a composition, inside quotes being true."""
    return F.coalesce(F.col("constant"), incoming) != F.col("swapped")


def splits_of(spark: SparkSession, path: str) -> DataFrame:
    """One row per split, stored: number in file order, first of its file, incoming and outgoing state, and what else the cutting needs.

    `owner` is the number of the split in which the record begins that is open where this split does;
    `crlf` says that the file's first line break is one of two characters, `bare_cr` that a line holds a
    carriage return elsewhere, `opened` counts lines that end inside quotes if they began outside.
    """
    lines = _with_function(_lines(spark, path))
    last = F.col("line").endswith("\r")
    inner_cr = F.contains("line", F.lit("\r")) & ~(last & (F.instr("line", "\r") == F.length("line")))
    per_split = lines.groupBy("path", "start").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("from_outside"), 1)).alias("opened"),
        F.count(F.when(last, 1)).alias("n_crlf"),
        F.count(F.when(inner_cr, 1)).alias("bare_cr"),
        F.min_by(last, "row").alias("crlf"),
        F.max("row").alias("last_row"),
    )
    # this window sees one row per split
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path", "start"))
    splits = materialize(per_split.withColumn("split", number), "csv-splits")
    place = splits.select(F.col("path").alias("_path"), F.col("start").alias("_start"), "split", "last_row")
    moving = lines.where(F.col("from_outside") | ~F.col("from_inside")).drop("line")
    moving = moving.join(place, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start"))).drop("_path", "_start")
    events = materialize(_composed(moving, "split", "row").select("split", "row", "last_row", "constant", "swapped"), "csv-events")
    ends = events.groupBy(F.col("split").alias("_split")).agg(F.max_by(F.struct("constant", "swapped"), "row").alias("end"))
    state = splits.join(ends, F.col("split") == F.col("_split"), "left").drop("_split")
    # the function of a split: what it makes of either state
    constant, swapped = F.col("end.constant"), F.coalesce(F.col("end.swapped"), F.lit(False))
    state = state.withColumn("from_outside", F.coalesce(constant, F.lit(False)) != swapped).withColumn("from_inside", F.coalesce(constant, F.lit(True)) != swapped)
    state = _composed(state.drop("end"), "path", "split").withColumn("outgoing", _behind(F.lit(False)))
    along = Window.partitionBy("path").orderBy("split")
    state = state.withColumn("first", F.row_number().over(along) == 1).withColumn("incoming", F.lag("outgoing", 1, False).over(along))
    state = state.withColumn("crlf", F.first("crlf").over(along)).drop("from_outside", "from_inside", "constant", "swapped")
    state = materialize(state, "csv-states")
    # a record begins in a split that begins outside, or behind a line that ends outside
    known = events.join(state.select(F.col("split").alias("_split"), "incoming"), F.col("split") == F.col("_split"))
    begun = known.where(~_behind(F.col("incoming")) & (F.col("row") < F.col("last_row"))).select(F.col("split").alias("_begun")).distinct()
    state = state.join(begun, F.col("split") == F.col("_begun"), "left")
    begins = F.when(~F.col("incoming") | F.col("_begun").isNotNull(), F.col("split"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    return materialize(state.withColumn("owner", F.last(begins, ignorenulls=True).over(before)).drop("_begun"), "csv-states")


def _records(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """(split, row, text): the text of each record, at its first line."""
    place = splits.select(F.col("path").alias("_path"), F.col("start").alias("_start"), "split", "first", "incoming", "outgoing", "owner", "crlf")
    lines = _with_function(_lines(spark, path))
    lines = lines.join(place, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start"))).drop("_path", "_start", "path", "start")
    # a break of two characters counts as one, in fields too, where the file uses it
    line = F.when(F.col("crlf") & F.col("line").endswith("\r"), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    lines = lines.withColumn("line", line)

    def cut(some: DataFrame) -> DataFrame:
        along = Window.partitionBy("split").orderBy("row")
        some = _composed(some, "split", "row").withColumn("open", _behind(F.col("incoming")))
        some = some.withColumn("begins", ~F.coalesce(F.lag("open").over(along), F.col("incoming")))
        return some.withColumn("record", F.sum(F.col("begins").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    dealt = cut(lines)
    # all lines of a record meet at its first one; tasks hold whole splits by now, so nothing moves
    inside = Window.partitionBy("split", "record").orderBy("row").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = dealt.withColumn("pieces", F.collect_list("line").over(inside)).withColumn("stays_open", F.last("open").over(inside))
    found = found.where("begins").select("split", "row", "first", "record", F.array_join("pieces", "\n").alias("text"), (F.col("stays_open") & F.col("outgoing")).alias("goes_on"))
    # what begins in one split and ends in another
    heads = cut(lines.where("incoming")).where("record = 0 AND owner IS NOT NULL")
    rest = F.transform(F.array_sort(F.collect_list(F.struct("split", "row", "line"))), lambda x: x["line"])
    heads = heads.groupBy(F.col("owner").alias("_owner")).agg(F.array_join(rest, "\n").alias("rest"))
    joined = found.join(heads, (F.col("split") == F.col("_owner")) & F.col("goes_on"), "left")
    whole = F.when(F.col("rest").isNotNull(), F.concat("text", F.lit("\n"), "rest")).otherwise(F.col("text"))
    header = F.col("first") & (F.col("record") == 1)
    return joined.where(~header).select("split", "row", whole.alias("text")).where("text <> ''")


def read(spark: SparkSession, path: str, by_lines, in_one) -> DataFrame:
    """All columns as text.

    `by_lines` reads files whose records are lines; `in_one` reads a file in one task: its header serves
    every case, its rows only files with carriage returns for line breaks.
    """
    splits = splits_of(spark, path)
    sums = splits.agg(F.sum("opened"), F.sum("bare_cr"), F.sum("n_crlf"), F.sum("n"), F.count(F.when(F.col("first"), 1))).head()
    opened, bare_cr, n_crlf, n, files = (x or 0 for x in sums)
    if not opened and not bare_cr and (not n_crlf or n_crlf >= n - files):
        return by_lines(spark, path)
    whole = in_one(spark, path)
    if bare_cr and _first_break_is_cr(spark, path):
        return whole
    # stored, because dealing rows out by range looks at them twice
    records = materialize(_records(spark, path, splits), "csv-records")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in whole.columns)
    parsed = records.select("split", "row", F.from_csv("text", schema, PARSING).alias("r"))
    ordered = parsed.repartitionByRange("split", "row").sortWithinPartitions("split", "row")
    return materialize(ordered.select("r.*"), "csv-rows")


def _first_break_is_cr(spark: SparkSession, path: str) -> bool:
    """Whether a file's first line break is a bare carriage return."""
    first = _lines(spark, path).where(F.col("start") == 0).groupBy("path").agg(F.min_by("line", "row").alias("line"))
    return bool(first.where(F.instr("line", "\r").between(F.lit(1), F.length("line") - 1)).head(1))
