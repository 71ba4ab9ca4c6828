"""JSON documents, a list of records or an object that wraps one, read in byte ranges.

The text is read in segments that end with a closing brace, so a record ends where a segment does.
What a segment does to the structural state is known for both ways it may begin, outside or inside of a
string: whether it changes that, and by how much the depth of brackets grows.  The first adds up
modulo two, the second adds up along the states found so; both sums go along the segments of a file split (a
byte range of Spark's own), then along the splits of each file.  A record ends where the depth is back
at that of the list; one that goes on in later splits takes its rest from their heads.  Records are stored
one per line, in file order, and read by Spark's own JSON Lines reader.

Escapes do not cross segments, because no escape ends with a brace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendframe.session import materialize, new_path

END = "}"


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, row, text): segments with their split; rows grow along a split."""
    return spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("text"),
    )


def _with_function(segments: DataFrame) -> DataFrame:
    """Adds `turns` (an odd number of quotes) and the growth of depth, by whether the segment begins inside a string."""
    bare = F.regexp_replace("text", r'(?s)\\.', "")
    segments = segments.withColumn("_bare", bare).withColumn("_quotes", F.expr("length(_bare) - length(replace(_bare, '\"', ''))"))
    segments = segments.withColumn("turns", (F.col("_quotes") % 2 == 1))

    def grown(outside: Column, ends_inside: Column) -> Column:
        kept = F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))
        return (kept - F.when(ends_inside, F.lit(0)).otherwise(F.lit(1))).cast("long")

    strings = r'"[^"]*+(?:"|\z)'
    from_outside = F.regexp_replace("_bare", strings, "")
    from_inside = F.regexp_replace(F.regexp_replace("_bare", r'\A[^"]*+(?:"|\z)', ""), strings, "")
    segments = segments.withColumn("grown_outside", grown(from_outside, F.col("turns"))).withColumn("grown_inside", grown(from_inside, ~F.col("turns")))
    return segments.drop("_bare", "_quotes")


def _along(by: str, order: str):
    return Window.partitionBy(by).orderBy(order)


def _states(segments: DataFrame) -> DataFrame:
    """Adds, for segments with `split`, `inside` and `depth` (of their split's beginning), whether each ends inside a string, and the depth there."""
    along = _along("split", "row")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd = F.sum(F.col("turns").cast("long")).over(upto) % 2 == 1
    segments = segments.withColumn("ends_inside", F.col("inside") != odd)
    begins_inside = F.coalesce(F.lag("ends_inside").over(along), F.col("inside"))
    segments = segments.withColumn("_grown", F.when(begins_inside, F.col("grown_inside")).otherwise(F.col("grown_outside")))
    return segments.withColumn("depth_after", F.col("depth") + F.sum("_grown").over(upto)).drop("_grown")


def splits_of(spark: SparkSession, path: str, base: int) -> DataFrame:
    """One row per split, stored: number in file order, state at its beginning, whether a record is open there and at its end, and the split that record begins in."""
    segments = _with_function(_segments(spark, path)).drop("text")
    segments = materialize(segments, "json-segments")
    per_split = segments.groupBy("path", "start").agg((F.sum(F.col("turns").cast("long")) % 2 == 1).alias("turns"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path", "start"))  # one row per split
    splits = per_split.withColumn("split", number)
    along = _along("path", "split")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum(F.col("turns").cast("long")).over(before), F.lit(0)) % 2 == 1)
    splits = materialize(splits.withColumn("first", F.row_number().over(along) == 1).drop("turns"), "json-splits")
    place = splits.select(F.col("path").alias("_path"), F.col("start").alias("_start"), "split", "inside", F.lit(0).cast("long").alias("depth"))
    known = segments.join(place, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start"))).drop("_path", "_start", "path", "start")
    known = materialize(_states(known).select("split", "row", "ends_inside", "depth_after"), "json-depths")
    grown = known.groupBy(F.col("split").alias("_split")).agg(F.max_by("depth_after", "row").alias("grown"), F.max("row").alias("last_row"))
    splits = splits.join(grown, F.col("split") == F.col("_split")).drop("_split")
    splits = splits.withColumn("depth", F.coalesce(F.sum("grown").over(before), F.lit(0)))
    at = splits.select(F.col("split").alias("_split"), "depth", "last_row")
    ends = known.join(at, F.col("split") == F.col("_split")).where(~F.col("ends_inside") & (F.col("depth_after") + F.col("depth") <= base))
    # where records end: in the split at all before its last segment, and at its last one
    per = ends.groupBy(F.col("split").alias("_split")).agg(F.max(F.col("row") < F.col("last_row")).alias("_within"), F.max(F.col("row") == F.col("last_row")).alias("_closed"))
    splits = splits.join(per, F.col("split") == F.col("_split"), "left").drop("_split")
    splits = splits.withColumn("outgoing", ~F.coalesce("_closed", F.lit(False))).withColumn("incoming", F.lag("outgoing", 1, False).over(along))
    begins = F.when(~F.col("incoming") | F.coalesce("_within", F.lit(False)), F.col("split"))
    return materialize(splits.withColumn("owner", F.last(begins, ignorenulls=True).over(before)).drop("_within", "_closed", "grown", "last_row"), "json-states")


def _records(spark: SparkSession, path: str, splits: DataFrame, base: int) -> DataFrame:
    """(split, row, opening, text): the text of each record at its first segment; what stands before a record is still with it."""
    place = splits.select(F.col("path").alias("_path"), F.col("start").alias("_start"), "split", "first", "inside", "depth", "incoming", "outgoing", "owner")
    segments = _with_function(_segments(spark, path))
    segments = segments.join(place, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start"))).drop("_path", "_start", "path", "start")

    def cut(some: DataFrame) -> DataFrame:
        along = _along("split", "row")
        some = _states(some).withColumn("open", F.col("ends_inside") | (F.col("depth_after") > base))
        some = some.withColumn("begins", ~F.coalesce(F.lag("open").over(along), F.col("incoming")))
        return some.withColumn("record", F.sum(F.col("begins").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    dealt = cut(segments)
    inside = Window.partitionBy("split", "record").orderBy("row").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = dealt.withColumn("pieces", F.collect_list("text").over(inside)).withColumn("stays_open", F.last("open").over(inside))
    found = found.where("begins").select("split", "row", (F.col("first") & (F.col("record") == 1)).alias("opening"), F.array_join("pieces", END).alias("text"), (F.col("stays_open") & F.col("outgoing")).alias("goes_on"))
    heads = cut(segments.where("incoming")).where("record = 0 AND owner IS NOT NULL")
    rest = F.transform(F.array_sort(F.collect_list(F.struct("split", "row", "text"))), lambda x: x["text"])
    heads = heads.groupBy(F.col("owner").alias("_owner")).agg(F.array_join(rest, END).alias("rest"))
    joined = found.join(heads, (F.col("split") == F.col("_owner")) & F.col("goes_on"), "left")
    whole = F.concat("text", F.coalesce(F.concat(F.lit(END), "rest"), F.lit("")), F.lit(END))
    return joined.select("split", "row", "opening", whole.alias("text"))


def read(spark: SparkSession, path: str, keys: tuple[str, ...], in_one) -> DataFrame:
    """The records of a document; `in_one` reads documents of other shapes, a file in one task."""
    heads = _segments(spark, path).where(F.col("start") == 0).groupBy("path").agg(F.min_by("text", "row").alias("text"))
    wrapped = rf'(?s)\A﻿?\s*\{{\s*"(?:{"|".join(keys)})"\s*:\s*\[\s*\{{'
    shape = F.when(F.col("text").rlike(r"(?s)\A﻿?\s*\[\s*\{"), F.lit(1)).when(F.col("text").rlike(wrapped), F.lit(2)).otherwise(F.lit(0))
    shapes = [r[0] for r in heads.select(shape.alias("s")).distinct().collect()]
    if len(shapes) != 1 or not shapes[0]:
        return in_one(spark, path)
    base = shapes[0]
    # stored, because dealing rows out by range looks at them twice
    records = materialize(_records(spark, path, splits_of(spark, path, base), base), "json-pieces")
    opened = F.regexp_replace("text", r'(?s)\A﻿?\s*(?:\{\s*"[a-z]+"\s*:\s*)?\[\s*', "")
    text = F.when(F.col("opening"), opened).otherwise(F.regexp_replace("text", r"(?s)\A\s*,\s*", ""))
    # line breaks stand between tokens only, never in strings
    ordered = records.select("split", "row", F.regexp_replace(text, r"[\r\n]+", " ").alias("text"))
    ordered = ordered.repartitionByRange("split", "row").sortWithinPartitions("split", "row")
    stored = materialize(ordered.select("text"), "json-records")
    # what closes the list and its wrapper is no record
    closing = F.col("text").rlike(r"\A\s*\]\s*,?[^{\[]*\}?\s*\z")
    if stored.where(~closing & ~F.col("text").startswith("{")).head(1) or stored.where(closing & F.col("text").rlike(r'"|:')).head(1):
        return in_one(spark, path)
    lines = new_path(spark, "json-lines")
    stored.where(~closing).write.text(lines)
    return spark.read.json(lines)
