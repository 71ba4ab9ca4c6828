"""Boilerplate lines by the number of distinct sites they appear on.

Each line hash has a HyperLogLog sketch of its sites; sketches merge by
aggregation, so a line that is everywhere costs each task one sketch.  A line
whose estimate is clear of the threshold by three standard errors is decided by
it; lines near the threshold get an exact distinct count, and only their rows are
shuffled for it.  Boilerplate lines leave every document but the one with the
smallest id that has them, where the first occurrence stays, so no text vanishes altogether.

Line hashes are stored once, without texts; every join is by narrow keys with a
stored table: hot lines are split by AQE, a document gathers only the positions
of its own lines, and texts move once at most, to meet those positions.

Cases: lines are compared without blanks at their ends, blank lines never leave, a
NULL text stays NULL, NULL is a site of its own, a NULL id is larger than any
other, equal rows are treated alike, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import meets, with_keys
from mendframe.session import materialize

MIN_SITES = 10
LG_K = 12
BLANK = " \t\x0b\x0c\r"


def line_hashes(text: Column) -> Column:
    """One hash per line; NULL for blank lines.  64 bits: at 1e7 boilerplate lines among 1e11, a false match is unlikely."""

    def one(line: Column) -> Column:
        bare = F.btrim(line, F.lit(BLANK))
        return F.when(bare != "", F.xxhash64(bare))

    return F.transform(F.split(text, "\n", -1), one)


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h): hashes of the lines (h, site) that appear on `min_sites` sites or more."""
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("n"))
    spread = sketched.where(F.col("n") >= min_sites).select("h", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialize(spread.where(F.col("sites") >= min_sites * (1 - error)), "line-spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + error)).select("h")
    near = spread.where(F.col("sites") <= min_sites * (1 + error)).select(F.col("h").alias("_h"))
    exact = lines.join(near, F.col("h") == F.col("_h"), "left_semi").select("h", "site").distinct()
    exact = exact.groupBy("h").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("h")
    return materialize(sure.unionByName(exact), "line-boilerplate")


def _without(text: Column, drop: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, drops in batches:
            out = []
            for text_, drop_ in zip(texts, drops, strict=True):
                gone = set() if drop_ is None else set(drop_)
                out.append(None if text_ is None else "\n".join(x for i, x in enumerate(text_.split("\n")) if i not in gone))
            yield pd.Series(out, dtype=object)

    return run(text, drop)


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K
) -> DataFrame:
    """(whole, clean, n_lines, n_removed): each row of `docs` as a struct, its text without boilerplate, its line counts."""
    rows = with_keys(docs)
    whole, text = F.col("whole"), F.col("whole").getField(text_col)
    site = F.xxhash64(F.coalesce(F.concat(F.lit("="), whole.getField(site_col).cast("string")), F.lit("")))
    hashed = rows.select("k1", "k2", whole.getField(id_col).alias("id"), site.alias("site"), line_hashes(text).alias("hashes"))
    hashed = materialize(hashed, "line-hashes")
    lines = hashed.select("k1", "k2", "id", "site", F.posexplode("hashes").alias("pos", "h")).where("h IS NOT NULL")
    spread = boilerplate(lines, min_sites, lg_k).select(F.col("h").alias("_h"))
    hits = materialize(lines.join(spread, meets("h")).select("h", "k1", "k2", "id", "pos"), "line-hits")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "pos")).alias("first")
    firsts = materialize(hits.groupBy(F.col("h").alias("_h")).agg(first), "line-firsts")
    stays = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")) & (F.col("pos") == F.col("first.pos"))
    extra = hits.join(firsts, meets("h")).where(~stays)
    drops = extra.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.collect_set("pos").alias("drop"))
    joined = rows.join(materialize(drops, "line-drops"), meets("k1", "k2"), "left").select("whole", text.alias("text"), "drop")
    # only texts that lose a line go to Python
    cut = _without(F.when(F.col("drop").isNotNull(), F.col("text")), F.col("drop"))
    clean = F.when(F.col("drop").isNull(), F.col("text")).otherwise(cut)
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    n_removed = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))
    return joined.select(
        "whole", clean.alias("clean"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed")
    )


def without_boilerplate(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` with clean texts and their own columns."""
    cleaned = clean_lines(docs, text_col=text_col, **options)
    return cleaned.select(*[F.col("clean").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns])
