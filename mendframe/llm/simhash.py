"""SimHash near-duplicates found by covering locality-sensitive hashing.

Bit i of a fingerprint gets a non-zero label of radius + 1 bits, by turns.  For each
non-zero v there is one table, whose mask keeps the bits with an odd product of
label and v.  Any `radius` labels are orthogonal to some v, so two fingerprints
that differ in at most `radius` bits agree under some mask: every such pair meets
in a table, without exception.

Copies are merged into one node per fingerprint first.  Buckets of at most
`BUCKET` nodes are compared inside their join, which emits only true links.  In a
larger bucket each node instead names the points within radius / 2 bits; two nodes
are linked exactly if they share a point, a point has a bounded number of nodes,
and so a hot bucket costs a fixed number of rows per node and loses no link.

Components come from repeated contraction: each node joins the neighbour with the
smallest hash (a new one each round), edges are renamed and made distinct.  Steps
are stored in the shared folder; hot nodes are split by AQE, as each join is
between stored tables.

Cases: NULL or blank texts have fingerprint zero and are linked like others, a
NULL id is larger than any other, repeated rows are members of one component, an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import meets
from mendframe.session import materialize

SEED = 42
WORDS = 3
RADIUS = 2
BUCKET = 64


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    as_bytes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(as_bytes[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The signed 64-bit SimHash of the word shingles of a text."""
    from xxhash import xxh64_intdigest

    own = (text or "").encode().lower().split()  # bytes: only A-Z change, only six characters split
    if not own:
        return 0
    whole = b" ".join(own)
    size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    ends = np.cumsum(size + 1) - 1
    starts, span = (ends - size).tolist(), min(words, len(own))
    hashes = [xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, ends[span - 1 :].tolist(), strict=False)]
    return majority(np.array(hashes, dtype=np.uint64))


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return run(text)


def masks(radius: int = RADIUS) -> list[int]:
    """One mask per table, as signed longs."""
    tables = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, tables + 1):
        kept = sum(1 << i for i in range(64) if ((i % tables + 1) & v).bit_count() % 2)
        out.append(kept - (1 << 64) if kept >> 63 else kept)
    return out


def _flips(radius: int) -> list[int]:
    """All changes of at most radius / 2 bits."""
    found = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all stored `nodes` (fp) within `radius` bits, perhaps by way of others."""
    if radius % 2:
        raise ValueError("the radius must be even")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))]))
    tables = nodes.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    shared = tables.groupBy(F.col("t").alias("_t"), F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(shared, "simhash-buckets")
    members = tables.join(shared, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key"))).select("t", "key", "fp", "n")
    members = materialize(members, "simhash-members")
    few = members.where(F.col("n") <= bucket)
    left, right = few.alias("l"), few.alias("r")
    near = (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp"))
    near = near & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius)
    direct = left.join(right, near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    many = members.where(F.col("n") > bucket).select("fp").distinct()
    points = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in _flips(radius)])).alias("point"))
    # a point has as many nodes as there are flips, at most
    around = points.groupBy("point").agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("a")).where("size(fps) > 1")
    through = around.select("a", F.explode("fps").alias("b")).where("a <> b")
    return materialize(direct.unionByName(through).distinct(), "simhash-links")


def connected(edges: DataFrame) -> DataFrame | None:
    """(node, root) of every node that stored `edges` (a, b) touch; None without edges."""
    steps: list[DataFrame] = []
    while edges.head(1):
        turn = len(steps)
        weight = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(weight("b")), F.min(weight("a")))["n"].alias("to"))
        best = materialize(best, "simhash-contract")
        steps.append(best)
        for side in ("a", "b"):
            step = best.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
            edges = edges.join(step, F.col(side) == F.col("_node")).withColumn(side, F.col("_to")).drop("_node", "_to")
        ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialize(ordered.distinct(), "simhash-edges")
    if not steps:
        return None
    final = steps[-1]
    for step in reversed(steps[:-1]):
        later = final.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
        final = materialize(step.join(later, F.col("to") == F.col("_node"), "left").select("node", F.coalesce("_to", "to").alias("to")), "simhash-roots")
    return final.select("node", F.col("to").alias("root"))


def label(stored: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, first): for each fingerprint of the stored (doc_id, fp, k1, k2), the smallest (id, k1, k2) of its component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("k1"), F.col("k2")))
    nodes = materialize(stored.groupBy("fp").agg(first.alias("first")), "simhash-nodes")
    roots = connected(links(nodes, radius, bucket))
    if roots is None:
        return nodes
    named = materialize(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-named")
    of_root = materialize(named.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("_first")), "simhash-firsts")
    return materialize(named.join(of_root, F.col("root") == F.col("_root")).select("fp", F.col("_first").alias("first")), "simhash-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp"), *[F.lit(0).cast("long").alias(k) for k in ("k1", "k2")])
    stored = materialize(rows, "simhash-rows")
    labels = label(stored, radius, bucket).select(F.col("fp").alias("_fp"), "first")
    return stored.join(labels, F.col("fp") == F.col("_fp")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"),
    )
