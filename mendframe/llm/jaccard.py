"""Near-duplicates by SimHash and the Jaccard similarity of word shingles, without a missed pair.

A text is the set of its lower-cased shingles of five words; two texts are linked
if the sets have a similarity of 0.8 or more, and a component keeps one row.

Sets first meet by their SimHash of 320 bits.  A similarity of 0.8 leaves some 15 %
of the bits different, too many for covering masks over the whole, so the masks of
`simhash.py` cover each part of 40 bits: parts within `RADIUS` bits meet, without
exception, and pairs are compared by their whole sets before they are links.  No
radius of a random projection is certain to hold a similarity, so some pairs have
no near part; the rest of the module finds them, and passes over what the
fingerprints have connected.

Two sets of that similarity share a shingle among the first n - ceil(0.8 n) + 1 of
each, in any order common to all (prefix filter).  The order is by how many texts
fall on the shingle's cell of a table of fixed size: common passages come last.  So
each set meets others under its rare shingles only, and no similar pair is left out.

Groups of at most `BUCKET` sets are paired inside their join, unless connected; a pair stays if the
shingles it shares among the first ones allow the similarity, and is then compared
by its whole sets.  In a larger group each set is first compared with one leader,
for some rounds; then only sets that are not yet in one component are paired, which
is quadratic just where many sets share their rarest fifth without being similar.

Cases: NULL and blank texts are the empty set and equal; a text under five words is
one shingle; texts of any length are read whole; sets are told apart by 64-bit hashes of their 64-bit shingles; a NULL id
is larger than any other; of rows that share the smallest id of a component one stays, of equal rows one; further columns,
whatever their names, are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm import simhash
from mendframe.llm.common import batches_of, meets, with_keys
from mendframe.llm.simhash import connected
from mendframe.session import materialize

SEED = 42
WORDS = 5
PARTS = 8  # of a set's fingerprint
PART_BYTES = 5
RADIUS = 2  # bits in which two parts may differ to meet
BUCKET = 64
ROUNDS = 4
CELL_BITS = 18  # of the table that orders shingles
WANTED_BITS = 20  # of the table that tells which sets are compared
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of the hashed word shingles of a text."""
    from xxhash import xxh64_intdigest

    own = (text or "").lower().encode().split()
    if not own:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter((xxh64_intdigest(w, SEED) for w in own), dtype=np.uint64, count=len(own))
    span = min(words, len(own))
    n = len(own) - span + 1
    out = np.full(n, SEED, dtype=np.uint64)
    for j in range(span):
        out = (out ^ each[j : j + n]) * MULTIPLIER
        out ^= out >> np.uint64(32)
    return np.unique(out)


def print_of(found: np.ndarray) -> int:
    """The signed 64-bit hash of a set."""
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(found.astype("<u8").tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def fingerprint(found: np.ndarray) -> list[int]:
    """The SimHash of a set in parts of 40 bits; the upper 24 bits of each say which part it is.

    The number of the part is repeated, so that each covering mask keeps parts of two numbers apart.
    """
    whole, own = b"", found
    while len(whole) < PARTS * PART_BYTES:
        whole += simhash.majority(own).to_bytes(8, "little", signed=True)
        own = own * MULTIPLIER  # further bits come from further hashes
        own ^= own >> np.uint64(32)
    parts = [whole[at : at + PART_BYTES] + (0o11111111 * i).to_bytes(3, "little") for i, at in enumerate(range(0, PARTS * PART_BYTES, PART_BYTES))]
    return [int.from_bytes(part, "little", signed=True) for part in parts]


def first_ones(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The shingles under which a set meets all sets of similarity 0.8."""
    n = len(found)
    order = np.lexsort((found, weights[found >> np.uint64(64 - CELL_BITS)]))
    return found[order[: n - (4 * n + 4) // 5 + 1]] if n else found


def _texts(rows: DataFrame, schema: str, emit: Callable[[list[np.ndarray]], dict]) -> DataFrame:
    """A map over the texts of `rows` (text): emit(sets of a batch) gives the columns of `schema`."""

    def run(batches):
        for found in batches_of(batches):
            columns = emit([shingles(t) for t in found["text"]])
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))


def _ints(values: list[int], bits: int) -> pa.Array:
    return pa.array(values, pa.int64() if bits == 64 else pa.int32())


def prints(text: Column) -> Column:
    """A struct of the print and the parts of the fingerprint of a text's set."""

    @F.pandas_udf("fp long, parts array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            named = [(print_of(found), fingerprint(found)) for found in map(shingles, texts)]
            yield pd.DataFrame({"fp": pd.Series([p for p, _ in named], dtype="int64"), "parts": [f for _, f in named]})

    return run(text)


def cell_weights(texts: DataFrame) -> np.ndarray:
    """How many (text, shingle) fall on each cell: it decides the order, never the result."""

    def run(batches):
        counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for found in batches_of(batches):
            for t in found["text"]:
                np.add.at(counts, shingles(t) >> np.uint64(64 - CELL_BITS), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])

    found = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = np.zeros(1 << CELL_BITS, dtype=np.int64)
    weights[found["cell"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(weights, 2**32 - 1).astype(np.uint32)


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, set) of the sets in `wanted` (fp); a table of fixed size keeps most others out of the shuffle."""
    mask = (1 << WANTED_BITS) - 1
    cells = wanted.select(F.col("fp").bitwiseAND(F.lit(mask)).cast("int").alias("cell")).distinct().toArrow()["cell"].to_numpy()
    marked = np.zeros(1 << WANTED_BITS, dtype=bool)
    marked[cells] = True

    def emit(sets):
        named = [(p, s) for s in sets if marked[(p := print_of(s)) & mask]]
        return {"fp": _ints([p for p, _ in named], 64), "set": _arrays([s for _, s in named])}

    found = _texts(texts, "fp long, set array<long>", emit).dropDuplicates(["fp"])
    return materialize(found.join(wanted.distinct(), "fp", "left_semi"), "jaccard-sets")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of stored `pairs` (a, b), those of similarity 0.8 or more."""
    left, right = (sets.select(F.col("fp").alias(f"_{c}"), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return materialize(both.where(9 * shared >= 4 * (F.size("set_a") + F.size("set_b"))).select("a", "b"), "jaccard-links")


def _similar_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))
    return similar(pairs, sets_of(texts, ends)) if pairs.head(1) else pairs


def _sizes_allow(a: str, b: str) -> Column:
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def _pairs(joined: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b), the smaller print first, of (fp, size, _fp, _size)."""
    one, two = F.struct(F.col("fp").alias("f"), F.col("size").alias("s")), F.struct(F.col("_fp").alias("f"), F.col("_size").alias("s"))
    ordered = joined.where(_sizes_allow("size", "_size")).select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
    return ordered.select(F.col("x.f").alias("a"), F.col("y.f").alias("b"), F.col("x.s").alias("size_a"), F.col("y.s").alias("size_b"))


def _rooted(members: DataFrame, edges: DataFrame) -> DataFrame:
    roots = connected(edges)
    if roots is None:
        return members.withColumn("root", F.col("fp"))
    return members.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def links_by_fingerprint(nodes: DataFrame, texts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) of similarity 0.8 or more among sets that the fingerprints of the stored `nodes` (fp, parts) bring together.

    Parts within `RADIUS` bits meet in the covering tables.  Of sets that share a part, one meets the
    others and those of near parts.
    """
    owners = nodes.select("fp", F.explode("parts").alias("part"))
    leaders = materialize(owners.groupBy(F.col("part").alias("_part")).agg(F.min("fp").alias("lead")), "jaccard-parts")
    near = simhash.links(leaders.select(F.col("_part").alias("fp")), RADIUS, bucket)
    left, right = (leaders.select(F.col("_part").alias(f"_{c}"), F.col("lead").alias(f"lead_{c}")) for c in "ab")
    across = near.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select(F.col("lead_a").alias("x"), F.col("lead_b").alias("y"))
    within = owners.join(leaders, F.col("part") == F.col("_part")).select(F.col("lead").alias("x"), F.col("fp").alias("y"))
    met = across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return _similar_of(materialize(met.distinct(), "jaccard-near"), texts)


def links(texts: DataFrame, known: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b), the stored `known` ones among them, that connect the sets of `texts` (text) wherever the similarity is 0.8 or more."""
    weights = cell_weights(texts)

    def emit(sets):
        some = [s for s in sets if len(s)]
        return {"fp": _ints(list(map(print_of, some)), 64), "size": _ints(list(map(len, some)), 32), "first": _arrays([first_ones(s, weights) for s in some])}

    firsts = _texts(texts, "fp long, size int, first array<long>", emit).dropDuplicates(["fp"])
    firsts = materialize(firsts.select(F.explode("first").alias("key"), "fp", "size"), "jaccard-firsts")
    shared = firsts.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = firsts.join(materialize(shared, "jaccard-buckets"), F.col("key") == F.col("_key")).drop("_key")
    members = materialize(_rooted(members, known), "jaccard-members")
    other = members.select(F.col("key").alias("_key"), F.col("fp").alias("_fp"), F.col("size").alias("_size"), F.col("n").alias("_n"), F.col("root").alias("_root"))
    meet = (F.col("key") == F.col("_key")) & (F.col("fp") < F.col("_fp")) & (F.col("root") != F.col("_root"))
    few = members.where(F.col("n") <= bucket).join(other.where(F.col("_n") <= bucket), meet)
    rooted = materialize(members.where(F.col("n") > bucket).drop("n"), "jaccard-many")
    many, edges, found = rooted.drop("root"), known, _pairs(few)
    if many.head(1):
        sets = sets_of(texts, many.select("fp"))
        for turn in range(ROUNDS):
            lead = F.min(F.struct(F.xxhash64(F.lit(turn), "root").alias("h"), F.xxhash64(F.lit(turn), "fp").alias("g"), F.col("fp"), F.col("size"), F.col("root")))
            leaders = materialize(rooted.groupBy(F.col("key").alias("_key")).agg(lead.alias("lead")), "jaccard-leaders")
            met = rooted.join(leaders, F.col("key") == F.col("_key")).where(F.col("root") != F.col("lead.root"))
            met = met.select("fp", "size", F.col("lead.fp").alias("_fp"), F.col("lead.size").alias("_size"))
            new = similar(materialize(_pairs(met).select("a", "b").distinct(), "jaccard-stars"), sets)
            if not new.head(1):
                break
            edges = edges.unionByName(new)
            rooted = materialize(_rooted(many, edges), "jaccard-rooted")
        present = materialize(rooted.select("key", "root").distinct(), "jaccard-roots")
        apart = present.alias("l").join(present.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.root") < F.col("r.root")))
        apart = apart.select(F.col("l.key").alias("k"), F.col("l.root").alias("x"), F.col("r.root").alias("y"))
        second = rooted.select(F.col("key").alias("_key"), F.col("fp").alias("_fp"), F.col("size").alias("_size"), F.col("root").alias("_root"))
        apart = rooted.join(apart, (F.col("key") == F.col("k")) & (F.col("root") == F.col("x"))).join(second, (F.col("k") == F.col("_key")) & (F.col("y") == F.col("_root")))
        found = found.unionByName(_pairs(apart))
    # pairs of one root may have been counted in part only; they are connected already
    counted = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    rest = lambda c: F.floor((4 * F.col(c) + 4) / 5) - 1  # noqa: E731  what a set has behind its first ones
    enough = 9 * (F.col("c") + F.greatest(rest("size_a"), rest("size_b"))) >= 4 * (F.col("size_a") + F.col("size_b"))
    pairs = materialize(counted.where(enough).select("a", "b"), "jaccard-pairs")
    return edges.unionByName(_similar_of(pairs, texts))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest id stays.

    Of rows that repeat the smallest id in other columns one stays; of equal rows, one.
    """
    rows = with_keys(docs)
    printed = rows.select(F.col("whole").getField(id_col).alias("doc_id"), prints(F.col("whole").getField(text_col)).alias("set"), "k1", "k2")
    stored = materialize(printed.select("doc_id", "set.fp", "set.parts", "k1", "k2"), "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("k1"), F.col("k2")))
    nodes = materialize(stored.groupBy("fp").agg(first.alias("first"), F.first("parts").alias("parts")), "jaccard-nodes")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    roots = connected(links(texts, links_by_fingerprint(nodes, texts, bucket), bucket))
    if roots is not None:
        named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("root", "fp").alias("root"))
        nodes = named.groupBy("root").agg(F.min("first").alias("first"))
    chosen = nodes.select(F.col("first.k1").alias("_k1"), F.col("first.k2").alias("_k2")).distinct()
    kept = rows.join(materialize(chosen, "jaccard-chosen"), meets("k1", "k2"), "left_semi")
    return kept.groupBy("k1", "k2").agg(F.first("whole").alias("whole")).select("whole.*")
