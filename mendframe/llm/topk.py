"""Exact top-k by inner product with a dual-tree search over cover trees.

Vectors near the same pivot share a block; a pivot with many rows (a hot vector)
is spread over several blocks of at most `DATA_BLOCK` rows.  The stated queries
form blocks as well.  Blocks are the upper nodes of the trees: each knows a centre and its covering
radius.  First every query block is searched against one data block of its own pivot, which gives each query
a kth score to beat.  Then, on the centres and radii alone, pairs of blocks whose bound stays
below the worst of these scores are dropped; only the rest are copied to meet, each pair as one group of a
cogroup, so a task holds two bounded blocks and nothing meets unblocked, and the searches
start from the known scores.  In a
group both sides are indexed by a cover tree: the centres of a level are more than half
the node's radius apart, every point belongs to its nearest centre, and each node
knows its covering radius.  A pair of nodes is dropped when

    cq.cx + rq |cx| + rx |cq| + rq rx

the most that any of its inner products can be, is below the worst kth score of
the node's queries.  Equal scores go to the smaller id, so only a smaller bound
drops a pair.  The best k of each block merge by a ranked window, which Spark
limits to k rows per query before the shuffle.

Cases: vectors that are NULL or hold NULL, NaN or infinity take no part, nor do
rows without id; of rows that share an id the smallest vector counts, or with `all_rows`
each one is a query with ranks of its own and a candidate for all others; vectors are compared with vectors of equal length only; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.llm.common import ranked
from mendframe.session import materialize

DATA_BLOCK = 8192
QUERY_BLOCK = 4096
MAX_PIVOTS = 1024  # bound of the sample that places vectors; every vector is indexed
PAGE = 256  # blocks whose geometry one task holds
LEAF = 128
CENTRES = 16
EXACT = float(1 << 37)  # up to here scores and positions share one 64-bit key


@dataclass
class Node:
    start: int
    end: int
    centre: np.ndarray
    radius: float
    norm: float
    children: list[Node]


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Node, np.ndarray]:
    """The root, and the order of points in which every node is a slice."""
    order = np.arange(len(points))

    def node(start: int, end: int) -> Node:
        centre = points[order[start]]
        far = np.sqrt(((points[order[start:end]] - centre) ** 2).sum(axis=1).max())
        return Node(start, end, centre, float(far), float(np.sqrt((centre**2).sum())), [])

    root = node(0, len(points))
    todo = [root]
    while todo:
        at = todo.pop()
        if at.end - at.start <= leaf or at.radius == 0:
            continue
        own = order[at.start : at.end]
        nearest = np.sqrt(((points[own] - at.centre) ** 2).sum(axis=1))
        which, centres = np.zeros(len(own), dtype=int), 1
        while centres < CENTRES and nearest.max() > at.radius / 2:
            d = np.sqrt(((points[own] - points[own[nearest.argmax()]]) ** 2).sum(axis=1))
            closer = d < nearest
            which[closer], nearest = centres, np.minimum(d, nearest)
            centres += 1
        # the centre of each child, at distance zero, goes first
        by = np.lexsort((nearest, which))
        order[at.start : at.end] = own[by]
        start = at.start
        for size in np.bincount(which, minlength=centres):
            if size:
                at.children.append(child := node(start, start + int(size)))
                todo.append(child)
                start += int(size)
    return root, order


class DualSearch:
    """The k best data rows of every query of one block pair."""

    def __init__(self, q_ids, q, x_ids, x, k: int, floor=None, q_rows=None, x_rows=None):
        """`floor`: scores that a row has to reach, at least, to be among the k best of its query.

        `q_rows` and `x_rows` tell rows apart (the ids do if they are left out); a query does not find its own row.
        """
        self.k, self.pruned, self.scored = k, 0, 0
        self.q_root, order = cover_tree(q)
        self.q_ids, self.q = q_ids[order], q[order]
        self.q_rows = self.q_ids if q_rows is None else q_rows[order]
        self.floor = np.full(len(q), -np.inf) if floor is None else np.asarray(floor, dtype=float)[order]
        self.x_root, order = cover_tree(x)
        self.x_ids, self.x = x_ids[order], x[order]
        self.x_rows = self.x_ids if x_rows is None else x_rows[order]
        self.by_id = np.argsort(self.x_ids, kind="stable")
        place = np.empty(len(x), dtype=np.int64)
        place[self.by_id] = np.arange(len(x))
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
        self.exact = largest < EXACT and len(x) < 1 << 24
        # one key per (score, id): larger is better, equal scores prefer the smaller id
        self.lowest = -(1 << 62) if self.exact else -(1 << 400)
        kind = np.int64 if self.exact else object
        if not self.exact:
            self.q = np.array([[int(v) for v in row] for row in self.q], dtype=object).reshape(q.shape)
            self.x = np.array([[int(v) for v in row] for row in self.x], dtype=object).reshape(x.shape)
        self.place = place.astype(kind)
        self.best = np.full((len(q), k), self.lowest, dtype=kind)
        self.worst = self.floor.copy()

    def bound(self, a: Node, b: Node) -> float:
        most = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return most + 1e-9 * abs(most) + 1e-6  # never too small by rounding

    def run(self) -> Iterator[tuple[int, int, int, int]]:
        todo = [(self.bound(self.q_root, self.x_root), self.q_root, self.x_root)]
        while todo:
            bound, a, b = todo.pop()
            if bound < self.worst[a.start : a.end].min():
                self.pruned += 1
                continue
            if not a.children and not b.children:
                self.base(a, b)
                continue
            # the larger radius is split first
            if a.children and (not b.children or a.radius > b.radius):
                pairs = [(self.bound(c, b), c, b) for c in a.children]
            else:
                pairs = [(self.bound(a, c), a, c) for c in b.children]
            todo += sorted(pairs, key=lambda p: p[0])  # the best pair comes off first
        for i, row in enumerate(np.sort(self.best, axis=1)[:, ::-1]):
            for key in row.tolist():
                if key != self.lowest:
                    score, place = -((-key) >> 24), (-key) & ((1 << 24) - 1)
                    yield int(self.q_rows[i]), int(self.q_ids[i]), int(self.x_ids[self.by_id[place]]), score

    def base(self, a: Node, b: Node) -> None:
        rows, cols = slice(a.start, a.end), slice(b.start, b.end)
        scores = self.q[rows] @ self.x[cols].T
        self.scored += scores.size
        keys = (scores.astype(np.int64) if self.exact else scores) * (1 << 24) - self.place[cols]
        keys[self.q_rows[rows][:, None] == self.x_rows[cols][None, :]] = self.lowest
        both = np.concatenate([self.best[rows], keys], axis=1)
        if self.exact:
            self.best[rows] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            kth = self.best[rows].min(axis=1)
            found = np.where(kth == self.lowest, -np.inf, np.ceil(kth / (1 << 24)) - 1)
        else:
            self.best[rows] = np.sort(both, axis=1)[:, -self.k :]
            found = np.array([-np.inf if v == self.lowest else float(v >> 24) - 1 for v in self.best[rows].min(axis=1)])
        self.worst[rows] = np.maximum(found, self.floor[rows])


def _matrix(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<f8").reshape(len(packed), -1)


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows with a `block` number; blocks hold one pivot's rows, `size` at most, evenly."""
    numbered = ranked(rows, "pivot", ["id", "vec"], "at")
    counts = materialize(rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("blocks")), f"{name}-pivots")
    before = Window.orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("pivot").alias("_pivot"), "n", "blocks", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("base"))
    # one row per pivot and length of vectors; the planner broadcasts it while it is small
    placed = numbered.join(bases, F.col("pivot") == F.col("_pivot"))
    block = F.col("base") + F.floor(F.col("at") * F.col("blocks") / F.col("n"))
    total = counts.agg(F.sum("blocks")).head()[0] or 0
    return placed.select("row", "id", "vec", "pivot", block.cast("long").alias("block")), int(total)


GEOMETRY = "block long, pivot string, width long, centre binary, radius double"


def _geometry(blocks: DataFrame) -> DataFrame:
    """Centre and covering radius of each block, stored."""

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(frame["vec"])
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9)
        return pd.DataFrame([{"block": frame["block"].iloc[0], "pivot": frame["pivot"].iloc[0], "width": points.shape[1], "centre": centre.astype("<f8").tobytes(), "radius": radius}])

    return materialize(blocks.groupBy("block").applyInPandas(measure, GEOMETRY), "topk-geometry")


def block_bounds(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """The most that an inner product of a point of block a with one of block b can be, for all pairs of blocks."""
    na, nb = np.sqrt((a**2).sum(axis=1)), np.sqrt((b**2).sum(axis=1))
    most = a @ b.T + np.outer(ra, nb) + np.outer(na, rb) + np.outer(ra, rb)
    return most + 1e-9 * (np.outer(na, nb) + np.outer(ra, nb) + np.outer(na, rb)) + 1e-6


def block_pairs(queries: DataFrame, data: DataFrame, n_queries: int, n_data: int, page: int = PAGE) -> DataFrame:
    """(q, d): the pairs of blocks that have to meet, stored; `queries` is the geometry with `floor`, the worst kth score known.

    Geometry only is copied here: a row per block, met in pages of `page` data blocks.
    """
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-n // page)) - 1).cast("long")))
    asked = queries.withColumn("turn", F.floor(F.col("block") / page)).withColumn("page", numbers(n_data))
    there = data.withColumn("page", F.floor(F.col("block") / page)).withColumn("turn", numbers(n_queries))

    def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width in set(q["width"]) & set(d["width"]):
            a, b = q[q["width"] == width], d[d["width"] == width]
            stack = lambda f: np.stack([np.frombuffer(v, "<f8") for v in f["centre"]])
            most = block_bounds(stack(a), a["radius"].to_numpy(), stack(b), b["radius"].to_numpy())
            at, to = np.nonzero(most >= a["floor"].to_numpy()[:, None])
            out.append(pd.DataFrame({"q": a["block"].to_numpy()[at], "d": b["block"].to_numpy()[to]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "d": []}, dtype="int64")

    return materialize(asked.groupBy("page", "turn").cogroup(there.groupBy("page", "turn")).applyInPandas(meet, "q long, d long"), "topk-pairs")


def _searched(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): the k best of each query in each data block that its block is paired with."""
    left = queries.join(pairs.select(F.col("q").alias("_q"), "d"), F.col("block") == F.col("_q"))
    left = left.select(F.col("block").alias("q"), "d", F.col("row").alias("q_row"), F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), "floor")
    right = data.join(pairs.select("q", F.col("d").alias("_d")), F.col("block") == F.col("_d"))
    right = right.select("q", F.col("block").alias("d"), F.col("row").alias("x_row"), F.col("id").alias("x_id"), F.col("vec").alias("x_vec"))

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x) and len(q["q_vec"].iloc[0]) == len(x["x_vec"].iloc[0]):
            run = DualSearch(q["q_id"].to_numpy(), _matrix(q["q_vec"]), x["x_id"].to_numpy(), _matrix(x["x_vec"]), k, q["floor"].to_numpy(), q["q_row"].to_numpy(), x["x_row"].to_numpy())
            out = list(run.run())
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])

    return left.groupBy("q", "d").cogroup(right.groupBy("q", "d")).applyInPandas(search, "row long, query_id long, vec_id long, score long")


def top_k(
    table: DataFrame,
    query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector: Column | None = None,
    data_block: int = DATA_BLOCK,
    query_block: int = QUERY_BLOCK,
    all_rows: bool = False,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row for which `query` (over `id`) holds."""
    given = F.col("embedding") if vector is None else vector
    rows = table.select(F.col(id_col).cast("long").alias("id"), given.cast("array<double>").alias("vec")).where(
        "id IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))"
    )
    rows = rows if all_rows else rows.groupBy("id").agg(F.min("vec").alias("vec"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vec"), "topk-vectors")
    total = rows.count()
    wanted = min(MAX_PIVOTS, -(-total // data_block))
    chosen = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(wanted).collect()  # at most MAX_PIVOTS rows
    pivots: dict[int, np.ndarray] = {}
    for row in chosen:
        pivots.setdefault(len(row["vec"]), []).append(row["vec"])
    pivots = {n: np.array(v, dtype=float).reshape(len(v), n) for n, v in pivots.items()}

    @F.pandas_udf("pivot string, vec binary")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            found, packed = [], []
            for v in vectors:
                v = np.asarray(v, dtype="<f8")
                near = pivots.get(len(v))
                found.append(f"{len(v)}:{0 if near is None else int(((near - v) ** 2).sum(axis=1).argmin())}")
                packed.append(v.tobytes())
            yield pd.DataFrame({"pivot": found, "vec": packed})

    placed = materialize(rows.select("row", "id", place("vec").alias("p")).select("row", "id", "p.pivot", "p.vec"), "topk-placed")
    data, n_data = _blocks(placed, data_block, "topk-data")
    queries, n_queries = _blocks(placed.where(query), query_block, "topk-queries")
    data, queries = materialize(data, "topk-data"), materialize(queries, "topk-queries")
    q_shape, d_shape = _geometry(queries), _geometry(data)
    # one data block of the own pivot gives each query a first kth score
    home = d_shape.groupBy(F.col("pivot").alias("_pivot")).agg(F.min("block").alias("d"))
    near = q_shape.join(home, F.col("pivot") == F.col("_pivot")).select(F.col("block").alias("q"), "d")
    queries = queries.withColumn("floor", F.lit(float("-inf")))
    first = materialize(_searched(queries, data, near, k), "topk-first")
    kth = first.groupBy("row").agg(F.min("score").cast("double").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    queries = queries.drop("floor").join(kth.select(F.col("row").alias("_row"), "kth"), F.col("row") == F.col("_row"), "left")
    queries = materialize(queries.withColumn("floor", F.coalesce("kth", F.lit(float("-inf")))).drop("_row", "kth"), "topk-floors")
    worst = queries.groupBy(F.col("block").alias("_block")).agg(F.min("floor").alias("floor"))
    asked = q_shape.join(worst, F.col("block") == F.col("_block")).drop("_block")
    pairs = block_pairs(asked, d_shape, n_queries, n_data)
    rest = pairs.join(near.select(F.col("q").alias("_q"), F.col("d").alias("_d")), (F.col("q") == F.col("_q")) & (F.col("d") == F.col("_d")), "left_anti")
    found = first.unionByName(_searched(queries, data, rest, k))
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
