"""Hard negatives from Hilbert-ordered Parquet blocks, chosen by zone maps.

Rows are sorted by length of vector, label and the place of the vector on a Hilbert curve through
its leading principal axes, and written as blocks: a Parquet row holds `BLOCK` vectors at most, with
their ids and labels and, in columns of their own, the smallest and largest value of each
dimension (the zone map) and of the labels.  Zone maps are read without the vectors.

An anchor asks for windows of scores.  Interval arithmetic bounds its inner product with
anything in a block: low = a+ . min + a- . max, high = a+ . max + a- . min, where a+ and a- are the
positive and negative parts of the anchor.  A block is read for an anchor only when the bounds
meet one of its windows and the block can hold a wanted label.  Two searches run:

1. positives: same label, scores from the kth best of the anchor's own block upwards;
2. negatives: other labels, one window per positive, from `low` to `high` percent of its score.

Anchors travel in chunks of `CHUNK`, near each other on the curve; blocks meet them in pages of `PAGE`
blocks.  In a page, blocks with higher bounds come first, and blocks whose bounds have fallen below
the kth score of each window are left unread.  The best k of each window and page merge in a
ranked window, k rows per page.  Every (anchor, block) pair is either computed or excluded by its
bounds.  Isotropic vectors of many dimensions exclude next to none; clustered ones do.

Products are exact: 64-bit floats up to 2^53, Python integers beyond, cut to 64 bits at the end.

Cases: rows without id, label or vector, or with a null, NaN or infinite component, take no part; rows that
share an id are rows of their own, each excluded from its own list only; equal vectors in any
number fill blocks like others; vectors meet vectors of equal length only; an empty
table gives no rows; a window above its own upper end (a negative positive score) is empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.session import materialize

BLOCK = 256
PAGE = 64
CHUNK = 4096
AXES, BITS = 7, 9
SAMPLE = 2048  # rows, at most, that place the axes; every row is indexed
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def hilbert_key(places: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below 2 ** bits.

    From the highest bit down, the cell of that bit is rotated into the frame of the curve; the
    rotated bits, as a Gray code, spell the key.
    """
    x = places.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(len(x)):
            here = (x[axis] >> level) & 1 == 1
            swap = np.where(here, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(here, low, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


class Axes:
    """Principal axes and range of a sample of vectors of one length."""

    def __init__(self, sample: np.ndarray):
        self.mean = sample.mean(axis=0)
        _, _, v = np.linalg.svd(sample - self.mean, full_matrices=False)
        self.axes = v[:AXES].T
        places = (sample - self.mean) @ self.axes
        self.low, span = places.min(axis=0), np.ptp(places, axis=0)
        self.scale = np.where(span > 0, ((1 << BITS) - 1) / np.where(span > 0, span, 1), 0)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        cells = np.clip(((vectors - self.mean) @ self.axes - self.low) * self.scale, 0, (1 << BITS) - 1)
        return hilbert_key(cells.astype(np.int64), BITS) if cells.shape[1] else np.zeros(len(vectors), np.int64)


def kind_of(vectors: np.ndarray) -> str:
    most = np.abs(vectors).max(initial=0)
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit integers."""
    if np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(1, a.shape[1]) < 1 << 53:
        return (a @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(x).T, LEAST, MOST).astype(np.int64).reshape(len(a), len(x))


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that the product of each anchor with anything in each zone can be."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1e-9 * (up @ np.maximum(np.abs(low), np.abs(high)).T - down @ np.maximum(np.abs(low), np.abs(high)).T)
    return least - slack, most + slack  # never too narrow by rounding


def wanted(anchors: dict, zones: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors must read which blocks, and the upper bounds."""
    least, most = bounds(anchors["vec"], zones["low"], zones["high"])
    label = anchors["label"][:, None]
    can = (zones["l_min"] <= label) & (label <= zones["l_max"]) if same else (zones["l_min"] != label) | (zones["l_max"] != label)
    meets = np.zeros_like(can)
    for j in range(anchors["low"].shape[1]):
        from_, to = anchors["low"][:, j : j + 1], anchors["high"][:, j : j + 1]
        meets |= (from_ <= to) & (most >= from_) & (least <= to)
    return can & meets, most


class Best:
    """The k best (score, id) of each window of each anchor."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.open = low <= high
        self.score = np.full((*low.shape, k), LEAST)
        self.id = np.full((*low.shape, k), MOST)
        self.n = np.zeros(low.shape, np.int64)

    def floor(self) -> np.ndarray:
        """The least score that can still enter each window."""
        return np.where(self.n == self.k, np.maximum(self.low, self.score[:, :, -1]), self.low)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """`scores` of anchors `rows` with vectors `ids`."""
        floor = self.floor()
        for j in range(self.low.shape[1]):
            fits = allowed & self.open[rows, j, None] & (scores >= floor[rows, j, None]) & (scores <= self.high[rows, j, None])
            at, col = np.nonzero(fits)
            if not len(at):
                continue
            who = np.unique(rows[at])
            old = np.arange(self.k)[None, :] < self.n[who, j, None]
            row = np.concatenate([rows[at], np.repeat(who, old.sum(axis=1))])
            score = np.concatenate([scores[at, col], self.score[who, j][old]])
            id_ = np.concatenate([ids[col], self.id[who, j][old]])
            order = np.lexsort((id_, ~score, row))  # ~ turns the order round and has no overflow
            row, score, id_ = row[order], score[order], id_[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank < self.k
            self.score[row[top], j, rank[top]], self.id[row[top], j, rank[top]] = score[top], id_[top]
            self.n[who, j] = np.minimum(np.bincount(row, minlength=len(self.n))[who], self.k)


def search(anchors: dict, blocks: list[dict], k: int, same: bool) -> tuple[Best, int]:
    """The best rows of `blocks` for each window, and how many (anchor, block) pairs were read."""
    best, read = Best(anchors["low"], anchors["high"], k), 0
    order = sorted(blocks, key=lambda b: -b["most"].max())
    for block in order:
        floor = np.where(best.open, best.floor(), MOST).min(axis=1)
        rows = block["rows"][block["most"] >= floor[block["rows"]]]
        if not len(rows):
            continue
        read += len(rows)
        scores = products(anchors["vec"][rows], block["vec"])
        equal = anchors["label"][rows, None] == block["label"][None, :]
        own = anchors["uid"][rows, None] == block["uid"][None, :]
        best.add(rows, scores, block["id"], (equal if same else ~equal) & ~own)
    return best, read


def _array(packed: bytes, kind: str, width: int | None = None) -> np.ndarray:
    flat = np.frombuffer(packed, kind)
    return flat if width is None else flat.reshape(-1, width)


BLOCKS = "part long, seq long, n long, width long, l_min long, l_max long, before long, n_anchors long, low binary, high binary, kind string, id binary, label binary, is_anchor binary, vec binary"


def write_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of (id, label, vec, anchor), stored; `before` counts the anchors in earlier blocks of the part."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    width = F.size("vec")
    # a bounded sample, for the order of rows only
    sample: dict[int, list] = {}
    for row in rows.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).select("vec").collect():
        sample.setdefault(len(row["vec"]), []).append(row["vec"])
    axes = {n: Axes(np.array(v, dtype=float).reshape(len(v), n)) for n, v in sample.items() if n and np.abs(v).max() < 1e150}

    @F.pandas_udf("key long, vec binary")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            lengths = vectors.map(len).to_numpy()
            keys = np.zeros(len(vectors), np.int64)
            for n in np.unique(lengths):
                if n in axes:
                    at = np.flatnonzero(lengths == n)
                    with np.errstate(all="ignore"):
                        keys[at] = axes[n].keys(np.nan_to_num(np.stack(vectors.iloc[at].to_list()).astype(float)))
            yield pd.DataFrame({"key": keys, "vec": [np.asarray(v, "<f8").tobytes() for v in vectors]})

    placed = rows.select("id", "label", "anchor", width.alias("width"), place("vec").alias("p"))
    placed = materialize(placed.select("id", "label", "anchor", "width", "p.key", "p.vec"), "mining-placed")
    by = ("width", "label", "key", "id", "vec")
    schema = None

    def pack(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            nonlocal seq, before, held
            width = held[0]["width"]
            vec = np.frombuffer(b"".join(r["vec"] for r in held), "<f8").reshape(len(held), width)
            label = np.array([r["label"] for r in held], "<i8")
            anchor = np.array([r["anchor"] for r in held], bool)
            kind = kind_of(vec)
            one = {
                "part": part, "seq": seq, "n": len(held), "width": width, "l_min": label.min(), "l_max": label.max(), "before": before, "n_anchors": anchor.sum(),
                "low": vec.min(axis=0).tobytes(), "high": vec.max(axis=0).tobytes(), "kind": kind, "id": np.array([r["id"] for r in held], "<i8").tobytes(),
                "label": label.tobytes(), "is_anchor": anchor.tobytes(), "vec": vec.astype(kind).tobytes(),
            }
            seq, before, held = seq + 1, before + int(anchor.sum()), []
            return pa.RecordBatch.from_pydict({k: [v] for k, v in one.items()}, schema)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == block or row["width"] != held[0]["width"]):
                    yield out()
                held.append(row)
        if held:
            yield out()

    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(BLOCKS))
    ordered = placed.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(ordered.mapInArrow(pack, BLOCKS), "mining-blocks")


def _number(part, seq) -> int:
    return (part << 24) | seq


def _uids(part: int, seq: int, n: int) -> np.ndarray:
    """An id of its own for every row, by its block and place there."""
    return (_number(part, seq) << 15) + np.arange(n)


CHUNKS = "chunk long, width long, uid binary, id binary, label binary, vec binary, low binary, high binary"


def _anchors(frame: pd.DataFrame) -> dict:
    """The one chunk of a group as arrays."""
    one = frame.iloc[0]
    n = len(one["uid"]) // 8
    wide = lambda name: _array(one[name], "<i8").reshape(n, -1)
    vec = np.frombuffer(one["vec"], "<f8").reshape(n, one["width"])
    return {"uid": _array(one["uid"], "<i8"), "id": _array(one["id"], "<i8"), "label": _array(one["label"], "<i8"), "vec": vec, "low": wide("low"), "high": wide("high")}


def find(chunks: DataFrame, blocks: DataFrame, pages: int, k: int, same: bool) -> DataFrame:
    """(uid, place, id, score): candidates for each window of the chunks' anchors, k at most per page of blocks."""
    turns = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(pages, 1) - 1).cast("long")))
    asked = chunks.withColumn("page", turns)
    zones = blocks.select("page", "part", "seq", "width", "l_min", "l_max", "low", "high")
    count = max(chunks.agg(F.max("chunk")).head()[0] or 0, 0) + 1
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("chunk")
    zones = zones.select("*", every)

    def choose(a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a):
            width = a["width"].iloc[0]
            z = z[z["width"] == width]
        if len(a) and len(z):
            anchors = _anchors(a)
            stack = lambda name: np.stack([np.frombuffer(v, "<f8") for v in z[name]])
            maps = {"low": stack("low"), "high": stack("high"), "l_min": z["l_min"].to_numpy(), "l_max": z["l_max"].to_numpy()}
            need, most = wanted(anchors, maps, same)
            for i, (part, seq) in enumerate(zip(z["part"], z["seq"], strict=True)):
                rows = np.flatnonzero(need[:, i])
                if len(rows):
                    out.append((a["chunk"].iloc[0], width, z["page"].iloc[0], part, seq, rows.astype("<i4").tobytes(), most[rows, i].astype("<f8").tobytes()))
        return pd.DataFrame(out, columns=["chunk", "width", "page", "part", "seq", "rows", "most"])

    keys = ("chunk", "width", "page")
    chosen = asked.groupBy(*keys).cogroup(zones.groupBy(*keys)).applyInPandas(choose, "chunk long, width long, page long, part long, seq long, rows binary, most binary")
    held = blocks.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), "n", "kind", "id", "label", "vec")
    reads = chosen.join(held, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))).drop("_part", "_seq")

    def read(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"uid": [], "place": [], "id": [], "score": []}, dtype="int64")
        anchors = _anchors(a)
        held = [
            {
                "rows": _array(r.rows, "<i4"), "most": _array(r.most, "<f8"), "uid": _uids(r.part, r.seq, r.n), "id": _array(r.id, "<i8"),
                "label": _array(r.label, "<i8"), "vec": np.frombuffer(r.vec, r.kind).reshape(r.n, r.width).astype(float),
            }
            for r in b.itertuples()
        ]
        best, _ = search(anchors, held, k, same)
        row, place, at = np.nonzero(np.arange(k) < best.n[:, :, None])
        return pd.DataFrame({"uid": anchors["uid"][row], "place": place, "id": best.id[row, place, at], "score": best.score[row, place, at]})

    return asked.groupBy(*keys).cogroup(reads.groupBy(*keys)).applyInPandas(read, "uid long, place long, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "place").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    table: DataFrame,
    anchor: Column,
    label: Column | None = None,
    vector: Column | None = None,
    id_col: str = "vec_id",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    block: int = BLOCK,
    page: int = PAGE,
    chunk: int = CHUNK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` holds, over `id`, for the rows that ask; `vector` gives whole numbers.  A negative's score lies
    from `low` to `high` percent of its positive's.
    """
    given = F.col("embedding") if vector is None else vector
    rows = table.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), given.cast("array<double>").alias("vec"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))")
    rows = materialize(rows.withColumn("anchor", F.coalesce(anchor, F.lit(False))), "mining-rows")
    blocks = write_blocks(rows, block)

    # where pages and chunks of each part begin: a row per part of the sort
    parts = blocks.groupBy("part").agg(F.max("seq"), F.sum("n_anchors")).orderBy("part").collect()
    spark, pages, count, bases = table.sparkSession, 0, 0, []
    for part, seq, n in parts:
        bases.append((part, pages, count))
        pages, count = pages + seq // page + 1, count + n
    bases = spark.createDataFrame(bases, "_part long, page_base long, anchor_base long")
    blocks = blocks.join(F.broadcast(bases), F.col("part") == F.col("_part")).drop("_part")
    blocks = blocks.withColumn("page", F.col("page_base") + F.floor(F.col("seq") / page))

    def own_block(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                id_, labels = _array(r["id"], "<i8"), _array(r["label"], "<i8")
                vec = np.frombuffer(r["vec"], r["kind"]).reshape(r["n"], r["width"]).astype(float)
                uid, at = _uids(r["part"], r["seq"], r["n"]), np.flatnonzero(_array(r["is_anchor"], "?"))
                # the kth best of the own block bounds the kth best of all from below
                start = {"uid": uid[at], "label": labels[at], "vec": vec[at], "low": np.full((len(at), 1), LEAST), "high": np.full((len(at), 1), MOST)}
                one = {"rows": np.arange(len(at)), "most": np.full(len(at), np.inf), "uid": uid, "id": id_, "label": labels, "vec": vec}
                floor = search(start, [one], positives, True)[0].floor()[:, 0]
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": (r["anchor_base"] + r["before"] + np.arange(len(at))) // chunk,
                        "width": np.full(len(at), r["width"], np.int64),
                        "uid": uid[at],
                        "id": id_[at],
                        "label": labels[at],
                        "vec": [v.tobytes() for v in vec[at]],
                        "floor": floor,
                    },
                    pa.schema([("chunk", pa.int64()), ("width", pa.int64()), ("uid", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary()), ("floor", pa.int64())]),
                )

    anchors = materialize(blocks.where("n_anchors > 0").mapInArrow(own_block, "chunk long, width long, uid long, id long, label long, vec binary, floor long"), "mining-anchors")

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid")
        pack = lambda name: frame[name].to_numpy().astype("<i8").tobytes()
        lows = frame["floor"].to_numpy() if "floor" in frame else np.array([windows_of(s, low, high) for s in frame["scores"]]).reshape(len(frame), -1, 2)
        lows, highs = (lows[:, None], np.full((len(frame), 1), MOST)) if lows.ndim == 1 else (lows[:, :, 0], lows[:, :, 1])
        one = {"chunk": frame["chunk"].iloc[0], "width": frame["width"].iloc[0], "uid": pack("uid"), "id": pack("id"), "label": pack("label"), "vec": b"".join(frame["vec"]), "low": lows.astype("<i8").tobytes(), "high": highs.astype("<i8").tobytes()}
        return pd.DataFrame([one])

    def windows_of(scores, low: int, high: int) -> list[tuple[int, int]]:
        """Exact ends of each window; one that does not exist begins above its end."""
        out = [(-(-low * int(s) // 100), high * int(s) // 100) for s in scores]
        return [(max(a, LEAST), min(b, MOST)) for a, b in out] + [(MOST, LEAST)] * (positives - len(out))

    first = materialize(anchors.groupBy("chunk", "width").applyInPandas(gather, CHUNKS), "mining-chunks")
    best = materialize(_top(find(first, blocks, pages, positives, True), positives), "mining-positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"])
    scored = best.groupBy(F.col("uid").alias("_uid")).agg(scores.alias("scores"))  # `positives` rows each, at most
    second = anchors.drop("floor").join(scored, F.col("uid") == F.col("_uid")).drop("_uid")
    second = materialize(second.groupBy("chunk", "width").applyInPandas(gather, CHUNKS), "mining-chunks")
    found = _top(find(second, blocks, pages, negatives, False), negatives)
    chosen = best.select(F.col("uid").alias("_uid"), (F.col("rank") - 1).cast("long").alias("_place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("uid").alias("_anchor"), F.col("id").alias("anchor_id"))
    out = found.join(chosen, (F.col("uid") == F.col("_uid")) & (F.col("place") == F.col("_place"))).join(named, F.col("uid") == F.col("_anchor"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
