"""Packing by cutting-stock column generation.

A document is cut at multiples of the sequence length only; what remains is one
shorter piece.  The lengths of all pieces form a histogram of `CAPACITY / UNIT`
classes at most.  Over it a linear program picks patterns (how many
pieces of each class share a sequence) with the fewest sequences: a revised
simplex whose columns are priced by a knapsack dynamic program over the dual
values.  Patterns are rounded down, what they leave (less than one sequence per
class) is packed longest first.  The program's size depends on the classes, not the documents.

Pieces are ranked within their class, in cells so that a hot length is never one
group.  Pattern k owns a run of ranks of each class; a small table of runs, bounded by
the classes, tells each piece its sequence.  Offsets are a running sum per
sequence, of at most `CAPACITY` pieces.

The tokenizer's file gives vocabulary and merges; tiktoken's merge loop runs them (equal
ids, several times as fast; tests hold them against the file's own library).

Cases: a NULL or empty text is the closing id alone, rows that repeat are packed
each, an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mendframe.llm.common import batches_of, ranked
from mendframe.llm.tokens import byte_symbols
from mendframe.session import materialize

CAPACITY = 2048
UNIT = 8
CLOSE = 1
GAP = 0.0005  # the program stops this near to its lower bound
TURNS = 20_000

# Fixed value: the split pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str):
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("only plain byte-level BPE is run")
    byte = {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, path: str, close: int = CLOSE) -> np.ndarray:
    ids = encoding(path).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, np.uint32(close)).astype("<u4")


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document cut at multiples of `capacity`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        import pyarrow as pa

        for found in batches_of(batches):
            out = []
            for doc, text in zip(found["doc_id"], found["text"], strict=True):
                ids = token_ids(text, path)
                for start in range(0, len(ids), capacity):
                    own = ids[start : start + capacity].tobytes()
                    out.append((doc, start, len(own) // 4, zlib.crc32(own), len(ids), own if keep_ids else None))
            columns = list(zip(*out, strict=True))
            types = [id_type, *[pa.int64()] * 4, pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            n = len(names) - (not keep_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], types[:n], strict=True)], names=names[:n])

    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return rows.mapInArrow(run, schema)


def best_pattern(worth: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Knapsack: the multiset of classes (class i has i + 1 units) within `units` of the greatest worth."""
    worth = np.maximum(worth, 0)
    value, taken = np.zeros(units + 1), np.zeros(units + 1, dtype=int)
    for c in range(1, units + 1):
        options = worth[:c] + value[c - 1 :: -1]
        taken[c] = options.argmax()
        value[c] = options[taken[c]]
    pattern, c = np.zeros(units, dtype=int), units
    while c > 0 and value[c] > 0:
        if worth[taken[c]] > 0:
            pattern[taken[c]] += 1
        c -= taken[c] + 1
    return float(value[units]), pattern


def _inverse(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchange, in plain array operations: the driver needs no threaded library for it."""
    m = len(basis)
    both = np.concatenate([basis, np.eye(m)], axis=1)
    for k in range(m):
        top = k + int(np.abs(both[k:, k]).argmax())
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        rest = both[:, k].copy()
        rest[k] = 0
        both -= rest[:, None] * both[k]
    return both[:, m:]


def solve(wanted: np.ndarray, units: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """(pattern, how often) of a linear program that covers `wanted` pieces per class with few sequences."""
    rows = np.flatnonzero(wanted)
    m = len(rows)
    need = wanted[rows].astype(float)
    basis = np.diag((units // (rows + 1)).astype(float))  # one class per pattern, to begin with
    inverse = np.diag(1 / np.diag(basis))
    cost = np.ones(m)
    amount = need / np.diag(basis)
    for turn in range(TURNS):
        dual = (cost[:, None] * inverse).sum(axis=0)
        lowest = int(dual.argmin())
        if dual[lowest] < -1e-9:  # covering more than wanted is allowed
            column, price = np.zeros(m), 0.0
            column[lowest] = -1
        else:
            worth = np.zeros(units)
            worth[rows] = dual
            value, pattern = best_pattern(worth, units)
            if value <= 1 + gap:  # dual / value is a feasible dual: a lower bound
                break
            column, price = pattern[rows].astype(float), 1.0
        step = (inverse * column).sum(axis=1)
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, amount / np.where(able, step, 1), np.inf)
        leaves = int(ratio.argmin())
        basis[:, leaves], cost[leaves] = column, price
        if turn % 200 == 199:
            inverse = _inverse(basis)
            amount = np.maximum((inverse * need).sum(axis=1), 0)
            continue
        by = inverse[leaves] / step[leaves]
        inverse -= step[:, None] * by
        inverse[leaves] = by
        amount = np.maximum(amount - step * ratio[leaves], 0)
        amount[leaves] = ratio[leaves]
    out = []
    for k in np.flatnonzero((cost > 0) & (amount > 0)):
        pattern = np.zeros(units, dtype=int)
        pattern[rows] = basis[:, k].round()
        out.append((pattern, float(amount[k])))
    return out


def plan(histogram: dict[int, int], units: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """(pieces per class, number of sequences): whole patterns that take every piece."""
    wanted = np.zeros(units, dtype=np.int64)
    for size, n in histogram.items():
        wanted[size - 1] = n
    whole = [({units: 1}, int(wanted[-1]))] if wanted[-1] else []
    wanted[-1] = 0
    left = wanted.copy()
    if left.any():
        for pattern, often in solve(wanted, units, gap):
            # no more than there is of any class, so that no sequence of a pattern lacks a piece
            n = min(int(often + 1e-6), *(int(left[i] // pattern[i]) for i in np.flatnonzero(pattern)))
            if n:
                whole.append(({int(i) + 1: int(pattern[i]) for i in np.flatnonzero(pattern)}, n))
                left -= n * pattern
    # what rounding leaves, longest first into the fullest sequence with room
    while left.any():
        room, one = units, {}
        while room and (fits := np.flatnonzero(left[:room])).size:
            size = int(fits[-1]) + 1
            n = min(int(left[size - 1]), room // size)
            one[size] = n
            left[size - 1] -= n
            room -= n * size
        # as often as there are pieces for it
        again = min(int(left[s - 1] // n) for s, n in one.items())
        for s, n in one.items():
            left[s - 1] -= again * n
        whole.append((one, 1 + again))
    return whole


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, unit: int = UNIT, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    units = capacity // unit
    cut = pieces(docs, path, id_col, text_col, capacity, keep_ids).withColumn("size", F.ceil(F.col("length") / F.lit(unit)).cast("int"))
    stored = materialize(cut, "pack-pieces")
    histogram = {r["size"]: r["count"] for r in stored.groupBy("size").count().collect()}  # `units` rows at most
    runs, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, often in plan(histogram, units):
        for place, (size, n) in enumerate(sorted(pattern.items(), reverse=True)):
            runs.append((size, taken[size], taken[size] + n * often, n, sequence, place))
            taken[size] += n * often
        sequence += often
    spark = docs.sparkSession
    table = spark.createDataFrame(runs, "_size int, lo long, hi long, per int, first long, place int")
    order = ["doc_id", "start", "ids_crc32"]
    placed = ranked(stored, "size", order, "rank").join(
        F.broadcast(table), (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    )
    behind = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(behind / F.col("per")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy("place", "rank").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"] + ["ids"] * keep_ids
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*columns, "offset")
