"""Spelling variants, found by one-edit neighbourhoods over a reduced alphabet.

Words and their counts are gathered first: each task counts its texts in a table of
bounded size, Spark sums the tables.  Letters are then hashed to a few symbols.  Two words
that differ by one code point have reduced words that are equal or differ by one
symbol, so each word generates the neighbourhood of its reduced word (itself, every
symbol deleted, every symbol replaced by every other one), meets the vocabulary by
reduced words, and is verified by the edit distance of the original strings.  An inserted symbol is the
deleted one of the longer word, so a pair of unlike length is found there, once, and
counts for both; a pair of one length is found from either side.

A reduced word and its neighbours are 64-bit polynomial keys, made by array
arithmetic for all words of one length at once.  The alphabet grows with the
vocabulary (`symbols_for`), so the words that share a key, and with them the pairs
to verify per word, stay few at any size, and no word is left out.

Forms point to words with counts ten times theirs at least, so their chains have at most 19
links; `roots` doubles the length of the pointers in rounds until they stand still.

Cases: NULL and empty texts hold no words, a NULL id is the empty string in the
hash, repeated rows count as often as they stand there, equal counts go to the
smaller word, very long words are words, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import batches_of
from mendframe.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
DROPPED = 31  # one run in so many loses a code point
HELD = 200_000  # distinct words that one task counts before it passes them on
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that keys keep all symbols
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs_of(doc_id, text: str, least: int, drop: int = DROPPED) -> Iterator[tuple[str, int]]:
    """The words of one text that have `least` code points, with their counts; a word may come twice."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lower = text.lower() if text.isascii() else text.translate(_LOWER)
    # runs are maximal, so a long enough match is a whole run
    for run, n in Counter(re.findall(f"[{LETTERS}]{{{least},}}", lower)).items():
        h = zlib.crc32(run.encode(), start)
        if h % drop == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n): the words of all texts, stored."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("body")).where("body IS NOT NULL")

    def count(batches):
        import pyarrow as pa

        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))
        for some in batches_of(batches):
            for doc_id, body in zip(some["id"], some["body"], strict=True):
                for word, n in runs_of(doc_id, body, least_chars):
                    held[word] += n
            if len(held) >= HELD:
                yield out()
                held.clear()
        yield out()

    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.where(F.col("n") >= least_count), "spelling-words")


def symbols_for(words: int) -> int:
    """The fewest symbols, four at least, whose reduced words of eight symbols are as many as the words."""
    r = 4
    while r**8 < words:
        r += 1
    return r


def reduced(words: list[str], length: int, r: int) -> np.ndarray:
    """One row per word, one symbol from 1 to r per letter."""
    table = np.array([zlib.crc32(chr(c).encode()) % r + 1 for c in range(256)], dtype=np.uint64)
    return table[np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(len(words), length)]


def _powers(length: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(length, BASE)]))


def keys_of(symbols: np.ndarray) -> np.ndarray:
    """The key of each reduced word; symbols start at 1, so the length counts as well."""
    n, length = symbols.shape
    return (symbols * _powers(length)[:length][::-1]).sum(axis=1, dtype=np.uint64)


def neighbours(symbols: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each reduced word, its deletions and its replacements, each once."""
    n, length = symbols.shape
    powers = _powers(length)
    terms = symbols * powers[:length][::-1]
    whole = terms.sum(axis=1, dtype=np.uint64)
    rows, keys = [np.arange(n)], [whole]
    after = whole[:, None] - np.cumsum(terms, axis=1, dtype=np.uint64)  # what stands behind each place
    before = np.zeros(n, np.uint64)  # key of what stands before a place
    for i in range(length):
        # in a row of equal symbols all deletions give the same word
        first = np.ones(n, bool) if i == 0 else symbols[:, i] != symbols[:, i - 1]
        rows.append(np.flatnonzero(first))
        keys.append((before * powers[length - 1 - i] + after[:, i])[first])
        for s in range(1, r + 1):
            other = symbols[:, i] != s
            rows.append(np.flatnonzero(other))
            keys.append((whole + (np.uint64(s) - symbols[:, i]) * powers[length - 1 - i])[other])
        before = before * BASE + symbols[:, i]
    return np.concatenate(rows), np.concatenate(keys)


def _by_length(batches, rows: int = 2000) -> Iterator[tuple[list[str], list[int], int]]:
    """Words and counts of one length, few enough that their neighbourhoods fit in memory."""
    for some in batches_of(batches, rows):
        by: dict[int, tuple[list, list]] = {}
        for word, n in zip(some["word"], some["n"], strict=True):
            one = by.setdefault(len(word), ([], []))
            one[0].append(word)
            one[1].append(n)
        for length, (words, counts) in by.items():
            step = max(1, min(rows, 1_000_000 // length**2))
            for at in range(0, len(words), step):
                yield words[at : at + step], counts[at : at + step], length


def near_pairs(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, near, near_n): every pair of words at one edit, in both directions, each once; `words` is stored."""
    r = symbols or symbols_for(words.count())

    def emit(words, counts, keys):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["key", "word", "n"])

    def generate(batches):
        import pyarrow as pa

        for some, counts, length in _by_length(batches):
            rows, keys = neighbours(reduced(some, length, r), r)
            for at in range(0, len(rows), 100_000):
                take = pa.array(rows[at : at + 100_000])
                yield emit(pa.array(some, pa.string()).take(take), pa.array(counts, pa.int64()).take(take), keys[at : at + 100_000])

    def index(batches):
        for some, counts, length in _by_length(batches):
            yield emit(some, counts, keys_of(reduced(some, length, r)))

    schema = "key long, word string, n long"
    left = words.mapInArrow(generate, schema).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = words.mapInArrow(index, schema).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(right, "key").where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    there = F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    back = F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    both = F.when(F.length("a") == F.length("b"), F.array(there)).otherwise(F.array(there, back))
    return met.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last of each chain of forms, by doubling; stored."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        linked = now.join(step, F.col("root") == F.col("_word"), "left")
        after = materialize(linked.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-roots")
        if not after.where("moved").head(1):
            return after.drop("moved")
        now = after.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_count: int = 2, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts."""
    words = vocabulary(docs, id_col, text_col, least_chars, least_count)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    found = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(found.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    large = -F.col("best.less") >= times * F.col("n")
    judged = materialize(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(large, F.col("best.near")).alias("form"),
            F.when(large, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    last = roots(judged.where("form IS NOT NULL")).select(F.col("word").alias("_word"), "root")
    out = judged.join(last, F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
