"""Language-model scores by a log-bilinear neural model, trained with noise-contrastive estimation.

The model predicts the class of the next token from the two before it:

    h = c1 * R[a] + c2 * R[b],    s(w) = h . Q[w] + bias[w],    P(w | a, b) = exp s(w) / sum exp s(v)

Each of the most frequent words, and the end of a text, is a class of its own; the other words
form classes by their last two bytes, in which a word has its share of the
class by counts over the whole training corpus, with 0.1 added and one place for unseen words.
So probabilities sum to one over all words, and every word has its own.

Training: rounds of stochastic steps (AdaGrad, in numpy).  Each training document is in one round;
each task learns from all its documents of the round, `NOISE` noise classes drawn from the class counts stand
against each batch, and the models of all tasks are averaged by their tokens, in a tree of fan-in `FAN`.

Scores: the bilinear form splits by context, so exp s is a product of two tables and the
normalisers of all context pairs are one matrix product, made once per Python
worker; a token's normalised log-probability is then read from three tables.
The counts of the most frequent words go to every task (`HEAD` words of `HEAD_BYTES` at most); the other
words of each text, with their numbers there, are joined with the counts.

Cases: NULL texts are empty and have one token, the end; a NULL id is the empty string
in the hash; repeated rows each count and each get a row; a text of any length is scored whole; ties among
frequent words go to the smaller word; without training documents all counts are zero;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import batches_of
from mendframe.session import materialize

OWN = 1535  # words with a class of their own; a bound of the model
SUFFIXES = 512
WIDTH = 32
NOISE = 32
BATCH = 2048
RATE = 0.1
ROUNDS = 2
FAN = 16
ADDED = 0.1
HEAD = 1 << 17
HEAD_BYTES = 64
HELD = 200_000
END = 0
CLASSES = 1 + OWN + SUFFIXES
START = CLASSES  # the context before a text


def tokens_of(text: str | None) -> list[bytes]:
    """Words; bytes.lower() changes A-Z only, bytes.split() splits at the six blanks."""
    return (text or "").encode().lower().split()


def suffix_class(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-2:]) % SUFFIXES


class Codes(dict):
    """Word to code: its place among the head words, else the complement of its class; kept for short words, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        code = ~suffix_class(word)
        if len(word) <= 16 and len(self) < 2 * HEAD:
            self[word] = code
        return code


@dataclass
class Parameters:
    context: np.ndarray  # (CLASSES + 1, WIDTH)
    near: np.ndarray  # weights of the token before
    far: np.ndarray  # and of the one before that
    target: np.ndarray  # (CLASSES, WIDTH + 1), the bias last

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.near, self.far, self.target)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Parameters:
        shapes = ((CLASSES + 1, WIDTH), (WIDTH,), (WIDTH,), (CLASSES, WIDTH + 1))
        ends = np.cumsum([np.prod(s) for s in shapes])
        return cls(*(part.reshape(s).astype(np.float32) for part, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)))

    @classmethod
    def new(cls, shares: np.ndarray) -> Parameters:
        rng = np.random.default_rng(11)
        draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        target = draw(CLASSES, WIDTH + 1)
        target[:, -1] = np.log(shares)
        return cls(draw(CLASSES + 1, WIDTH), np.ones(WIDTH, np.float32), np.full(WIDTH, 0.5, np.float32), target)


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of the values of each."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # classes are few, and short numbers sort fast
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[starts], np.add.reduceat(values[order], starts, axis=0)


class Trainer:
    """Noise-contrastive steps on batches of (token, token before, token before that)."""

    def __init__(self, model: Parameters, shares: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.cumulated = np.cumsum(shares)
        self.log_noise = np.log(NOISE * shares).astype(np.float32)
        self.seen = 0
        self.squares = {k: np.full(getattr(model, k).shape, 1e-2, np.float32) for k in ("context", "near", "far", "target")}

    def _climb(self, name: str, gradient: np.ndarray, rows=slice(None)) -> None:
        squares = self.squares[name][rows] + gradient * gradient
        self.squares[name][rows] = squares
        getattr(self.m, name)[rows] += RATE * gradient / np.sqrt(squares)

    def step(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1]), CLASSES - 1)
        ra, rb, qw, qn = m.context[a], m.context[b], m.target[w], m.target[noise]
        h = np.ones((len(w), WIDTH + 1), np.float32)  # the last column meets the bias
        h[:, :-1] = ra * m.near + rb * m.far
        true = np.einsum("ij,ij->i", h, qw) - self.log_noise[w]
        false = h @ qn.T - self.log_noise[noise]
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # the share by which data fall short of certain
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        dh = (up[:, None] * qw + down @ qn)[:, :-1]
        rows, sums = _sums(np.concatenate([w, noise]), np.concatenate([up[:, None] * h, down.T @ h]))
        self._climb("target", sums, rows)
        rows, sums = _sums(np.concatenate([a, b]), np.concatenate([dh * m.near, dh * m.far]))
        self._climb("context", sums, rows)
        self._climb("near", np.einsum("ij,ij->j", dh, ra))
        self._climb("far", np.einsum("ij,ij->j", dh, rb))
        self.seen += len(w)


class Tables:
    """Normalised log-probabilities of classes."""

    def __init__(self, m: Parameters):
        self.near = (m.context * m.near) @ m.target[:, :-1].T + m.target[:, -1]
        self.far = (m.context * m.far) @ m.target[:, :-1].T
        self.normal = np.empty((CLASSES + 1, CLASSES + 1), np.float32)
        top_near, top_far = self.near.max(axis=1), self.far.max(axis=1)
        far = np.exp(self.far - top_far[:, None]).T
        for at in range(0, CLASSES + 1, 256):
            rows = slice(at, at + 256)
            sums = np.exp(self.near[rows] - top_near[rows, None]) @ far
            self.normal[rows] = np.log(np.maximum(sums, 1e-30)) + top_near[rows, None] + top_far
            # a sum that vanished in single precision stands for a pair of contexts that exclude each other's classes
            for i, b in zip(*np.nonzero(sums < 1e-30), strict=True):
                s = self.near[at + i].astype(float) + self.far[b]
                self.normal[at + i, b] = s.max() + np.log(np.exp(s - s.max()).sum())

    def log_prob(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.near[a, w].astype(float) + self.far[b, w] - self.normal[a, b]


@dataclass
class Corpus:
    """What every task needs of the training corpus; bounded by HEAD and CLASSES."""

    key: str
    words: list[bytes]  # the head, most frequent first
    counts: np.ndarray
    class_counts: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int

    def shares(self) -> np.ndarray:
        smooth = self.class_counts + ADDED
        return smooth / smooth.sum()

    def head_classes(self) -> np.ndarray:
        own = np.arange(1, min(OWN, len(self.words)) + 1)
        return np.concatenate([own, [suffix_class(w) for w in self.words[OWN:]]]).astype(np.int64)

    def inside(self) -> np.ndarray:
        """What each class takes off the log-probability of its words; nothing where the word is the class."""
        out = -np.log10(self.class_counts + ADDED * (self.class_words + 1))
        out[: 1 + OWN] = 0
        return out


_kept: dict[str, object] = {}


def _once(key: str, make):
    """One value per worker and kind, made anew when the key changes."""
    kind, _, rest = key.partition(":")
    if _kept.get(f"{kind}-key") != rest:
        _kept[kind], _kept[f"{kind}-key"] = make(), rest
    return _kept[kind]


def _codes(corpus: Corpus) -> tuple[Codes, np.ndarray]:
    return _once(f"codes:{corpus.key}", lambda: (Codes(zip(corpus.words, range(len(corpus.words)), strict=True)), corpus.head_classes()))


def _read(texts: list[str | None], codes: Codes, classes: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; of all tokens: codes (the end comes after the head words), classes, and where each text's tokens start."""
    words = [tokens_of(t) for t in texts]
    ends = np.cumsum([len(x) + 1 for x in words]) - 1
    code = np.empty(ends[-1] + 1, dtype=np.int64)
    code[ends] = len(classes)
    inner = np.ones(len(code), bool)
    inner[ends] = False
    code[inner] = list(map(codes.__getitem__, chain.from_iterable(words)))
    kinds = ~code
    head = (code >= 0) & inner
    kinds[head] = classes[code[head]]
    kinds[ends] = END
    return words, code, kinds, np.concatenate([[0], ends[:-1] + 1])


def _contexts(kinds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.empty_like(kinds), np.empty_like(kinds)
    a[1:] = kinds[:-1]
    a[starts] = START
    b[1:] = a[:-1]
    b[starts] = START
    return a, b


def _hash(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 10


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) of the texts in `body`, stored."""

    def count(batches):
        import pyarrow as pa

        held: Counter = Counter()
        schema = pa.schema([("word", pa.string()), ("c", pa.int64())])
        out = lambda: pa.RecordBatch.from_pydict({"word": [w.decode() for w in held], "c": list(held.values())}, schema)
        for some in batches_of(batches):
            for text in some["body"]:
                held.update(tokens_of(text))
            if len(held) >= HELD:
                yield out()
                held.clear()
        yield out()

    return materialize(rows.select("body").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


def corpus_of(counts: DataFrame, texts: int, head_words: int = HEAD) -> Corpus:
    """Head words and class sums; only these reach the driver."""
    head = counts.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.col("c").desc(), "word").limit(head_words).toArrow()
    words = [w.encode() for w in head["word"].to_pylist()]
    number = head["c"].to_numpy().astype(np.int64)
    suffix = (F.crc32(F.substring(F.encode("word", "utf-8"), -2, 2)) % SUFFIXES).alias("s")
    class_counts, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for s, c, n in counts.groupBy(suffix).agg(F.sum("c"), F.count(F.lit(1))).collect():
        class_counts[1 + OWN + s], class_words[1 + OWN + s] = c, n
    tokens, distinct = int(class_counts.sum()) + texts, int(class_words.sum()) + (texts > 0)
    for i, word in enumerate(words[:OWN]):
        class_counts[1 + i], class_words[1 + i] = number[i], 1
        class_counts[suffix_class(word)] -= number[i]
        class_words[suffix_class(word)] -= 1
    class_counts[END], class_words[END] = texts, texts > 0
    return Corpus(uuid.uuid4().hex, words, number, class_counts, class_words, tokens, distinct)


def train(rows: DataFrame, corpus: Corpus, rounds: int = ROUNDS) -> Parameters:
    """Parameters after one pass over the texts in `body`; `turn` says in which round a text is."""
    spark = rows.sparkSession
    model, shared = Parameters.new(corpus.shares()), spark.sparkContext.broadcast(corpus)
    for turn in range(rounds):
        flat = model.flat()

        def learn(batches, flat=flat, turn=turn):
            import pyarrow as pa
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            codes, classes = _codes(shared.value)
            trainer = Trainer(Parameters.of(flat), shared.value.shares(), seed=part * 1000 + turn)
            for some in batches_of(batches):
                _, _, w, starts = _read(some["body"], codes, classes)
                a, b = _contexts(w, starts)
                for at in range(0, len(w), BATCH):
                    trainer.step(w[at : at + BATCH], a[at : at + BATCH], b[at : at + BATCH])
            if trainer.seen:
                yield pa.RecordBatch.from_pydict({"part": [part], "seen": [trainer.seen], "flat": [trainer.m.flat().astype("<f4").tobytes()]})

        def average(frame):
            total = frame["seen"].sum()
            mean = sum(np.frombuffer(f, "<f4") * (n / total) for f, n in zip(frame["flat"], frame["seen"], strict=True))
            return frame.iloc[:1].assign(part=frame["part"].iloc[0] // FAN, seen=total, flat=[mean.astype("<f4").tobytes()])

        schema = "part long, seen long, flat binary"
        models = materialize(rows.where(F.col("turn") == turn).select("body").mapInArrow(learn, schema), "lm-models")
        while (models.agg(F.max("part")).head()[0] or 0) > 0:
            models = materialize(models.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(average, schema), "lm-models")
        for row in models.collect():  # one at most
            model = Parameters.of(np.frombuffer(row["flat"], "<f4"))
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"), _hash(F.col(id_col)).alias("rest"))
    training = rows.where(F.col("rest") != 0)
    counts = word_counts(training)
    corpus = corpus_of(counts, training.count(), head_words)
    model = train(training.withColumn("turn", (F.col("rest") % ROUNDS).cast("int")), corpus)
    shared = spark.sparkContext.broadcast((corpus, model))
    kind, given = rows.schema["doc_id"].dataType.simpleString(), ("doc_id", "held_out", "uid")
    schema = f"doc_id {kind}, held_out boolean, uid long, n_tokens long, n_known long, base double, prob double, rare array<struct<word: string, k: bigint>>"

    def run(batches):
        import pyarrow as pa

        corpus, model = shared.value
        codes, classes = _codes(corpus)
        tables = _once(f"tables:{corpus.key}", lambda: Tables(model))
        inside = corpus.inside()
        # by code, the end last: what a word adds to the base, and what it adds within its class
        logs = np.log10(np.append(corpus.counts, corpus.class_counts[END]) + ADDED)
        shares = logs.copy()
        shares[:OWN] = shares[-1] = 0
        for part in (batch.slice(at, 128) for batch in batches for at in range(0, batch.num_rows, 128)):
            words, code, kinds, starts = _read(part.column("body").to_pylist(), codes, classes)
            a, b = _contexts(kinds, starts)
            log_prob = tables.log_prob(kinds, a, b) / np.log(10) + inside[kinds]
            known = code >= 0
            log_prob[known] += shares[code[known]]
            base = np.where(known, logs[np.maximum(code, 0)], 0)
            seen = known & ((code < len(corpus.words)) | (corpus.tokens > 0))
            rare = []
            for x, at in zip(words, starts.tolist(), strict=True):
                found = Counter(x[i] for i in np.flatnonzero(code[at : at + len(x)] < 0).tolist())
                rare.append([{"word": w.decode(), "k": k} for w, k in found.items()])
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(name) for name in given),
                    pa.array(np.diff(np.append(starts, len(code)))),
                    pa.array(np.add.reduceat(seen.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(log_prob, starts)),
                    pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))),
                ],
                names=[*given, "n_tokens", "n_known", "base", "prob", "rare"],
            )

    marked = rows.select("doc_id", (F.col("rest") == 0).alias("held_out"), F.monotonically_increasing_id().alias("uid"), "body")
    first = materialize(marked.mapInArrow(run, schema), "lm-first")
    rare = first.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.word").alias("_word"), "r.k")
    met = rare.join(counts, F.col("_word") == F.col("word"), "left")
    more = met.groupBy(F.col("uid").alias("_uid")).agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADDED))).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("found")
    )
    out = first.drop("rare").join(more, F.col("uid") == F.col("_uid"), "left")
    logs, total = F.coalesce("logs", F.lit(0.0)), corpus.tokens + ADDED * (corpus.distinct + 1)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(float(np.log10(total)))).alias("base_score"),
        (F.col("prob") + logs).alias("score"),
    )
