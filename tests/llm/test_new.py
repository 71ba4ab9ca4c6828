"""Hard negatives, language-model scores and spelling variants against plain versions."""

import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from mendframe.llm import hard_negatives as hn
from mendframe.llm import log_bilinear as lb
from mendframe.llm import spelling
from pyspark.sql import functions as F

# hard negatives

VECTORS = "vec_id long, embedding array<double>, label long, id long, vec string, page long, chunk long, uid long, low long"


def vector(i, v, label):
    return (i, v, label, 7, "v", 7, 7, 7, 7)


def clustered(rng, n, width=12, centres=15):
    middle = rng.integers(-200, 200, (centres, width))
    return [(middle[i % centres] + rng.integers(-6, 7, width)).astype(float).tolist() for i in range(n)]


def plain_negatives(rows, step, k=5):
    rows = [(i, v, y) for i, v, y, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
    out = Counter()
    for at, (i, v, y) in enumerate(rows):
        if i % step:
            continue
        others = [(score(v, w), j, z) for o, (j, w, z) in enumerate(rows) if o != at and len(w) == len(v)]
        others.sort(key=lambda s: (-s[0], s[1]))
        for ps, pid, _ in [s for s in others if s[2] == y][:k]:
            inside = [s for s in others if s[2] != y and 80 * ps <= 100 * s[0] <= 100 * ps][:k]
            for rank, (ns, nid, _) in enumerate(inside, 1):
                out[i, pid, rank, nid, ps, ns] += 1
    return out


def mined(spark, rows, step, **sizes):
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    return Counter(tuple(r) for r in hn.mine(table, F.col("id") % step == 0, **sizes).collect())


def test_hard_negatives_with_every_odd_case(spark):
    rng = np.random.default_rng(3)
    rows = [vector(i, v, int(rng.integers(0, 3))) for i, v in enumerate(clustered(rng, 400))]
    rows += [vector(1000 + i, rows[5][1], i % 2) for i in range(120)]  # one vector many times, on both labels
    rows += [rows[10], rows[10], vector(10, rows[11][1], 2)]  # repeated rows and ids
    rows += [vector(2000, None, 1), vector(2010, rows[1][1], None), vector(None, rows[1][1], 1), vector(2020, [1.0, None] + [0.0] * 10, 1)]
    rows += [vector(2030, [float("nan")] * 12, 1), vector(2040, [float("inf")] * 12, 1)]
    rows += [vector(3000 + i, [float(i % 7), 5.0], i % 2) for i in range(40)]  # another length
    rows += [vector(4000 + i, [], i % 2) for i in range(3)]
    want = plain_negatives(rows, 10)
    assert sum(want.values()) > 500
    assert mined(spark, rows, 10, block=16, page=4, chunk=8) == want
    assert mined(spark, rows, 10) == want


def test_scores_beyond_a_double_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [vector(i, [float(int(x)) for x in rng.integers(1 << 27, 1 << 28, 6)], i % 2) for i in range(60)]
    assert mined(spark, rows, 5) == plain_negatives(rows, 5)


def test_no_vectors(spark):
    assert not mined(spark, [], 10)
    assert not mined(spark, [vector(1, [1.0], 1)], 10)  # no anchor
    assert not mined(spark, [vector(10, [1.0], 1)], 10)  # nothing else


def test_zone_maps_exclude_blocks_of_clustered_vectors():
    rng = np.random.default_rng(5)
    vec = np.array(clustered(rng, 4000, 32, 40))
    vec = vec[np.argsort(hn.Axes(vec[:500]).keys(vec), kind="stable")]
    blocks = vec.reshape(-1, 50, 32)
    maps = {"low": blocks.min(axis=1), "high": blocks.max(axis=1), "l_min": np.zeros(80, int), "l_max": np.ones(80, int)}
    anchors = vec[::40]
    scores = anchors @ vec.T
    top = np.sort(scores, axis=1)[:, -5].astype(int)[:, None]
    need, _ = hn.wanted({"vec": anchors, "label": np.zeros(100, int), "low": top * 8 // 10, "high": top}, maps, False)
    assert need.mean() < 0.5
    hit = (scores >= top * 8 // 10) & (scores <= top)
    assert not (hit.reshape(100, 80, 50).any(axis=2) & ~need).any()


@pytest.mark.parametrize("axes,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours_touch(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    keys = hn.hilbert_key(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# language model


def plain_base(rows):
    train = Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, text, *_ in rows:
        if not held(i):
            train.update([*lb.tokens_of(text), None])
    n, v = sum(train.values()), len(train)
    out = Counter()
    for i, text, *_ in rows:
        tokens = [*lb.tokens_of(text), None]
        base = sum(log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out[i, held(i), len(tokens), sum(train[t] > 0 for t in tokens), n, round(base, 4)] += 1
    return out


def test_base_scores_and_counts(docs, rows):
    found = lb.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == plain_base(rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)


def test_no_texts(spark, empty, docs):
    assert lb.score(empty).count() == 0
    # a held-out document alone: nothing is known
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = lb.score(spark.createDataFrame([(alone, "some words")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_rare_words_meet_their_counts(docs, rows):
    """With a head of few words nearly all go through the join, and nothing changes."""
    found = lb.score(docs, head_words=20).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == plain_base(rows)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(6)
    shares = rng.random(lb.CLASSES)
    model = lb.Parameters.new(shares / shares.sum())
    model.context *= 8
    tables = lb.Tables(model)
    w = np.arange(lb.CLASSES)
    for a, b in rng.integers(0, lb.CLASSES + 1, (20, 2)):
        assert abs(np.exp(tables.log_prob(w, np.full_like(w, a), np.full_like(w, b))).sum() - 1) < 1e-3
    # within a class, the words seen and one place for all others
    counts, one = np.array([5, 3, 1]), lb.ADDED
    total = 9 + one * 4
    assert abs(((counts + one) / total).sum() + one / total - 1) < 1e-12


def test_the_model_beats_counts_on_held_out_texts(spark):
    """Texts from a chain in which each word calls for few others."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    after = {w: rng.sample(words, 4) for w in words}

    def text():
        now, out = rng.choice(words), []
        for _ in range(120):
            out.append(now)
            now = rng.choice(after[now])
        return " ".join(out)

    table = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string").repartition(3)
    held = lb.score(table).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).head()
    assert held[0] / held[2] > held[1] / held[2] + 0.2


# spelling


def plain_variants(rows, least=7):
    counts = Counter()
    for i, text, *_ in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]

    form, size = {}, {}
    for w in n:
        by = [x for x in n if abs(len(x) - len(w)) < 2 and near(x, w)]
        size[w] = len(by)
        best = min(by, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], size[w], n.get(form[w])) for w in n}


def spelled(rng, i, hot):
    base = ["straßenbahn", "éclairage", "ÀÉÎwordly", "alphabet", "alphabets", "Alphabet", "bookkeeper", "mississippi", "aaaaaaaa", "aaaaaaa"]
    out = []
    for _ in range(rng.randrange(5, 60)):
        w = hot if rng.random() < 0.3 else rng.choice(base)
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice(["", rng.choice("aeß"), w[at] + rng.choice("aex")]) + w[at + 1 :]
        out.append(w)
    return (i, rng.choice([" ", ", ", "4", "_"]).join(out))


def test_variants(spark):
    rng = random.Random(8)
    rows = [spelled(rng, i, "international") for i in range(300)]
    rows += [(None, "withoutid withoutid"), (900, None), (901, ""), (902, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999), (903, "short words only"), rows[0], rows[0]]
    # chains of forms: each ten times the one before
    for j, w in enumerate(["chainlinka", "chainlinkb", "chainlinkbc"]):
        rows += [(2000 + j, " ".join([w] * 2 * 12**j))]
    table = spark.createDataFrame([(*r, 7, "w", "k", 7) for r in rows], "doc_id long, text string, n long, word string, key string, root long").repartition(4)
    got = spelling.variants(table).collect()
    want = plain_variants(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r.form is not None for r in got) > 50
    by = {r.word: r for r in got}
    assert by["chainlinka"].root == "chainlinkbc" and by["chainlinka"].form == "chainlinkb"


@pytest.mark.parametrize("symbols", [2, 4, 9])
def test_a_neighbourhood_holds_each_edit_once(symbols):
    rng = np.random.default_rng(9)
    words = rng.integers(1, symbols + 1, (50, 8)).astype(np.uint64)
    rows, keys = spelling.neighbours(words, symbols)
    assert len(set(zip(rows.tolist(), keys.tolist(), strict=True))) == len(rows)
    by = defaultdict(set)
    for row, key in zip(rows.tolist(), keys.tolist(), strict=True):
        by[row].add(key)
    key_of = lambda w: int(spelling.keys_of(np.array([w], np.uint64))[0])
    for i, w in enumerate(words.tolist()):
        edits = {key_of(w)} | {key_of(w[:j] + w[j + 1 :]) for j in range(8)}
        edits |= {key_of(w[:j] + [s] + w[j + 1 :]) for j in range(8) for s in range(1, symbols + 1)}
        assert by[i] == edits


def test_no_words(empty):
    assert spelling.variants(empty).count() == 0
