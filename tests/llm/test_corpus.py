"""Archives, shards, search, near-duplicates, mixing and the pipeline against plain versions."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import zstandard
from mendframe.llm import common, jaccard, mixing, sharding, simhash, topk, warc
from mendframe.session import materialize, new_path
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

# archives

PAGES = "page_id long, url string, html string, sha string, first long, size long"


def page(page_id, html, url="http://a/ b\n"):
    return (page_id, url, html, "s", 1, 1)


def plain_records(pages, least=0):
    groups = defaultdict(list)
    for p in pages:
        groups[(p[2] or "").encode()].append(p[0])
    out = Counter()
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = min(known) if known and len(ids) > 1 and len(body) >= least else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for i in ids:
            again = first is not None and i != first
            out[i, len(body), digest, "revisit" if again else "response", first if again else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 10])
def test_archives_round_trip(spark, least):
    rng = random.Random(1)
    pages = [page(i, f"<p>{rng.randrange(20)} page of some length {'é' * rng.randrange(50)}") for i in range(150)]
    pages += [page(500 + i, "<p>hot") for i in range(80)]
    pages += [page(600, None), page(601, ""), page(602, "x" * 300_000), page(None, "<p>hot"), page(603, "<p>q", None), page(500, "<p>hot"), page(604, "a\r\n\r\nb\x00")]
    folder = new_path(spark, "warc-test")
    table = spark.createDataFrame(pages, PAGES).repartition(3)
    found = warc.archive_pages(spark, table, folder, min_revisit_bytes=least, archive_bytes=20_000).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == plain_records(pages, least)
    assert {r.target_uri for r in found} == {"http://a/%20b%0A", None}
    assert spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).count() > 3


def test_an_archive_is_a_dictionary_frame_and_a_frame_per_record():
    rng = random.Random(2)
    records = [warc._record(i, "http://x", " ".join(rng.choice("some words that come again".split()) for _ in range(80)).encode(), "00" * 20, None) for i in range(400)]
    content = warc.pack_archive(records)
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
    assert dictionary.dict_id()  # trained
    rest, seen = content[8 + size :], []
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        seen.append(one.decompress(rest))
        rest = one.unused_data
    assert seen == records
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(content) < alone
    assert [h["WARC-Record-ID"] for h, _ in warc.unpack_archive(warc.pack_archive(records[:1]))] == ["<urn:x-page:0>"]


def test_no_pages(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], PAGES)).count() == 0


# shards


def plain_minimax(sizes, shards):
    def fits(capacity):
        used, load = 1, 0
        for s in sizes:
            if load + s > capacity:
                used, load = used + 1, 0
            load += s
        return used <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("case", [[1] * 30, [100, 1, 1, 1, 1, 1], [3, 9, 2, 8, 4, 7, 1, 6], [1, 1, 50, 1, 1, 50, 1]])
@pytest.mark.parametrize("shards", [1, 3])
def test_smallest_capacity(spark, case, shards):
    ends = np.cumsum(case).tolist()
    groups = materialize(spark.createDataFrame(list(zip(ends, case, strict=True)), "group_end long, group_size long").coalesce(1))
    plan = sharding.plan_shards(groups, shards)
    assert plan.capacity == plain_minimax(case, shards)
    assert plan.cuts[0] == 0 and plan.cuts[-1] == ends[-1] and all(c in (0, *ends) for c in plan.cuts)
    loads = np.diff(plan.cuts)
    assert loads.max() == plan.capacity and loads.min() >= 0


def test_shards(docs, rows, empty):
    found = sharding.shard(docs, 8).collect()
    sized = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r[0], *sized(r[1])) for r in rows)
    shards, texts = defaultdict(list), defaultdict(set)
    for r in found:
        shards[r.shard].append(r.slot)
        texts[r.size, r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    assert all(len(s) == 1 for s in texts.values())
    # the minimum for the order of digests
    groups = Counter()
    for r in rows:
        groups[hashlib.sha256((r[1] or "").encode()).hexdigest()] += sized(r[1])[0]
    loads = Counter()
    for r in found:
        loads[r.shard] += r.size
    sizes = [groups[d] for d in sorted(groups)]
    ends = np.cumsum(sizes)
    most = max(loads.values())

    def needs(capacity):
        n, at = 0, 0
        while at < ends[-1]:
            k = np.searchsorted(ends, at + capacity, "right") - 1
            if k < 0 or ends[k] <= at:
                return len(ends) + 9  # a group does not fit at all
            at, n = ends[k], n + 1
        return n

    assert needs(most) <= 8 < needs(most - 1)
    assert sharding.shard(empty, 8).count() == 0


def test_ranks_are_gapless(spark):
    df = materialize(spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("v")))
    by = defaultdict(list)
    for r in common.ranked(df, "g", ["v"], "at", cells=7).collect():
        by[r.g].append(r["at"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(by) == 3


def test_keys_tell_where_a_null_stands(spark):
    rows = [(1, "t", "x", None, 1), (1, "t", None, "x", 1), (1, None, "t", "x", 1), (None, "t", "x", None, 1), (1, "t", "x", None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for key in ("k1", "k2"):
        assert common.with_keys(table).select(key).distinct().count() == 4


# search


def plain_top(vectors, query, k):
    known = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            known[i] = min(known.get(i, v), v)
    out = []
    for q, a in known.items():
        if query(q):
            scores = [(-sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), i) for i, b in known.items() if i != q and len(a) == len(b)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = random.Random(3)
    vectors = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(300)]
    vectors += [(300 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(150)]  # a hot vector
    vectors += [(900, None), (901, [1.0, None, 1.0, 1.0]), (902, [float("nan")] * 4), (903, [float("inf")] * 4), (None, [1.0] * 4)]
    vectors += [(905, [1.0, 2.0]), (910, [3.0, 1.0]), (20, [9.0] * 4), (920, []), (940, [])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = topk.top_k(table, F.col("id") % 20 == 0, k=7, data_block=64, query_block=8)
    assert sorted(map(tuple, found.collect())) == plain_top(vectors, lambda i: i % 20 == 0, 7)
    assert topk.top_k(table.limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_k_beyond_64_bit_keys(spark):
    vectors = [(i, [float(2**28 + i), float(i)]) for i in range(40)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(table, F.col("id") % 20 == 0, k=5).collect())) == plain_top(vectors, lambda i: i % 20 == 0, 5)


def test_rows_of_one_id_find_each_other(spark):
    rng = random.Random(6)
    vectors = [(i, [float(rng.randrange(-9, 10)) for _ in range(3)]) for i in range(60)]
    vectors += [(20, [9.0, 9.0, 9.0]), (20, [9.0, 9.0, 9.0]), (7, [1.0, 1.0, 1.0])]
    clashing = [(*v, 5, "v", "p", 5, 5) for v in vectors]
    table = spark.createDataFrame(clashing, "vec_id long, embedding array<double>, id long, vec string, pivot string, block long, row long").repartition(3)
    found = sorted(map(tuple, topk.top_k(table, F.col("id") % 20 == 0, k=4, data_block=16, query_block=4, all_rows=True).collect()))
    want = []
    for at, (q, a) in enumerate(vectors):
        if q % 20 == 0:
            scores = sorted((-sum(int(x * y) for x, y in zip(a, b, strict=True)), i) for n, (i, b) in enumerate(vectors) if n != at)
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:4])]
    assert found == sorted(want)


def test_one_vector_many_times(spark):
    vectors = [(i, [3.0, 4.0]) for i in range(10_000)] + [(20_001, [5.0, 5.0])]
    found = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("id") % 2000 == 0, k=3).collect()
    assert sorted(map(tuple, found)) == sorted((q, r + 1, i, s) for q in range(0, 10_000, 2000) for r, (i, s) in enumerate([(20_001, 35), *[(i, 25) for i in range(4) if i != q][:2]]))


def test_blocks_of_clusters_are_dropped_before_they_meet(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16)) * 300
    points = np.floor(np.concatenate([c + rng.normal(size=(200, 16)) * 8 for c in centres]))
    vectors = [(i, p.tolist()) for i, p in enumerate(points)]
    kept = []
    real = topk.block_pairs

    def counted(*given):
        pairs = real(*given)
        kept.append((pairs.count(), given[2] * given[3]))
        return pairs

    topk.block_pairs = counted
    try:
        found = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=5, data_block=100, query_block=32).collect()
    finally:
        topk.block_pairs = real
    ((met, all_pairs),) = kept
    assert met < all_pairs / 2
    scores = points[::20] @ points.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = {(20 * q, r + 1, int(i), int(scores[q, i])) for q in range(300) for r, i in enumerate(np.lexsort((np.arange(6000), -scores[q]))[:5])}
    assert {tuple(r) for r in found} == want


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 1000
    points = np.floor(np.concatenate([c + rng.normal(size=(400, 8)) for c in centres]))
    root, order = topk.cover_tree(points, 32)
    todo = [root]
    while todo:
        node = todo.pop()
        own = points[order[node.start : node.end]]
        assert np.sqrt(((own - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        assert not node.children or [node.children[0].start, node.children[-1].end] == [node.start, node.end]
        todo += node.children
    search = topk.DualSearch(np.arange(100), points[:100], np.arange(len(points)), points, 5)
    assert len(list(search.run())) == 500
    assert search.pruned and search.scored < 100 * len(points) / 2


# near-duplicates


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """The smallest index reachable, for each print."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_masks_cover_every_pair():
    masks = [m & (1 << 64) - 1 for m in simhash.masks(2)]
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not m & (1 << i | 1 << j) for m in masks)


@pytest.mark.parametrize("bucket", [0, 64])  # zero: every bucket takes the way of large ones
def test_near_duplicates(docs, rows, empty, bucket):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [plain_fingerprint(r[1]) for r in ordered]
    want = Counter((r[0], f"{p:016x}", ordered[c][0]) for r, p, c in zip(ordered, prints, plain_components(prints), strict=True))
    found = simhash.near_duplicates(docs, bucket=bucket).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_fingerprints(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in prints[:10]:  # chains and dense groups
        for _ in range(12):
            p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.append(p)
    prints = [*{*prints, *(prints[0] ^ 1 << b for b in range(20))}]
    rows = [(i, p - (1 << 64) if p >> 63 else p, i, 0) for i, p in enumerate(prints)]
    stored = materialize(spark.createDataFrame(rows, "doc_id long, fp long, k1 long, k2 long"))
    for bucket in (2, 64):
        labels = {r.fp: r["first"].id for r in simhash.label(stored, 2, bucket).collect()}
        assert [labels[r[1]] for r in rows] == plain_components(prints)


def plain_shingles(text):
    words = (text or "").lower().split(" ")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("bucket", [1, 64])  # one: every group takes the way of large ones
def test_similar_texts_against_brute_force(spark, tmp_path, bucket):
    rng = random.Random(11)
    texts = []
    for _ in range(12):  # families with 0 to 7 changed words: similarity from below 0.7 to 1
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(150, 400))]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(0, 8)):
                own[rng.randrange(len(own))] = f"New{rng.randrange(900)}"
            texts.append(" ".join(own[: len(own) - rng.randrange(0, 9)]))
    passage = " ".join(f"common{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(90)]
    texts += ["few words", "Few WORDS", "few words more"]
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))
    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert pairs > 150 and 90 + 12 < len({*root}) < len(texts) - 30
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r.doc_id for r in jaccard.keep_first(table, bucket=bucket).collect()) == sorted({*root})
    if bucket == jaccard.BUCKET:
        stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
        assert sorted(r.doc_id for r in stage(spark, table, str(tmp_path)).collect()) == sorted({*root})


def test_fingerprints_of_sets():
    rng = random.Random(3)
    for n in (0, 1, 2, 400):
        found = np.array(sorted(rng.getrandbits(64) for _ in range(n)), dtype=np.uint64)
        hashes, bits = [int(h) for h in found], []
        while len(bits) < 320:
            bits += [2 * sum(h >> b & 1 for h in hashes) > n for b in range(64)]
            hashes = [h * int(jaccard.MULTIPLIER) % (1 << 64) for h in hashes]
            hashes = [h ^ h >> 32 for h in hashes]
        parts = [p & (1 << 64) - 1 for p in jaccard.fingerprint(found)]
        assert [p & (1 << 40) - 1 for p in parts] == [sum(bit << i for i, bit in enumerate(bits[at : at + 40])) for at in range(0, 320, 40)]
    tags = [p >> 40 << 40 for p in parts]  # no mask lets parts of two numbers meet
    assert all((a ^ b) & m for a in tags for b in tags if a != b for m in simhash.masks(jaccard.RADIUS)) and len({*tags}) == 8


def test_near_duplicates_meet_by_their_fingerprints(spark, tmp_path, monkeypatch):
    """The stage goes through the covering tables, and exactly the near parts meet there; pairs are verified, the rest found."""
    rng = random.Random(23)
    texts = []
    for _ in range(10):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for _ in range(6):  # up to 4 changed words: similarity from about 0.8 to 1
            own = list(base)
            for at in rng.sample(range(400), rng.randrange(0, 5)):
                own[at] = f"new{rng.randrange(5000)}"
            texts.append(" ".join(own))
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(50)) for _ in range(20)]
    met, known = [], []
    covering, verified = simhash.links, getattr(jaccard, "links_by_fingerprint", None)
    monkeypatch.setattr(simhash, "links", lambda *a: met.append(covering(*a)) or met[-1])
    monkeypatch.setattr(jaccard, "links_by_fingerprint", lambda *a: known.append(verified(*a)) or known[-1], raising=False)
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = sorted(r.doc_id for r in stage(spark, table, str(tmp_path)).collect())
    assert len(met) == len(known) == 1

    sets = {jaccard.print_of(s): s for s in map(jaccard.shingles, texts)}
    parts = sorted({p & (1 << 64) - 1 for s in sets.values() for p in jaccard.fingerprint(s)})
    near = {(a, b) for i, a in enumerate(parts) for b in parts[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert {tuple(sorted((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1))) for r in met[0].collect()} == near

    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    edges = [(r.a, r.b) for r in known[0].collect()]
    assert all(alike(sets[a], sets[b]) >= 0.8 for a, b in edges)

    def roots(pairs):
        root = {p: p for p in sets}
        for a, b in pairs:
            root = {p: root[a] if r == root[b] else r for p, r in root.items()}
        return root

    every = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b]) >= 0.8]
    by_print, whole = roots(edges), roots(every)
    close = [(a, b) for a, b in every if alike(sets[a], sets[b]) >= 0.9]
    assert len(close) > 40 and sum(by_print[a] == by_print[b] for a, b in close) >= 0.9 * len(close)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(whole[jaccard.print_of(jaccard.shingles(t))], i)
    assert kept == sorted(first.values())


@pytest.mark.parametrize("bucket", [3, jaccard.BUCKET])
def test_similar_texts_with_every_odd_case(spark, docs, rows, empty, bucket):
    """NULL and blank texts, NULL ids, repeated rows and ids, very long texts, columns named as those inside."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    words = [re.findall(common.WORD, (r[1] or "").lower()) for r in ordered]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or 5 * len(sets[i] & sets[j]) >= 4 * both:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    found = jaccard.keep_first(docs, bucket=bucket)
    assert found.columns == docs.columns
    kept = found.collect()
    # of each component a row with the smallest id stays, whole
    assert Counter(r.doc_id for r in kept) == Counter(ordered[r][0] for r in {*root})
    assert all(tuple(r) in {*map(tuple, rows)} for r in kept)
    assert jaccard.keep_first(empty).count() == 0


# mixing


def plain_targets(sizes):
    """sizes: source -> words, in order of weight."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    full, target = set(), {}
    while True:
        free = [s for s in sizes if s not in full]
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        target.update({s: left * weight[s] / sum(weight[t] for t in free) for s in free})
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        full |= {*over}
        target.update({s: 2.0 * sizes[s] for s in over})


def test_mix(docs, rows, empty):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sums = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    target = plain_targets(sums)
    found = mixing.mix(docs, cell=8, fan=2).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in found) == Counter((r[0], size(r[1]), sums[r[3]]) for r in rows)
    taken, place = Counter(), {}
    for r in found:
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source_size] += r.taken
        place[r.source_size] = r.target
    for s in sources:
        assert place[sums[s]] == pytest.approx(target[s])
        assert abs(taken[sums[s]] - target[s]) <= max(size(r[1]) for r in rows if r[3] == s)
    again = mixing.mix(docs.repartition(3), cell=8, fan=2).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    copies = Counter()
    for r in found:
        copies[r.doc_id, r.size] += r.copies
    mixed = mixing.mixture(docs, cell=8, fan=2)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, size(r.text)) for r in mixed.collect()) == +copies
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_equal_rows_are_dealt_to_all_cells(spark):
    rows = [(5, "=a", 40, 333), (-9, "=a", 40, 7), ((1 << 63) - 1, "=b", 3, 100), (2, "=b", 3, 1)]
    table = materialize(spark.createDataFrame(rows, "k2 long, key string, cells long, m long"))
    found = Counter((r.k2, r.key, r.cell) for r in mixing.deal(table).collect())
    for k2, key, cells, m in rows:
        own = [n for (a, b, _), n in found.items() if (a, b) == (k2, key)]
        assert sum(own) == m and len(own) == min(m, cells) and max(own) - min(own) <= 1
    assert all(0 <= cell < 40 for _, _, cell in found)


def test_a_repeated_row_is_no_large_group(spark, monkeypatch):
    rows = [(1, "one two three", "en", "a", 13)] * 900 + [(i, "word " * (i % 50), "en", "a", 9) for i in range(2, 400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stored = []
    monkeypatch.setattr(mixing, "materialize", lambda df, name: stored.append((name, materialize(df, name))) or stored[-1][1])
    found = mixing.mix(table, cell=16, fan=4).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    assert abs(sum(r.taken for r in found) - found[0].target) <= 50
    first = next(df for name, df in stored if name == "mix-level")
    assert first.groupBy("key", "cell").count().agg(F.max("count")).head()[0] <= 64


def test_pivot_keeps_totals_and_expectations():
    size = np.array([50.0, 40, 30, 20, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1])
    p = np.full(len(size), 0.3)
    runs = []
    for seed in range(3000):
        got = mixing.pivot_by_size(size, p, np.random.default_rng(seed))
        assert (got * size).sum() == pytest.approx((p * size).sum())
        assert ((got > 0) & (got < 1)).sum() <= 1
        runs.append(got)
    assert np.abs(np.mean(runs, axis=0) - 0.3).max() < 0.05


# the pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(path)
    read = spark.read.parquet(path)
    kept = read
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, materialize(stage(spark, kept, str(tmp_path)))
        assert kept.columns == read.columns
        if name in ("quality", "near_duplicates"):
            assert kept.exceptAll(before).count() == 0
    texts = [r.text for r in kept.collect()]
    assert all(len(t.split()) >= 50 for t in texts) and texts
    prints = {plain_fingerprint(t) for t in texts}
    assert len({*plain_components(sorted(prints))}) == len(prints)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in found if r.start == 0) == Counter(r.doc_id for r in kept.collect())


def test_pipeline_gives_python_small_batches(spark):
    rows = spark.range(5 * corpus_pipeline.BATCH).repartition(1).selectExpr("id AS doc_id", "'some text' AS text", "'en' AS lang", "'a' AS source", "9L AS n_chars")
    largest = lambda: rows.mapInPandas(lambda parts: (p.iloc[:1, :1].set_axis(["n"], axis=1).assign(n=len(p)) for p in parts), "n long").agg(F.max("n")).head()[0]
    given = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(corpus_pipeline.BATCH_SETTING, corpus_pipeline.DEFAULT_BATCH)
            stage(spark, rows, "")
            assert largest() == corpus_pipeline.BATCH
        spark.conf.set(corpus_pipeline.BATCH_SETTING, 77)
        corpus_pipeline.quality(spark, rows, "")
        assert largest() == 77
    finally:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, given)


def test_pipeline_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
