"""The registered queries of the operators against their checking SQL."""

import os
import re
import sys
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from mendframe.llm import html_text
from test_corpus import plain_components, plain_fingerprint
from test_new import plain_base
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checking import compare, connect
from mendframe.llm.queries import CHECKS, QUERIES
from pyspark.sql import functions as F

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), CHECKS[name]) is None


def test_top_k_of_repeated_ids_equals_its_sql(spark, tmp_path):
    given = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    other = given.where("vec_id % 3 = 0").withColumn("embedding", F.reverse("embedding"))
    given.where("vec_id % 7 = 0").unionByName(given).unionByName(other).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect(SF_DIR)
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert compare(QUERIES["op4_topk"](spark, str(tmp_path)), con, CHECKS["op4_topk"]) is None


def test_native_sharding_runs_no_python(spark):
    plan = QUERIES["op2_sharding"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def documents(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def test_tokens_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter(tuple(r) for r in QUERIES["op6_tokens"](spark, SF_DIR).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    want = Counter()
    for i, text, *_ in documents(spark):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 2048] += 1
    assert got == want


def test_fingerprints_and_components(spark):
    rows = documents(spark)
    prints = [plain_fingerprint(text) for _, text, *_ in rows]
    roots = plain_components(prints)
    smallest = {}
    for (i, *_), root in zip(rows, roots, strict=True):
        smallest[root] = min(i, smallest.get(root, i))
    want = Counter((i, f"{p:016x}", smallest[root]) for (i, *_), p, root in zip(rows, prints, roots, strict=True))
    assert Counter(tuple(r) for r in QUERIES["op5_simhash"](spark, SF_DIR).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_base_scores(spark):
    found = QUERIES["op12_log_bilinear"](spark, SF_DIR).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == plain_base(documents(spark))
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_spelling_of_the_shortest_words(spark):
    found = QUERIES["op13_spelling"](spark, SF_DIR).collect()
    words = {r.word: r for r in found}
    masks, shorter = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masks[w[:i] + "\0" + w[i + 1 :]].add(w)
            shorter[w[:i] + w[i + 1 :]].add(w)
    for w, r in words.items():
        near = set().union(*(masks[w[:i] + "\0" + w[i + 1 :]] for i in range(len(w)))) | shorter[w] | {w[:i] + w[i + 1 :] for i in range(len(w)) if w[:i] + w[i + 1 :] in words}
        near.discard(w)
        best = min(near, key=lambda x: (-words[x].n, x), default=None)
        form = best if best is not None and words[best].n >= 10 * r.n else None
        assert (r.n_near, r.form, r.form_n) == (len(near), form, words[form].n if form else None), w
        last = w
        while words[last].form is not None:
            last = words[last].form
        assert r.root == last


def test_shards_hold_every_document_once(spark):
    found = QUERIES["op2_sharding"](spark, SF_DIR).collect()
    rows = documents(spark)
    assert Counter(r.doc_id for r in found) == Counter(i for i, *_ in rows)
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r)
    assert set(by_shard) <= set(range(8))
    for some in by_shard.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
    sizes = {i: len((text or "").encode()) + 1 for i, text, *_ in rows}
    assert all(r.size == sizes[r.doc_id] for r in found)


def test_mix_and_sequences_hold_together(spark):
    mixed = QUERIES["op8_mixing"](spark, SF_DIR).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, text, *_ in documents(spark)}
    assert {r.doc_id: r.size for r in mixed} == sizes
    assert all(0 <= r.taken <= 2 * r.size for r in mixed)
    pieces = QUERIES["op9_packing"](spark, SF_DIR).collect()
    covered = defaultdict(list)
    for r in pieces:
        covered[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert set(covered) == set(sizes)
    for some in covered.values():
        at = 0
        for start, length, total in sorted(some):
            assert start == at
            at += length
        assert at == total


def test_pages_have_text(spark):
    found = QUERIES["op3_html"](spark, SF_DIR).collect()
    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in found} == {i: html_text.render(h) for i, h in given.items()}


def test_hosts_are_rejected_where_their_documents_fail(spark):
    rows = QUERIES["host_rules_of_lengths"](spark, SF_DIR.replace("sf0.001", "sf0.01")).collect()
    assert any(not r.base_failed and not r.kept for r in rows)
