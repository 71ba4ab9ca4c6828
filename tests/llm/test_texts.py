"""Token counts, quality rules, line dedup, packing and page texts against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from mendframe.llm import host_rules, html_text, line_dedup, packing, tokens
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# token counts


def test_token_counts_equal_the_library(docs, rows):
    library = Tokenizer.from_file(WORDS)
    found = tokens.count_tokens(docs, WORDS, chunk=1000).collect()
    want = Counter()
    for r in rows:
        n = len(ids_of(library, r[1]))
        want[r[0], len((r[1] or "").encode()), n, n > 2048] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want


def test_token_counts_of_odd_texts():
    library, count = Tokenizer.from_file(WORDS), tokens.counter(WORDS)
    rng = random.Random(1)
    letters = "abcdeinthsr'éßΣσς東京İǅ12 9\n\t.,!?-_<|>́  \x1f\x85😀ﬁ"
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert count.count(text) == len(ids_of(library, text)), repr(text)
        assert by_chunks(count, text, rng.randrange(1, 20))[0] == count.count(text), repr(text)
    for text in ("<|startoftext|>a<|endoftext|><|endoftext|>", "a" * 3000, "antidisestablishmentarianism" * 50, "İ'SΣ" * 50):
        assert count.count(text) == len(ids_of(library, text))


def by_chunks(count, text, size):
    """Tokens by composed state maps, and how often a chunk had to run again."""
    stretches, total = count.segments(text)
    again = 0
    for plain in stretches:
        cut = list(tokens.pieces(plain, size))
        assert "".join(p for p, _, _ in cut) == plain
        after = [bool(kind) for _, kind, _ in cut[1:]] + [False]
        maps = [tokens.chunk_map(count, p, kind, left, more) for (p, kind, left), more in zip(cut, after, strict=True)]
        while (found := tokens.compose(maps)[""])[2] is not None:
            at, state = found[2]
            maps[at] |= tokens.chunk_map(count, *cut[at], after[at], state)
            again += 1
        total += found[1]
    return total, again


def drawn(letters, n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


LONG = {
    "one letter": "x" * 9000,
    "two letters": "ab" * 4000,
    "japanese": "東京" * 2000 + "タワー" * 1000,
    "base64": drawn("abcXYZ0123456789+/", 9000, 3),
    "letters": drawn("abcdefghijklmnopqrstuvwxyz", 9000, 4),
    "dots": "." * 3001,
    "marks": "!?'" * 3000,
    "mixed": "a" * 1500 + "-" * 3000 + "é" * 2000 + "'re" * 400,
    "special": "<|endoftext|>a" * 500,
    "blank": " \n" * 3000,
}


@pytest.mark.parametrize("name", LONG)
@pytest.mark.parametrize("size", [200, 1100, 4000])
def test_state_maps_of_long_texts(name, size):
    library, count = Tokenizer.from_file(WORDS), tokens.counter(WORDS)
    assert by_chunks(count, LONG[name], size)[0] == len(ids_of(library, LONG[name]))


def test_a_state_that_was_not_guessed_is_run_again(monkeypatch):
    count = tokens.counter(WORDS)
    monkeypatch.setattr(tokens, "PHASES", 1)
    found = [by_chunks(count, "." * n, size) for n, size in ((3001, 700), (2999, 533), (3333, 401))]
    assert [total for total, _ in found] == [count.count("." * n) for n in (3001, 2999, 3333)]
    assert sum(again for _, again in found) > 0


def test_long_texts_run_once_and_in_chunks(spark):
    library = Tokenizer.from_file(WORDS)
    texts = [*LONG.values(), "word, " * 3000]
    rows = [(i, t, 7, "k") for i, t in enumerate(texts)] + [(100 + i, texts[0], 7, "k") for i in range(40)] + [(None, texts[3], 7, "k"), (3, texts[3], 7, "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, at long, key string").repartition(3)
    found = tokens.count_tokens(table, WORDS, chunk=1000).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((r[0], len(ids_of(library, r[1]))) for r in rows)


def test_maps_compose_in_any_way():
    count = tokens.counter(WORDS)
    plain = count.segments(LONG["letters"] + " there is a thing's end " * 40 + LONG["base64"])[0][0]
    cut = list(tokens.pieces(plain, 300))
    after = [bool(kind) for _, kind, _ in cut[1:]] + [False]
    maps = [{s: (o, n, None) for s, (o, n) in tokens.chunk_map(count, *p, more).items()} for p, more in zip(cut, after, strict=True)]
    left = maps[0]
    for i, m in enumerate(maps[1:], 1):
        left = tokens.join_maps(left, m, i)
    right = maps[-1]
    for i in range(len(maps) - 2, -1, -1):
        right = tokens.join_maps(maps[i], right, i + 1)
    assert left[""] == right[""] and left[""][1] == count.count(plain)


def test_tokens_side_by_side_against_plain_merges():
    machine = tokens.counter(WORDS).machine
    text_of, todo = {0: ()}, [0]
    for node in todo:
        for s, child in machine.child[node].items():
            text_of[child] = (*text_of[node], s)
            todo.append(child)
    node_of = {t: n for n, t in text_of.items()}

    def encode(parts):
        parts = [node_of[(s,)] for s in parts]
        while len(parts) > 1:
            rank, i = min((machine.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [node_of[text_of[parts[i]] + text_of[parts[i + 1]]]]
        return parts

    rng = random.Random(5)
    known = [n for n in text_of if machine.is_token[n]]
    for n in rng.sample(known, 3000):
        assert machine._alone(n) == (encode(text_of[n]) == [n])
        text = text_of[n]
        for at in range(1, len(text)):
            a, b = node_of[text[:at]], node_of.get(text[at:])
            if b and machine.is_token[a] and machine.is_token[b] and machine._alone(a) and machine._alone(b):
                assert machine._apart(a, b) == (encode(text) == [a, b])
    inner = [n for n in known if text_of[n][-1] < 256 and machine._alone(n)]
    for _ in range(5000):
        a, b = rng.choice(inner), rng.choice(known)
        if machine._alone(b):
            assert machine._apart(a, b) == (encode(text_of[a] + text_of[b]) == [a, b])


# quality rules


def plain_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_features(docs, rows):
    found = host_rules.host_verdicts(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    want = Counter()
    for r in rows:
        f = plain_features(r[1])
        want[(r[0], *f, f[0] < 50 or 100 * f[4] > 50 * f[0])] += 1
    assert got == want


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b", "", "x a b c y a b c a b", "#a *b\n#a *b\n\n"])
def test_features_of_small_texts(text):
    assert host_rules.features_of(text) == plain_features(text)


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 5 else bad, f"h{i % 10}") for i in range(1000)]
    rows += [(2000 + i, bad if i else good, "spam") for i in range(100)]
    rows += [(3000, bad, "small"), (3001, good, "small"), (3002, good, None), (3003, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in host_rules.host_verdicts(docs).collect()}
    assert not kept[2000]  # good, but its host is not
    assert kept[3001] and kept[3002] and kept[1] and not kept[0] and not kept[3003]
    left = host_rules.keep_good(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, k in kept.items() if k}


def test_like_hosts_shrink_to_the_corpus(spark):
    rows = [(f"h{i % 7}", i % 100 < 12) for i in range(7000)]
    found = host_rules.host_rates(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()
    assert all(abs(r.rate - 0.12) < 1e-3 and r.low < r.limit for r in found)


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_hosts_that_all_fail_or_none(spark, share):
    rows = [(f"h{i % 3}", bool(share)) for i in range(30)]
    assert host_rules.rejected(spark.createDataFrame(rows, "host string, base_failed boolean")).count() == 0


def test_prior():
    assert host_rules.prior(3, 30, 0, 300.0, 0.0) == (0.0, 1.0)
    alpha, beta = host_rules.prior(2, 200, 100, 2 * 100.0**2, 50.0)  # equal rates: as strong as the corpus
    assert alpha == beta == 100
    alpha, beta = host_rules.prior(2, 200, 100, 2 * 100.0**2, (90**2 + 10**2) / 100)
    assert alpha == pytest.approx(beta) and alpha < 5


# line dedup


def plain_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    order = sorted(((r[0] is None, r[0] or 0, n) for n, r in enumerate(rows)))
    for _, _, n in order:
        for pos, line in enumerate((rows[n][1] or "").split("\n")):
            bare = line.strip(" \t\x0b\x0c\r")
            if bare:
                sites[bare].add(rows[n][3])
                first.setdefault(bare, (n, pos))
    out = []
    for n, r in enumerate(rows):
        if r[1] is None:
            out.append(None)
            continue
        kept = []
        for pos, line in enumerate(r[1].split("\n")):
            bare = line.strip(" \t\x0b\x0c\r")
            if not bare or len(sites[bare]) < min_sites or first[bare] == (n, pos):
                kept.append(line)
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize("lg_k", [4, 12])  # coarse sketches leave more lines to the exact count
def test_lines_on_many_sites_stay_once(spark, lg_k):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        lines = [rng.choice(["Licensed.", " Licensed. ", "Share this", "Seldom", "", "  "]) for _ in range(4)] + [f"own {i}"]
        if i % 20:
            lines = [x for x in lines if x != "Seldom"]
        rows.append((i, "\n".join(lines), "", f"s{i % 12}" if i % 13 else None))
    rows += [(None, "Licensed.\nx", "", "s0"), (500, None, "", "s1"), (501, "", "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    found = line_dedup.clean_lines(docs, min_sites=10, lg_k=lg_k).select("whole.doc_id", "clean", "n_lines", "n_removed").collect()
    want = plain_lines(rows, 10)
    assert sorted((str(r.doc_id), r.clean or "") for r in found) == sorted((str(r[0]), w or "") for r, w in zip(rows, want, strict=True))
    by_id = {r.doc_id: r for r in found}
    assert by_id[500].clean is None and by_id[500].n_lines == 0 and by_id[501].clean == ""
    assert all(r.n_lines - r.n_removed == (r.clean or "").count("\n") + 1 for r in found if r.clean)


def test_lines_of_odd_documents(docs, rows, empty):
    left = line_dedup.without_boilerplate(docs, min_sites=2)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.source, r.row) for r in left.collect()) == Counter((r[0], r[3], r[5]) for r in rows)
    assert line_dedup.without_boilerplate(empty).count() == 0


# packing


def check_packing(found, want, capacity=2048):
    """Each id of each document in one piece; sequences without gaps."""
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        assert 1 <= r.length <= capacity
    crcs = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in found)
    expected = Counter()
    for doc, ids in want:
        for start in range(0, len(ids), capacity):
            own = ids[start : start + capacity]
            expected[doc, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert crcs == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_holds_every_token_once(docs, rows, empty):
    library = Tokenizer.from_file(BYTES)
    want = [(r[0], np.array([*ids_of(library, r[1]), 1], dtype="<u4")) for r in rows]
    n = check_packing(packing.pack(docs, BYTES).collect(), want)
    assert n <= 1.1 * sum(len(x) for _, x in want) / 2048 + 2
    assert packing.pack(empty, BYTES).count() == 0


def test_plan_is_near_the_bound():
    rng = random.Random(4)
    for n in (1, 10, 3000):
        sizes = Counter(rng.randrange(1, 257) for _ in range(n))
        found = packing.plan(sizes, 256)
        used = Counter()
        for pattern, often in found:
            assert sum(s * k for s, k in pattern.items()) <= 256
            for s, k in pattern.items():
                used[s] += k * often
        assert used == sizes
        total = sum(often for _, often in found)
        assert total <= 1.02 * sum(s * k for s, k in sizes.items()) / 256 + 2


def test_best_pattern_against_trying_all():
    rng = np.random.default_rng(6)
    for _ in range(20):
        worth = rng.random(6) * (rng.random(6) < 0.7)
        best = [0.0] * 7
        for c in range(1, 7):
            best[c] = max([0.0, best[c - 1], *(worth[i] + best[c - i - 1] for i in range(c))])
        value, pattern = packing.best_pattern(worth, 6)
        assert value == pytest.approx(best[6]) and (pattern * worth).sum() == pytest.approx(value)
        assert (pattern * np.arange(1, 7)).sum() <= 6


# page texts


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a <b> b</b>\n c<br>d", "a b c\nd"),
        ("<title>t</title><script>x<p></script><style>y</style>z", "z"),
        ("<p hidden>no</p><p style='color:red;display : none'>no</p>yes", "yes"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("<table><tr><th>Name<th>N<tr><td>x<td>10<tr><td>longer<td>2</table>after", "Name   | N\nx      | 10\nlonger | 2\n\nafter"),
        ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide  | z\na | b | c"),
        ("<table><tr><td><p>a<p>b<td>c</table>", "a | c\n  |\nb |"),
        ("<table><td>a<table><tr><td>in<td>ner</table></table>x", "a\n\nin | ner\n\nx"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<blockquote>q</blockquote>r", "> q\n\nr"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("a</nothing></li>b &amp; &lt;i&gt;", "ab & <i>"),
        ("a</p>b", "a\n\nb"),
        ("<p>a<div>b</p>c", "a\n\nb\n\nc"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A | b\n  | c"),
        ("<table><tr><td>a<td rowspan=3>B<td>c<tr><td>d<td>e<tr><td>f<td>g<tr><td>h<td>i<td>j</table>", "a | B | c\nd |   | e\nf |   | g\nh | i | j"),
        ("<table><tr><td rowspan=2 colspan=2>AB<td>c<tr><td>d<tr><td>x<td>y<td>z</table>", "AB    | c\n      | d\nx | y | z"),
        ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</table>", "A | b\n  | c\n  | d"),
        ("<table><tr><td colspan=1000>a<td colspan=1000>b</table>", "a | b"),
        ("<table><tr><td>東京<td>x<tr><td>abcd<td>y<tr><td>e\u0301<td>z</table>", "東京 | x\nabcd | y\ne\u0301    | z"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>", "漢kan"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<div style='display:none'>no<b style='visibility:visible'>no</b></div>x", "x"),
        ("<p style='visibility:hidden'>no<img alt=no><input type=button value=no></p>x", "x"),
        ("<input type=submit value='Send it'><input type=text value=no><input type=RESET value=Clear>", "Send it Clear"),
        ("<ol><li>a<li value=7>b<li>c<li value=x>d</ol>", "1. a\n7. b\n8. c\n9. d"),
        ("<ol reversed><li>a<li>b<ul><li>in</ul><li>c</ol>", "3. a\n2. b\n   - in\n1. c"),
        ("<ol reversed start=10><li>a<li>b</ol>", "10. a\n9. b"),
        ("x<!-- never closed <p>y", "x"),
        ("x < y and <a href='unclosed>z", "x < y and"),
        ("<img alt='A cat'><input value=no>", "A cat"),
        ("a<button>Send</button>b", "a Send b"),
        ("a<textarea>\none\n two &amp; <b></textarea>b", "a\none\n two & <b>\nb"),
        ("<select><optgroup label=G><option>x<option label=L>y</select>z<datalist><option>no</datalist>", "G\nx\nL\nz"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("<svg><title>no</title><defs><text>no</text></defs>no<text>a <tspan>b</tspan></text><text>c</text></svg>d", "a b c d"),
        ("<svg><foreignObject><p>in</foreignObject><text>t</text></svg>", "in\n\nt"),
        ("<body><svg/><p>text</p></body>", "text"),
        ("<svg><path d='M0'/><text/><text>t</text></svg><math/>u", "t u"),
        ("<svg><g a=b/><p>text", "text"),
        ("<div><button>Menu</div>rest", "Menu\nrest"),
        ("<p>a<button><p>b</p>c</button>d</p>e", "a\n\nb\n\nc d\n\ne"),
        ("<button>a<button>b</button>c", "a b c"),
        ("<head><title>no</title>plain <b>text</b>", "plain text"),
        ("<head> <head><meta x><li>item", "- item"),
    ],
)
def test_layout(page, text):
    assert html_text.render(page) == text


def test_wide_spans_stay_bounded():
    page = "<table><tr>" + "<td colspan=1000>x" * 20_000 + "<tr><td rowspan=60000>y" * 500 + "</table>"
    assert len(html_text.render(page)) < 4 * len(page)


# a plain renderer: the tree is given, its text laid out by recursion


def random_tree(rng, depth=0):
    """(tag, attributes, children) or a word."""
    if depth > 4 or rng.random() < 0.3:
        return rng.choice(["one", "two three", "vier", "東京", "x"])
    tag = rng.choice(["p", "div", "ul", "ol", "table", "b", "blockquote", "hidden", "unseen"])
    if tag in ("ul", "ol"):
        items = [("li", {"value": rng.randrange(9)} if rng.random() < 0.2 else {}, [random_tree(rng, depth + 2) for _ in range(rng.randrange(1, 3))]) for _ in range(rng.randrange(1, 4))]
        attrs = {} if tag == "ul" else rng.choice([{}, {"start": 5}, {"reversed": ""}])
        return tag, attrs, items
    if tag == "table":
        span = lambda: {k: rng.randrange(2, 4) for k in ("colspan", "rowspan") if rng.random() < 0.2}
        return tag, {}, [("tr", {}, [("td", span(), [random_tree(rng, depth + 3)]) for _ in range(rng.randrange(1, 4))]) for _ in range(rng.randrange(1, 4))]
    if tag in ("p", "b"):
        return tag, {}, [rng.choice(["inline", "words here"]) for _ in range(rng.randrange(1, 3))]
    return tag, {}, [random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 4))]


def as_html(rng, node):
    if isinstance(node, str):
        return f" {node} "
    tag, attrs, children = node
    inner = "".join(as_html(rng, x) for x in children)
    if tag == "hidden":
        return f"<div {rng.choice(['hidden', 'style=display:none'])}>{inner}</div>"
    if tag == "unseen":
        return f'<div style="visibility:hidden">{inner}<span style="visibility:visible"> seen </span></div>'
    listed = "".join(f" {k}={v}" if v != "" else f" {k}" for k, v in attrs.items())
    left_out = tag in ("li", "td", "tr") and rng.random() < 0.5
    return f"<{tag}{listed}>{inner}" + ("" if left_out else f"</{tag}>")


def laid_out(nodes, seen=True):
    """[(line, gap before)]: laid out lines, and whether a blank line is due before each; and whether one is due behind."""
    lines, gap, open_line = [], False, False

    def put(found, due, ends):
        nonlocal gap, open_line
        for i, (text, g) in enumerate(found):
            lines.append((text, g or (gap if i == 0 else False)))
            gap = False
        gap, open_line = gap or due, not ends and bool(found)

    def inline(text):
        nonlocal open_line, gap
        if open_line:
            lines[-1] = (lines[-1][0] + " " + text, lines[-1][1])
        else:
            lines.append((text, gap))
            gap, open_line = False, True

    def block(inner, spaced, behind):
        nonlocal gap, open_line
        open_line, gap = False, gap or spaced
        found, due = inner
        put(found, due, True)
        gap = gap or behind

    def walk(node, lists):
        nonlocal gap, open_line
        if isinstance(node, str):
            if shown[-1]:
                inline(node)
            return
        tag, attrs, children = node
        if tag == "hidden":
            return
        if tag == "b":
            for x in children:
                walk(x, lists)
            return
        if tag == "unseen":
            open_line = False
            shown.append(False)
            for x in children:
                walk(x, lists)
            shown.pop()
            inline("seen")
            open_line = False
            return
        if tag in ("ul", "ol"):
            open_line, gap = False, gap or not lists
            number, step = attrs.get("start", 1), -1 if "reversed" in attrs else 1
            if step < 0 and "start" not in attrs:
                number = len(children)
            for _, a, inner in children:
                number = a.get("value", number)
                mark = "- " if tag == "ul" else f"{number}. "
                number += step
                found, due = laid_out_of(inner, shown[-1], [*lists, tag])
                put([((mark if i == 0 else " " * len(mark)) + t, g) for i, (t, g) in enumerate(found)], due, True)
            gap = gap or not lists
            return
        if tag == "table":
            rows = [[(joined(laid_out_of(cell[2], shown[-1], [])[0]), cell[1].get("colspan", 1), cell[1].get("rowspan", 1)) for cell in row[2]] for row in children]
            block(([(t, False) for t in plain_table(rows)], False), True, True)
            return
        spaced = tag in ("p", "blockquote")
        found, due = laid_out_of(children, shown[-1], lists)
        if tag == "blockquote":
            found = [("> " + t, g) for t, g in found]
        block((found, due), spaced, spaced)

    shown = [seen]
    for node, lists in nodes:
        walk(node, lists)
    return lines, gap


def laid_out_of(children, seen, lists):
    return laid_out([(x, lists) for x in children], seen)


def joined(found):
    out = []
    for i, (text, gap) in enumerate(found):
        out += [""] * (gap and i > 0) + [text.rstrip()]
    return out


def plain_table(rows):
    taken, grid = {}, []
    for r, row in enumerate(rows):
        at, line = 0, []
        for lines, span, down in row:
            while any((r, at + k) in taken for k in range(span)):
                at += 1
            line.append((at, span, lines))
            for d in range(1, down):
                taken |= {(r + d, at + k): (at, span) for k in range(span)}
            at += span
        line += [(a, s, []) for a, s in {v for (rr, _), v in taken.items() if rr == r}]
        grid.append(sorted(line, key=lambda x: x[0]))
    grid = [g for g in grid if any(lines for _, _, lines in g)]
    wide = lambda t: sum(2 if ord(c) > 0x2E80 else 1 for c in t)
    widths = {}
    for g in grid:
        for a, s, lines in g:
            if s == 1:
                widths[a] = max([widths.get(a, 0), *map(wide, lines)])
    out = []
    for g in grid:
        for k in range(max(len(lines) for _, _, lines in g)):
            cells = []
            for a, s, lines in g:
                own = [widths[x] for x in range(a, a + s) if x in widths]
                text = lines[k] if k < len(lines) else ""
                cells.append(text + " " * (sum(own) + 3 * (len(own) - 1) - wide(text)))
            out.append(" | ".join(cells).rstrip())
    return out


def test_random_pages_against_the_plain_renderer():
    rng = random.Random(11)
    for _ in range(1500):
        trees = [random_tree(rng) for _ in range(rng.randrange(1, 4))]
        page = "".join(as_html(rng, t) for t in trees)
        want = "\n".join(joined(laid_out_of(trees, True, [])[0])).strip("\n")
        assert html_text.render(page) == want, page


def test_deep_nesting_and_long_pages():
    assert html_text.render("<div>" * 50_000 + "x") == "x"
    assert html_text.render("<" * 20_000 + " x").endswith("< x")
    assert len(html_text.render("<p>word</p>" * 20_000).split()) == 20_000


def test_events_are_balanced():
    rng = random.Random(7)
    bits = ["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "t", "<br>", "<select><option>", "</td>"]
    for _ in range(300):
        stack = []
        page = "".join(rng.choice(bits) for _ in range(30))
        for kind, tag, _ in html_text.events(page):
            if kind == "open":
                stack.append(tag)
            elif kind == "close":
                assert stack.pop() == tag
        assert not stack
        html_text.render(page)


def test_extract_pages(spark):
    rows = [(1, "u", "<p>a"), (2, None, None), (2, None, None), (None, "u", ""), (3, "u", "<p>x" * 5000)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.text[:3], r.n_lines) for r in found) == Counter({(1, "a", 1): 1, (2, "", 0): 2, (None, "", 0): 1, (3, "x\n\n", 9999): 1})
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
