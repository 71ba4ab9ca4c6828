"""Token counts by a finite-state transducer compiled from a BPE tokenizer.

The greedy merges of byte-pair encoding have a local form: a sequence of tokens is
the encoding of a word exactly if every two neighbours are, taken alone, encoded as
those two.  So the last token of each prefix follows from the last tokens of
shorter prefixes: it is the one token that ends there and fits behind them.  A
state therefore needs only the open beginnings of tokens at the reading position
(nodes of the vocabulary's trie), with the token in front of each and the difference in
counts.  Reading a symbol moves to the next state and emits a change in the token
count.  Whether two tokens may be neighbours is read off their parts: the merge that made the
later one is undone, and what stood there before must not have merged across the
border any earlier (`Transducer._apart`).  States and transitions are compiled when first
met.  The last symbol of a word has transitions of its own, as the vocabulary marks ends of words.

The word pattern is a finite automaton as well; it synchronises at every blank, digit and
change between letters and symbols, where the transducer is in its start state.  Long texts are
cut there, into chunks that run in different tasks; where the last `WINDOW` characters of a chunk
hold no border, the cut stands inside a word.  The state map of a chunk tells, for states
before it, the state behind it and the tokens counted on the way.  A chunk behind a border has one
incoming state; one inside a word runs from every state that its left context
leads to from `PHASES` places, usually one and the same.  Maps are partial functions; they compose
neighbour by neighbour, level by level, as in a parallel prefix scan (`compose`).  Should a composition
meet a state that a chunk has not been run from, that chunk runs again from it, so
counts are exact whatever the text.

Counts of words up to `KEPT` bytes are remembered per worker, in two generations of bounded size.

Cases: NULL is empty; rows that repeat id and text each get a row; a long text that comes again
is counted once; a text without any border is cut inside its word; a last chunk may be empty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.session import materialize

CHUNK = 1 << 16
WINDOW = 1024  # characters before a cut that are searched for a border
PHASES = 12  # places from which the left context of a cut inside a word is read
MEMO = 300_000  # bound on words in a generation, and on compiled states, per worker
KEPT = 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Transducer:
    """Deterministic states over bytes; weights are changes in the token count.

    Tokens and their beginnings are the nodes of one trie and go by their numbers; the last
    byte of a word stands 256 higher.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        self.end = end
        self.byte = {c: b for b, c in enumerate(byte_symbols())}
        self.child: list[dict[int, int]] = [{}]
        self.is_token = [False]
        for token in vocabulary:
            if (node := self._node(token)) is not None:
                self.is_token[node] = True
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for i, merge in enumerate(merges):
            left, right = merge if isinstance(merge, (list, tuple)) else merge.split(" ")
            a, b, both = self._node(left), self._node(right), self._node(left + right)
            self.rank.setdefault((a, b), i)
            self.made.setdefault(both, (i, a, b))
        self.whole: dict[int, bool] = {}
        self.clear()

    def _node(self, token: str) -> int | None:
        """The node of a vocabulary entry, made when it is new; None for what is not made of bytes."""
        body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
        symbols = [self.byte.get(c) for c in body]
        if not symbols or None in symbols:
            return None
        if body != token:
            symbols[-1] += 256
        node = 0
        for s in symbols:
            if s not in self.child[node]:
                self.child[node][s] = len(self.child)
                self.child.append({})
                self.is_token.append(False)
            node = self.child[node][s]
        return node

    def clear(self) -> None:
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.states: list[tuple] = [(0, -1, 0)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.fits: dict[int, bool] = {}

    def _alone(self, token: int) -> bool:
        """Whether the token is its own encoding: its parts are, and merge no earlier with each other's."""
        known = self.whole.get(token)
        if known is None:
            made = self.made.get(token)
            known = made is None or (self._alone(made[1]) and self._alone(made[2]) and self._apart(made[1], made[2], made[0]))
            self.whole[token] = known
        return known

    def _apart(self, left: int, right: int, before: int = 1 << 60) -> bool:
        """Whether two tokens, each its own encoding, have not merged across their border by merges before `before`."""
        while True:
            if self.rank.get((left, right), before) < before:
                return False
            a, b = self.made.get(left), self.made.get(right)
            # undo the later merge; of equal ones the left was made first
            if a is not None and (b is None or a[0] > b[0]):
                before, left = min(before, a[0]), a[2]
            elif b is not None:
                before, right = min(before, b[0] + 1), b[1]
            else:
                return True

    def _fit(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            known = self.fits[pair] = self._alone(right) and self._apart(left, right)
        return known

    def _end(self, state: int, symbol: int) -> tuple[int, int]:
        """The token that ends with `symbol`, and what is emitted."""
        at, child = self.states[state], self.child
        for i in range(0, len(at), 3):
            node = child[at[i]].get(symbol)
            if node is not None and self.is_token[node] and (self._alone(node) if at[i + 1] < 0 else self._fit(at[i + 1], node)):
                return node, at[i + 2] + 1
        raise ValueError(f"no token for byte {symbol}")

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """A state lists (open beginning, token in front of it, count there less the count here), longest first."""
        token, emitted = self._end(state, symbol)
        at, child, key = self.states[state], self.child, []
        for i in range(0, len(at), 3):
            node = child[at[i]].get(symbol)
            if node is not None and child[node]:
                # a beginning counts from where it began; from here, the count there is less by what was emitted
                key += (node, at[i + 1], at[i + 2] - emitted)
        move = self.moves[state][symbol] = (self.load((*key, 0, token, 0)), emitted)
        return move

    def load(self, key: tuple) -> int:
        """The number of a state."""
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return number

    def tidy(self) -> None:
        """Between words only: numbers of states end here."""
        if len(self.states) > MEMO or len(self.fits) > 4 * MEMO:
            self.clear()

    def read(self, state: int, symbols: bytes) -> tuple[int, int]:
        """The state after `symbols`, none of them the last of a word, and the tokens emitted."""
        total, moves = 0, self.moves
        for symbol in symbols:
            move = moves[state].get(symbol) or self._compile(state, symbol)
            state, total = move[0], total + move[1]
        return state, total

    def close(self, state: int, symbols: bytes) -> int:
        """Tokens from `state` to the end of the word that `symbols` ends."""
        state, total = self.read(state, symbols[:-1])
        last = symbols[-1] + 256 if self.end else symbols[-1]
        moves = self.moves[state]
        if last not in moves:
            moves[last] = (0, self._end(state, last)[1])
        return total + moves[last][1]


def _kind(c: str) -> str:
    """What the word pattern takes a character for: L letter, N number, Z blank, S any other."""
    first = unicodedata.category(c)[0]
    return first if first in "LN" else "Z" if c.isspace() and not "\x1c" <= c <= "\x1f" else "S"


class Counter(dict):
    """Tokens of words, by word; the texts are read by the tokenizer's own rules."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only BPE over lower-case words is compiled")
        self.machine = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        # white space as Unicode has it; this library's own notion adds four control characters
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.any_words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        # the same pattern with the classes of the first 256 characters written out, for texts of these alone
        listed = {k: "".join(re.escape(chr(c)) for c in range(256) if _kind(chr(c)) == k) for k in "LNZ"}
        for name, k in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", "Z")):
            pattern = pattern.replace(f"[{name}]", f"[{listed[k]}]").replace(name, listed[k])
        self.latin_words = re.compile(pattern).findall
        self.runs = {"L": regex.compile(r"\p{L}*"), "S": regex.compile(r"[^\p{White_Space}\p{L}\p{N}]*")}
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")
        self.special_start = {t[0] for t in specials}
        self.old: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        total = self.old.get(word)
        if total is None:
            self.machine.tidy()
            total = self.machine.close(0, word.encode())
        if len(word) <= KEPT:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = total
        return total

    def words(self, plain: str) -> list[str]:
        try:
            plain.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_words(plain)
        return self.latin_words(plain)

    def segments(self, text: str) -> tuple[list[str], int]:
        """Normalised stretches between special tokens, and how many of these there are."""
        out, at, stops = [], 0, 0
        if any(c in text for c in self.special_start):
            for m in self.special.finditer(text):
                out.append(text[at : m.start()])
                at, stops = m.end(), stops + 1
        out.append(text[at:])
        return [normal(s) for s in out if s], stops

    def count(self, text: str) -> int:
        stretches, total = self.segments(text)
        for plain in stretches:
            total += sum(map(self.__getitem__, self.words(plain)))
        return total


def normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    # each character by itself: a final sigma is not special here
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def border(text: str, at: int) -> bool:
    """Whether the word pattern certainly begins anew before text[at]."""
    left, right = _kind(text[at - 1]), _kind(text[at])
    if left != right:
        # an apostrophe may go on as one word with the letters behind it
        return not (left == "S" and right == "L" and text[at - 1] == "'")
    return left in "NZ"


def inside(text: str, at: int) -> bool:
    """Whether text[at] certainly goes on with the word before it; four letters are more than an apostrophe's word."""
    kind = _kind(text[at])
    if kind == "S":
        return _kind(text[at - 1]) == "S"
    return kind == "L" and at >= 4 and all(_kind(c) == "L" for c in text[at - 4 : at])


def pieces(text: str, chunk: int) -> Iterator[tuple[str, str, str]]:
    """(piece, kind, left): chunks of a normalised text; kind is that of the word a piece begins inside of, left the part of that word before it."""
    start, kind, left = 0, "", ""
    while len(text) - start > chunk:
        at = start + chunk
        cut = next((i for i in range(at, max(start, at - WINDOW), -1) if border(text, i)), None)
        if cut is None:
            cut = next((i for i in range(at, len(text)) if border(text, i) or inside(text, i)), None)
        if cut is None:
            break
        now = "" if border(text, cut) else _kind(text[cut])
        yield text[start:cut], kind, left
        start, kind = cut, now
        if now:
            begin = cut - 1
            while begin > 0 and cut - begin < WINDOW and _kind(text[begin - 1]) == now:
                begin -= 1
            left = text[begin:cut]
        else:
            left = ""
    yield text[start:], kind, left


def _dump(machine: Transducer, state: int) -> str:
    return json.dumps(machine.states[state])


def _load(machine: Transducer, state: str) -> int:
    return machine.load(tuple(json.loads(state))) if state else 0


def chunk_map(count: Counter, piece: str, kind: str, left: str, open_end: bool, given: str | None = None) -> dict[str, tuple[str, int]]:
    """{state before: (state behind, tokens)}; "" is the start state.  `given`: the one state to run from."""
    machine = count.machine
    machine.tidy()
    head = count.runs[kind].match(piece).group() if kind else ""
    rest = piece[len(head) :]
    words, tail = count.words(rest), ""
    if open_end and rest:
        tail = words.pop()  # the cut stands inside of it
    inner = sum(map(count.__getitem__, words))
    # the words above may have renumbered the states, so states are read after them
    machine.tidy()
    if not kind:
        before = {"": 0}
    elif given is not None:
        before = {given: _load(machine, given)}
    else:
        before = {}
        for phase in range(min(PHASES, len(left))):
            state, _ = machine.read(0, left[phase:].encode())
            before[_dump(machine, state)] = state
    out = {}
    for name, state in before.items():
        behind, total = "", inner
        if open_end and not rest:
            state, n = machine.read(state, head.encode())
            behind, total = _dump(machine, state), total + n
        else:
            if kind:
                total += machine.close(state, head.encode())  # never empty: a cut inside a word goes on with it
            if open_end:
                state, n = machine.read(0, tail.encode())
                behind, total = _dump(machine, state), total + n
        out[name] = (behind, total)
    return out


# A composed map: {state before: (state behind, tokens, None)}, or (None, None, (chunk, state)) where a chunk has not been run from a state.
Composed = dict[str, tuple[str | None, int | None, tuple[int, str] | None]]


def join_maps(a: Composed, b: Composed, b_first: int) -> Composed:
    out = {}
    for state, (behind, total, stuck) in a.items():
        if stuck is None and behind not in b:
            out[state] = (None, None, (b_first, behind))
        elif stuck is None:
            further, more, stuck = b[behind]
            out[state] = (further, None if more is None else total + more, stuck)
        else:
            out[state] = (behind, total, stuck)
    return out


def compose(maps: list[dict[str, tuple[str, int]]]) -> Composed:
    """All maps in order, neighbours by neighbours."""
    level = [(i, {s: (o, n, None) for s, (o, n) in m.items()}) for i, m in enumerate(maps)]
    while len(level) > 1:
        pairs = [(level[i][0], join_maps(level[i][1], level[i + 1][1], level[i + 1][0])) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0][1]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), "body")

    def first(batches):
        """Short texts are counted; long ones are cut into chunks, with a row for each."""
        import pyarrow as pa

        count = counter(path)
        for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            out: dict[str, list] = {k: [] for k in ("take", "n_tokens", "key", "at", "piece", "kind", "left", "open_end")}
            for i, text in enumerate(part.column("body").to_pylist()):
                if len(text) <= chunk:
                    found = [(count.count(text), None, 0, None, None, None, None)]
                else:
                    key = hashlib.sha256(text.encode()).hexdigest()
                    stretches, stops = count.segments(text)
                    cut = [p for s in stretches for p in pieces(s, chunk)] or [("", "", "")]
                    after = [bool(kind) for _, kind, _ in cut[1:]] + [False]
                    # special tokens are counted with the first chunk
                    found = [(stops if at == 0 else 0, key, at, piece, kind, left, more) for at, ((piece, kind, left), more) in enumerate(zip(cut, after, strict=True))]
                for values in found:
                    for name, value in zip(out, (i, *values), strict=True):
                        out[name].append(value)
            take = pa.array(out.pop("take"), pa.int64())
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            arrays = [part.column(name).take(take) for name in ("doc_id", "n_bytes")] + [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", *out])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_tokens long, key string, at long, piece string, kind string, left string, open_end boolean"
    stored = materialize(rows.mapInArrow(first, schema), "tokens-first")
    short = stored.where("key IS NULL").select("doc_id", "n_bytes", "n_tokens")
    found = short.unionByName(_long_texts(stored.where("key IS NOT NULL"), path)) if stored.where("key IS NOT NULL").head(1) else short
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def _long_texts(cut: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of stored chunks; each distinct text runs once."""

    def run(batches):
        import pyarrow as pa

        count = counter(path)
        entry = pa.list_(pa.struct([("into", pa.string()), ("out", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            for r in batch.to_pylist():
                found = chunk_map(count, r["piece"], r["kind"], r["left"], r["open_end"], r["state"])
                entries = [{"into": s, "out": o, "n": n + r["n_tokens"]} for s, (o, n) in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), pa.array([r["at"]]), pa.array([entries], entry)], names=["key", "at", "entries"])

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        """A text's maps: one row per chunk and run, without text."""
        maps: dict[int, dict] = {}
        for at, entries in zip(frame["at"], frame["entries"], strict=True):
            maps.setdefault(at, {}).update({e["into"]: (e["out"], e["n"]) for e in entries})
        _, total, stuck = compose([maps[at] for at in sorted(maps)])[""]
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "n_tokens": pd.array([total], "Int64"), "at": pd.array([stuck and stuck[0]], "Int64"), "state": [stuck and stuck[1]]})

    # equal texts have equal chunks, which are dealt to tasks by text and place
    chunks = cut.select("key", "at", "n_tokens", "piece", "kind", "left", "open_end").dropDuplicates(["key", "at"])
    schema = "key string, at long, entries array<struct<into: string, out: string, n: bigint>>"
    maps = materialize(chunks.withColumn("state", F.lit(None).cast("string")).mapInArrow(run, schema), "tokens-maps")
    while True:
        totals = materialize(maps.groupBy("key").applyInPandas(scan, "key string, n_tokens long, at long, state string"), "tokens-totals")
        stuck = totals.where("state IS NOT NULL").select(F.col("key").alias("_key"), F.col("at").alias("_at"), "state")
        if not stuck.head(1):
            break
        again = chunks.join(stuck, (F.col("key") == F.col("_key")) & (F.col("at") == F.col("_at"))).drop("_key", "_at")
        maps = maps.unionByName(materialize(again.mapInArrow(run, schema), "tokens-maps"))
    whole = cut.where("at = 0").select("doc_id", "n_bytes", F.col("key").alias("_key"))
    return whole.join(totals.select("key", "n_tokens"), F.col("_key") == F.col("key")).select("doc_id", "n_bytes", "n_tokens")
