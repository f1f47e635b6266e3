"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton works over tokens: a state says which tokens may follow, and a token sequence is accepted just when it is the
byte-pair encoding of its own bytes. It is built by one gadget a merge, in merge order, from the automaton of one state that
allows every byte. The gadget of (u, v) -> x copies the state that u leads to, without its arc for v, lets all arcs of u lead to the copy, and
adds an arc for x, to where v led, to every state with an arc for u. Arcs for later tokens thus appear in a state whenever its arc
for their left part is there, so a state is stored as its parent, the token it lost and when; the arc table (state, token) is
filled from these on first use and kept.

Words are encoded by table-driven transitions. A trie over the vocabulary's bytes proposes the tokens that start at a position; the automaton
lets through just one token that ends at each position. The product of both is made deterministic over bytes, again on first use: one table lookup a byte gives
the token that ends there, and one walk back gives the encoding. All new words of some texts go through the table together, byte by byte, as arrays.
Decoding emits the labels (bytes) of the arcs.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extra_column, held, text_parts, with_mapped

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are split into words before merging: contractions, letters, numbers, other signs, each with the space before it, and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries at which a worker's tables (words, arcs, byte states) start anew. They bound memory and change no result. Slots of the byte states' table, a power of two.
CACHE, ARCS, STATES, SLOTS = 70_000, 200_000, 200_000, 1 << 20
#: Words of more bytes go through the table one by one.
LONG = 48


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """token -> id from lines of base64 token and id; ids rank the merges."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_parts(token: bytes, ranks: dict[bytes, int], rank: int) -> tuple[bytes, bytes] | None:
    """The two tokens that merge into token: what merges of lower rank leave of its bytes. None if these leave more than two."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = rank, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], rank)
            if r < best:
                best, at = r, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Automaton:
    """The compiled automaton. Pickles as its vocabulary and merge list, which are small; the rest is built where it is used."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.tokens, self.merges = tokens, merges
        self._build()

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> Automaton:
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (parts := merge_parts(token, ranks, rank)):
                merges.append((ranks[parts[0]], ranks[parts[1]], rank))
        return cls(ranks, merges)

    def __reduce__(self):
        return Automaton, (self.tokens, self.merges)

    def _build(self) -> None:
        n = max(self.tokens.values()) + 1
        self.label: list[bytes] = [b""] * n
        for token, i in self.tokens.items():
            self.label[i] = token
        self.left = [-1] * n
        self.born = [n + 1] * n  # tokens that no merge makes never appear
        for token, i in self.tokens.items():
            if len(token) == 1:
                self.born[i] = -1
        # states: 0 allows everything; state k > 0 is a copy of parent[k] without an arc for lost[k]
        self.parent, self.lost, self.token = [0], [-1], [-1]
        self.state = [0] * n  # where the arcs of a token lead
        self.right = [-1] * n
        self.lost_at: dict[int, int] = {}  # u << 32 | v: when the state after u lost its arc for v
        for time, (u, v, x) in enumerate(self.merges):
            if not self._allows(u, v):  # v never follows u by now, so the merge cannot happen
                continue
            target = self.state[v]
            self.parent.append(self.state[u])
            self.lost.append(v)
            self.token.append(u)
            self.state[u] = len(self.parent) - 1
            self.left[x], self.right[x], self.born[x], self.state[x] = u, v, time, target
            self.lost_at[u << 32 | v] = time
        self.arcs: dict[int, bool] = {}
        self.trie: dict[int, int] = {}  # node << 8 | byte -> node
        self.ends: list[int] = [-1]
        for token, i in self.tokens.items():
            if self.born[i] > n:
                continue
            node = 0
            for byte in token:
                nxt = self.trie.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.trie[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self.length = [len(x) for x in self.label]
        self.lengths = np.array(self.length, dtype=np.int64)
        self.after = {state: token for token, state in enumerate(self.state)}  # a token that leads to the state
        self._clear()

    def _allows(self, before: int, token: int) -> bool:
        """Whether the state after the token before has an arc for token.

        That state is a chain of copies: those made for before, then those made for its right part until before was made, and so on.
        A token has an arc in each state that had one for its left part when it was made. So the arc is missing just when some state of
        the chain lost its arc for a token on the left edge of token, no later than the next token on that edge was made."""
        born, left, right, lost_at = self.born, self.left, self.right, self.lost_at
        until = len(born)
        while before >= 0:
            t, limit = token, len(born)
            while t >= 0:
                time = lost_at.get(before << 32 | t)
                if time is not None and time < until and time <= limit:
                    return False
                limit = born[t]
                t = left[t]
            until = born[before]
            before = right[before]
        return True

    def allows(self, state: int, token: int) -> bool:
        """The arc table: whether token may come in that state. Filled on first use."""
        key = state << 32 | token
        got = self.arcs.get(key)
        if got is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            got = self.arcs[key] = not state or self._allows(self.after[state], token)
        return got

    def _clear(self) -> None:
        """Byte states, numbered. One holds, for each token that may still be growing, its node of the trie and the state before it, the longest first, as
        64-bit numbers (configs). The table, open addressing in two arrays, maps (byte state, byte) to (the next byte state, the one token that ends there in the encoding so far), both pairs packed into a number."""
        first = array("Q", [0]).tobytes()
        self.configs: list[bytes] = [first]
        self.number: dict[bytes, int] = {first: 0}
        self.keys, self.values, self.entries = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64), 0
        self.shift = np.uint64(65 - SLOTS.bit_length())

    def step(self, at: int, byte: int) -> int:
        """What the table has for a byte state and a byte."""
        found, alive, ends, arcs = -1, [], self.ends, self.arcs
        get, add = self.trie.get, alive.append
        for pair in array("Q", self.configs[at]):
            nxt = get(pair >> 32 << 8 | byte)
            if nxt is not None:
                state = pair & 0xFFFFFFFF
                add(nxt << 32 | state)
                if found < 0 and (token := ends[nxt]) >= 0:
                    ok = arcs.get(state << 32 | token)
                    if self.allows(state, token) if ok is None else ok:
                        found = token
        if found < 0:
            raise ValueError(f"byte {byte} has no token")
        add(self.state[found])
        after = array("Q", alive).tobytes()
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.configs)
            self.configs.append(after)
        return to << 32 | found

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys, -1 for those that the table lacks."""
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        have = self.keys[slot]
        out = np.where(have == keys, slot, -1)
        left = np.flatnonzero((have != keys) & (have != -1))
        while len(left):
            slot[left] = (slot[left] + 1) % SLOTS
            have = self.keys[slot[left]]
            hit = have == keys[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (have != -1)]
        return out

    def _fill(self, keys: np.ndarray) -> None:
        for key in np.unique(keys).tolist():
            slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.shift)
            while self.keys[slot] != -1:
                slot = (slot + 1) % SLOTS
            self.keys[slot], self.values[slot] = key, self.step(key >> 8, key & 255)
            self.entries += 1

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The encodings of pre-split words, as bytes of int32. ValueError for a byte that the vocabulary lacks."""
        if len(self.configs) >= STATES or 2 * self.entries > SLOTS:
            self._clear()
        if long := [k for k, w in enumerate(words) if len(w) > LONG]:
            short = [w for w in words if len(w) <= LONG]
            rest = iter(self.encode_words(short))
            one = {k: array("i", self._encode_long(words[k])).tobytes() for k in long}
            return [one[k] if k in one else next(rest) for k in range(len(words))]
        size = np.array([len(w) for w in words], dtype=np.int64)
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        left = len(words) - np.searchsorted(np.sort(size), np.arange(LONG + 1), side="right")  # words of more bytes than this
        state, last = np.zeros(len(words), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
        for k in range(int(size.max()) if len(size) else 0):
            now = order[: left[k]]
            keys = state[now] << 8 | text[start[now] + k]
            slot = self._find(keys)
            if (lacking := slot < 0).any():
                if 2 * (self.entries + len(words)) > SLOTS:  # too many words at once for the table
                    half = len(words) // 2
                    self._clear()
                    return self.encode_words(words[:half]) + self.encode_words(words[half:]) if half else [array("i", self._encode_long(words[0])).tobytes()]
                self._fill(keys[lacking])
                slot[lacking] = self._find(keys[lacking])
            got = self.values[slot]
            state[now], last[start[now] + k] = got >> 32, got & 0xFFFFFFFF
        # the walk back: from each word's end, the token that ends there, then what ends where it begins
        ends, at = np.zeros(len(text), dtype=bool), start + size - 1
        live = np.flatnonzero(size > 0)
        while len(live):
            place = at[live]
            ends[place] = True
            at[live] = place - self.lengths[last[place]]
            live = live[at[live] >= start[live]]
        flat = last[ends].astype(np.int32).tobytes()
        count = np.concatenate([[0], np.cumsum(ends)])
        cut = (4 * count[np.append(start, len(text))]).tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def _encode_long(self, word: bytes) -> list[int]:
        at, last, known = 0, [], {}
        for byte in word:
            got = known.get((at, byte))
            if got is None:
                got = known[at, byte] = self.step(at, byte)
            last.append(got & 0xFFFFFFFF)
            at = got >> 32
        i, out = len(word), []
        while i:
            out.append(last[i - 1])
            i -= self.length[out[-1]]
        return out[::-1]

    def encode_word(self, word: bytes) -> list[int]:
        """The encoding of one pre-split word."""
        return np.frombuffer(self.encode_words([word])[0], dtype=np.int32).tolist()

    def accepts(self, ids: list[int]) -> bool:
        """Whether ids are the encoding of the bytes they decode to."""
        return all(0 <= i < len(self.born) and self.born[i] <= len(self.born) for i in ids) and all(self.allows(self.state[a], b) for a, b in zip(ids, ids[1:]))

    def decode(self, ids) -> bytes:
        """The labels of the arcs that ids follow."""
        return b"".join(map(self.label.__getitem__, ids))


class Memory:
    """key -> value. When new is full it becomes old; what is asked for again moves from old to new, and what is not goes with old."""

    def __init__(self):
        self.new, self.old = {}, {}

    def ensure(self, keys, make) -> dict:
        """new, with all keys in it; make(keys) gives the values of those that are not known."""
        if len(self.new) >= CACHE:
            self.new, self.old = {}, self.new
        new, old, lacking = self.new, self.old, []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    lacking.append(k)
        if lacking:
            new.update(zip(lacking, make(lacking)))
        return new


class Encoder:
    """Encodes whole texts; pattern splits them into words.

    Under PATTERN a single space between other signs always begins a word. So a text is cut at its single spaces into units, each of which is encoded with the space before it, unless one is empty or has
    white space at an end; such texts are split into words as a whole."""

    def __init__(self, automaton: Automaton, pattern: str = PATTERN):
        self.automaton, self.split, self.words, self.units, self.own = automaton, regex.compile(pattern).findall, Memory(), Memory(), pattern == PATTERN

    def _words(self, words: list[str]) -> list[bytes]:
        return self.automaton.encode_words([w.encode() for w in words])

    def _units(self, units: list[str]) -> list[bytes | None]:
        """None for a unit that is empty or has white space at an end. Single words are kept as units alone."""
        single = [u for u in units if u.isalpha()]
        split = {u: self.split(" " + u) for u in units if u and not (u.isalpha() or u[0].isspace() or u[-1].isspace())}
        known = self.words.ensure({w for ws in split.values() for w in ws}, self._words)
        got = dict(zip(single, self._words([" " + u for u in single])))
        got.update((u, b"".join(map(known.__getitem__, ws))) for u, ws in split.items())
        return [*map(got.get, units)]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [t.split(" ") if self.own else [""] for t in texts]
        units = self.units.ensure(set().union(*(c[1:] for c in cut)), self._units)
        heads, tails = [], []
        for t, c in zip(texts, cut):
            tail = [*map(units.__getitem__, c[1:])]
            whole = not c[0] or c[0][-1].isspace() or None in tail
            heads.append(self.split(t if whole else c[0])), tails.append([] if whole else tail)
        words = self.words.ensure(set().union(*heads), self._words)
        return [np.frombuffer(b"".join([*map(words.__getitem__, head), *tail]), dtype=np.int32) for head, tail in zip(heads, tails)]

    def __call__(self, text: str) -> np.ndarray:
        return self.texts([text])[0]


def _encode_batches(shared, key: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(key, lambda: Encoder(shared.value, key[1]))
        label = encoder.automaton.label.__getitem__
        gc.disable()  # the tables are millions of small objects without cycles
        for batch in batches:
            for sub, strings in text_parts(batch, batch.num_columns - 1):
                got = iter(encoder.texts([t for t in strings if t is not None]))
                ids = [None if t is None else next(got) for t in strings]
                exact = [None if t is None else b"".join(map(label, x.tolist())) == t.encode() for t, x in zip(strings, ids)]
                size = [0 if x is None else len(x) for x in ids]
                flat = np.concatenate([x for x in ids if x is not None]) if any(size) else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in ids]))
                counts = pa.array([None if x is None else len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*sub.columns[:-1], lists, counts, pa.array(exact, pa.bool_())], names=[*batch.schema.names[:-1], "token_ids", "n_tokens", "exact"])

    return run


def encode(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """The kept columns with token_ids, n_tokens and exact (the ids decode to the text, byte for byte).

    One row for each row of docs, in a map without a shuffle. A null text has null in all three; an empty one has no ids and is exact. Kept columns
    named like an added one get underscores until they clash no more; the added ones keep their names. Texts are encoded whole."""
    automaton = Automaton.from_ranks(read_ranks(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    names = {c: c for c in keep}
    for c in keep:
        if c.lower() in ("token_ids", "n_tokens", "exact"):
            names[c] = extra_column(docs, c + "_")
    d = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return with_mapped(d, _encode_batches(shared, (f"{vocabulary} {len(automaton.tokens)} {hash(tuple(automaton.merges))}", pattern)), "token_ids array<int>, n_tokens long, exact boolean")


def decode(tokens: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, ids_col: str = "token_ids") -> DataFrame:
    """The kept columns with text. Null ids give null; bytes that are no UTF-8 become U+FFFD; an id that the vocabulary lacks, and null, emit nothing."""
    shared = tokens.sparkSession.sparkContext.broadcast([t for _, t in sorted((i, t) for t, i in read_ranks(vocabulary).items())])
    d = tokens.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = dict(enumerate(shared.value))
        for batch in batches:
            texts = [None if x is None else b"".join(label.get(i, b"") for i in x).decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return with_mapped(d, run, "text string")
