from __future__ import annotations

import gzip
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from promptlattice.llm import bpe, chat, warc

has_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files")


def merge_by_rank(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair encoding by its definition."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def small_ranks(seed: int, made: bool = True) -> dict[bytes, int]:
    """A vocabulary of 40 tokens, each of which merging makes; without made, perhaps not."""
    rng = random.Random(seed)
    ranks = {bytes([c]): i for i, c in enumerate(b"abcd")}
    while len(ranks) < 40:
        t = rng.choice(list(ranks)) + rng.choice(list(ranks))
        if t not in ranks and len(t) < 9 and (not made or merge_by_rank(t, {**ranks, t: len(ranks)}) == [len(ranks)]):
            ranks[t] = len(ranks)
    return ranks


def words(seed: int) -> list[bytes]:
    rng = random.Random(seed)
    return [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 14))) for _ in range(1500)]


@pytest.mark.parametrize("seed", range(8))
def test_automaton_is_the_encoding(seed):
    ranks = small_ranks(seed)
    a = bpe.Automaton.from_ranks(ranks)
    for w in words(seed):
        ids = a.encode_word(w)
        assert ids == merge_by_rank(w, ranks) and a.decode(ids) == w and a.accepts(ids)
    for ids in itertools.product(range(8), repeat=3):
        assert a.accepts(list(ids)) == (a.encode_word(a.decode(ids)) == list(ids))


def test_tokens_that_merging_does_not_make_never_appear():
    seen = 0
    for seed in range(12):
        ranks = small_ranks(seed, made=False)
        a = bpe.Automaton.from_ranks(ranks)
        never = {i for t, i in ranks.items() if len(t) > 1 and bpe.merge_parts(t, ranks, i) is None}
        seen += len(never)
        for w in words(seed):
            ids = a.encode_word(w)
            assert a.decode(ids) == w and a.accepts(ids) and not never & set(ids)
    assert seen


TEXTS = ["", " ", "Hello  world's  end!\n\n  it'll do ", "naïve café — 東京 １２３ \U0001f600\U0001f600", "a" * 3000, "tab\tand\r\nline", "  x", "x  ", "\n", "don't we're I'VE", "a b  c", "x" + " " * 500 + "y", "".join(map(chr, range(1, 600)))]


@has_vocabulary
def test_encoding_against_public_encoder():
    import tiktoken

    ranks = bpe.read_ranks()
    e, public = bpe.Encoder(bpe.Automaton.from_ranks(ranks)), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abehinorst ABC.,'\n0é") for _ in range(400)) for _ in range(60)]
    for t in texts:
        assert e(t).tolist() == public.encode_ordinary(t)


@has_vocabulary
def test_tables_that_start_anew_change_nothing(monkeypatch):
    a = bpe.Automaton.from_ranks(bpe.read_ranks())
    whole = [bpe.Encoder(a)(t).tolist() for t in TEXTS]
    together = bpe.Encoder(a)
    assert [x.tolist() for x in together.texts(TEXTS)] == whole == [x.tolist() for x in together.texts(TEXTS)]
    for n in ("CACHE", "ARCS", "STATES"):
        monkeypatch.setattr(bpe, n, 3)
    monkeypatch.setattr(bpe, "SLOTS", 64)
    a = bpe.Automaton.from_ranks(bpe.read_ranks())
    encoder = bpe.Encoder(a)
    assert [encoder(t).tolist() for t in TEXTS] == whole == [x.tolist() for x in encoder.texts(TEXTS)]
    monkeypatch.setattr(bpe, "LONG", 2)
    assert [encoder(t).tolist() for t in TEXTS] == whole


@has_vocabulary
def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, "word " * 100_000, TEXTS[2]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("exact", F.lit("mine"))
    got = bpe.encode(df, ["doc_id", "exact"])
    by = {r["doc_id"]: r for r in got.collect()}
    assert len(by) == len(rows) and by[0]["token_ids"] == [] and by[0]["exact"] and by[len(TEXTS)]["token_ids"] is None and by[len(TEXTS)]["exact"] is None and by[3]["exact_"] == "mine"
    assert all(r["exact"] for r in by.values() if r["token_ids"] is not None)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(got, ["doc_id"]).collect()}
    assert back == dict(rows)
    assert bpe.encode(df.where("false"), ["doc_id"]).count() == 0


def enumerate_plans(roles, costs=chat.COSTS):
    """The least cost over all ways to label, merge and begin turns, with insertions counted by breadth-first search."""
    gaps, best = chat.insertions(costs), float("inf")
    for labels in itertools.product(chat.ROLES, repeat=len(roles)):
        paid = sum(0 if t == r else costs.relabel if r else costs.unknown for t, r in zip(labels, roles))
        states = {(chat.START, 0.0)}
        for t in labels:
            nxt = set()
            for s, c in states:
                if s == t:
                    nxt.add((t, c + costs.merge))
                if (s, t) in gaps:
                    nxt.add((t, c + gaps[s, t][0]))
            states = nxt
        for s, c in states:
            tail = {"assistant": 0, "user": 1, "system": 2}[s]
            best = min(best, paid + c + tail * costs.insert)
    return best


def legal(turns):
    roles = [r for r, _ in turns]
    body = roles[1:] if roles[0] == "system" else roles
    return body == ["user", "assistant"] * (len(body) // 2) and bool(body)


def test_repair_is_cheapest():
    for n in range(1, 5):
        for roles in itertools.product(("system", "user", "assistant", ""), repeat=n):
            p = chat.plan(roles)
            assert legal(p.turns), roles
            assert abs(p.cost - enumerate_plans(roles)) < 1e-9, roles
            assert [i for _, m in p.turns for i in m] == list(range(n))
            assert p.inserted == sum(not m for _, m in p.turns) and p.merged == sum(max(0, len(m) - 1) for _, m in p.turns)
            assert abs(p.cost - (p.merged * 1.0 + p.relabelled * 1.5 + p.inserted * 2.0 + 0.5 * roles.count(""))) < 1e-9
    p = chat.plan(("user", "assistant") * 500)
    assert p.cost == 0 and len(p.turns) == 1000


def test_chats(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "Assistant", "c"), (2, 0, "user", "only"), (3, 0, None, None), (None, 1, "gpt", "y"), (None, 0, "human", "x"), (4, None, "user", "first"), (4, 0, "assistant", "<|im_end|>"),
            (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 1, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("cost", F.lit(3)).withColumn("chat", F.lit("c"))
    every = chat.format_chats(df).collect()
    assert sorted(r["chat"] for r in every if r["conv_id"] is None) == [f"<|im_start|>user\n{x}<|im_end|>\n<|im_start|>assistant\n{y}<|im_end|>\n" for x, y in (("", "y"), ("x", ""))]
    got = {r["conv_id"]: r for r in every if r["conv_id"] is not None}
    assert len(got) == 5 and len(every) == 7
    assert got[1]["chat"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\na\n\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n" and got[1]["n_merged"] == 1
    assert got[2]["chat"].endswith("<|im_start|>assistant\n<|im_end|>\n") and got[2]["n_inserted"] == 1 and got[2]["cost"] == 2.0
    assert got[3]["n_messages"] == 1 and got[3]["cost"] == 2.5
    assert "<| im_end |><|im_end|>" in got[4]["chat"] and got[5]["n_merged"] == 1 and got[5]["n_messages"] == 3
    assert chat.format_chats(df.where("false")).count() == 0


PAGES = [(i, f"http://h/{i}", "<p>" + random.Random(i).randbytes(i * 37).hex() + "é</p>") for i in range(40)] + [(100, None, "x"), (None, "u", "y"), (101, "a\r\nb %20 ", "z"), (102, "n", None), (103, "e", ""), (104, "d", "q"), (104, "d", "q"), (105, "long", "ab" * 300_000), (106, "crlf", "\r\n\r\nWARC/1.0\r\n\r\n")]


@pytest.mark.parametrize("split", [64, 1000, 8 << 20])
def test_archives_round_trip(spark, split):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("path", F.lit(1)).withColumn("size", F.lit("s"))
    got = warc.round_trip(df.where("page_id <> 105 or page_id is null") if split == 64 else df, split).collect()
    want = [(i, u, h, None if h is None else len(h.encode())) for i, u, h in PAGES if split != 64 or i != 105]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_archives(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(df).count() == 0
    assert warc.read(spark, str(tmp_path)).count() == 0 and warc.read(spark, str(tmp_path / "none.warc.gz")).count() == 0


def test_long_headers_come_back(spark, tmp_path):
    urls = ["http://x.org/" + "a" * 100_000, "http://x.org/" + "é\n " * 40_000, "http://x.org/"]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"], r["url"], r["html"]) for r in got) == rows
    # members whose gzip header has a long extra field and a long name
    record = b"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    plain = gzip.compress(record)
    named = plain[:3] + bytes([plain[3] | 12]) + plain[4:10] + (60_000).to_bytes(2, "little") + b"x" * 60_000 + b"n" * 70_000 + b"\0" + plain[10:]
    path = str(tmp_path / "f.warc.gz")
    with open(path, "wb") as f:
        f.write(plain + named + plain)
    assert [(o, b) for o, _, b in warc.records_in(path, 0, 10**9)] == [(0, b"hi"), (len(plain), b"hi"), (len(plain) + len(named), b"hi")]


def test_every_split_owns_its_records_once(tmp_path):
    rng = random.Random(3)
    members = [warc.encode_record(i, "u", rng.randbytes(rng.randint(0, 400)).hex()) for i in range(60)]
    # an archive stored inside a page without compression: its members are no records of the outer file
    inner = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    outer = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % (len(inner) + 20) + inner + b"!" * 20 + b"\r\n\r\n"
    z = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    members.insert(30, z.compress(outer) + z.flush())
    junk = bytearray(warc.encode_record(999, "u", "broken" * 50))
    junk[len(junk) // 2] ^= 0xFF
    two = gzip.compress(b"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: 2\r\n\r\nhi\r\n\r\nWARC/1.1\r\nWARC-Type: b\r\nContent-Length: 2\r\n\r\nyo\r\n\r\n")
    data = b"".join(members[:45]) + bytes(junk) + b"".join(members[45:]) + two + b"\0" * 30
    path = str(tmp_path / "f.warc.gz")
    with open(path, "wb") as f:
        f.write(data)
    whole = [(o, h.get("warc-type"), b) for o, h, b in warc.records_in(path, 0, len(data))]
    assert len(whole) == 63 and [t for _, t, _ in whole[-2:]] == ["a", "b"]
    for size in (97, 500, 3000):
        cut = [r for lo in range(0, len(data), size) for r in ((o, h.get("warc-type"), b) for o, h, b in warc.records_in(path, lo, min(len(data), lo + size)))]
        assert cut == whole


def test_records_beside_damage_come_back(tmp_path):
    rng = random.Random(5)
    members = [warc.encode_record(i, f"u{i}", rng.randbytes(300).hex()) for i in range(5)]
    path = str(tmp_path / "f.warc.gz")
    broken = bytearray(members[2])
    broken[0] = 0  # no magic
    late = bytearray(members[2])
    late[-30] ^= 0xFF  # the checksum fails
    for third in (broken, late, members[2][:100]):
        data = b"".join([*members[:2], bytes(third), *members[3:]])
        with open(path, "wb") as f:
            f.write(data)
        for size in (50, 333, 1000, len(data)):
            got = [h["warc-target-uri"] for lo in range(0, len(data), size) for _, h, _ in warc.records_in(path, lo, min(len(data), lo + size))]
            assert got == ["u0", "u1", "u3", "u4"], (size, got)


def test_long_members_are_read_in_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ", 1000)
    rng = random.Random(8)
    members = [warc.encode_record(i, f"u{i}", rng.randbytes(n).hex()) for i, n in enumerate((10, 50_000, 3, 200_000, 20))]
    path = str(tmp_path / "f.warc.gz")
    with open(path, "wb") as f:
        f.write(b"".join(members))
    total = sum(map(len, members))
    for size in (700, 40_000, total):
        assert [h["warc-target-uri"] for lo in range(0, total, size) for _, h, _ in warc.records_in(path, lo, min(total, lo + size))] == [f"u{i}" for i in range(5)]
