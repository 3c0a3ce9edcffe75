"""Byte-level BPE against an independent implementation, and round trips."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cytoweave.llm import bpe
from cytoweave.llm import queries as llm

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def other(ranks):
    return tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own(ranks):
    return bpe.Tokenizer(ranks, public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["aaaa", " the", "ing", "'ll", "  ", "\n\n", "é", "日本語", "😀", "0123", "==", "\x00", "İ", "<|endoftext|>"]), max_size=30).map("".join)))
def test_matches_the_other_encoder(text, own, other):
    ids = own.encode(text).tolist()
    assert ids == other.encode_ordinary(text)
    assert own.decode(np.array(ids, int)).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70_000), st.integers(0, 50)), max_size=200), st.integers(1, 6))
def test_queue_gives_the_lowest_rank_and_its_bucket(entries, every):
    queue, held = bpe.RankQueue(70_001), []
    for k, entry in enumerate([*entries, *[None] * (len(entries) + 1)]):
        if entry:
            queue.push(*entry)
            held.append(entry)
        if held and (not entry or k % every == 0):
            rank = min(held)[0]
            assert queue.pop() == (rank, [p for r, p in held if r == rank])
            held = [x for x in held if x[0] != rank]
    assert not queue.top and not any(queue.words) and not queue.buckets


def test_odd_vocabularies_take_the_leftmost_of_equal_ranks():
    ranks = {bytes([k]): k for k in range(256)} | {b"aa": 300, b"aaa": 290, b"ab": 400, b"bab": 280}
    def plain(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng, queue, merger = random.Random(4), bpe.RankQueue(401), bpe.Merger(ranks)
    pieces = [bytes(rng.choice(b"aab") for _ in range(rng.randint(1, 14))) for _ in range(500)]
    pieces = [p for p in pieces if p not in ranks]
    assert [bpe.merge(p, ranks, queue) for p in pieces] == list(map(plain, pieces))
    ids, counts = merger.merge_all(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == list(map(plain, pieces))


def test_many_pretokens_at_once(ranks, other, monkeypatch):
    monkeypatch.setattr(bpe, "FEW", 0)
    monkeypatch.setattr(bpe, "REMEMBERED", 500)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["an", "the", "er", " ", " ", "\n", "ß", "é", "1", "!", "aaaa", "日", "x" * 70]) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    monkeypatch.setattr(bpe, "_BLOCK", 100)
    tokenizer = bpe.Tokenizer(ranks, public_tokenizers.PATTERN)
    for _ in range(2):
        assert [x.tolist() for x in tokenizer.encode_all(texts)] == [other.encode_ordinary(t) for t in texts]


def test_very_long_pretokens(own, other):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdeéintr") for _ in range(300_000))
    start = time.perf_counter()
    ids = own.encode(long)
    assert time.perf_counter() - start < 30
    assert own.decode(ids).decode() == long
    for text in (long[:30_000], "a" * 20_001, " " * 5_000 + "x", "=" * 7_777):
        assert own.encode(text).tolist() == other.encode_ordinary(text)


def test_table_of_texts(spark, other):
    texts = [None, "", " ", "Hello world", "Hello world", "x" * 100_000, "a b " * 400_000, "İstanbul\r\n\t naïve 123"]
    docs = spark.createDataFrame([(k if k else None, t, "own") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    shared = bpe.share_ranks(spark, PATH)
    got = bpe.token_digests(docs, shared, public_tokenizers.PATTERN)
    both = bpe.decode(bpe.encode(docs, shared, public_tokenizers.PATTERN), shared, public_tokenizers.PATTERN).collect()
    assert sorted((x.ids, bytes(x.decoded)) for x in both) == sorted((other.encode_ordinary(t or ""), (t or "").encode()) for t in texts)

    def want(text):
        ids = other.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(map(want, texts))
    assert bpe.token_digests(docs.filter("false"), shared, public_tokenizers.PATTERN).count() == 0


def test_query_matches_the_other_encoder(spark, other):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        ids = other.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert set(map(tuple, llm.queries()["op13_byte_bpe"](spark, sf).collect())) == want
