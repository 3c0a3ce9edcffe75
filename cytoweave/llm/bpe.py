"""Byte-level BPE with a rank queue under a hierarchical bitmap.

The tokens of a pre-token are a linked list over its bytes.  Every neighbouring
pair that the vocabulary can merge stands in the bucket of its rank, by the place
of its left token; a bitmap of two levels tells which buckets have entries, so the
next rank is found by one find-first-set a level, however many ranks there are.  A
merge changes the pairs to its left and right: these get new entries, and entries
whose pair is gone are skipped when their bucket comes up.  A pre-token of n bytes
takes about n log n steps, so long ones are no burden.

One queue may hold many pre-tokens: their lists lie side by side with a border
between any two, and a bucket then holds the places of a rank in all of them, which
are merged at once in numpy.  So the distinct pre-tokens that a block of texts
meets for the first time take one pass over the ranks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a word of the bitmap.
_WORD = 256
_BIT = [1 << k for k in range(_WORD)]
#: Pre-tokens that a task remembers, and their bytes, before it begins anew.
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 16 << 20
#: So many pre-tokens are merged one by one.
FEW = 64
_BLOCK = 1 << 20


class RankQueue:
    """Buckets by rank, the lowest rank first.

    ``words`` have a bit for each rank, ``top`` has one for each word and is 0 once
    nothing is left.
    """

    __slots__ = ("buckets", "top", "words")

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        self.words = [0] * (ranks // _WORD + 1)
        self.top = 0

    def push(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(entry)
            return
        self.buckets[rank] = [entry]
        k = rank // _WORD
        held = self.words[k]
        self.words[k] = held | _BIT[rank % _WORD]
        if not held:
            self.top |= 1 << k

    def pop(self) -> tuple[int, list]:
        """The lowest rank and all entries of its bucket, as they came."""
        low = self.top & -self.top
        k = low.bit_length() - 1
        word = self.words[k]
        bit = word & -word
        self.words[k] = word ^ bit
        if word == bit:
            self.top ^= low
        rank = k * _WORD + bit.bit_length() - 1
        return rank, self.buckets.pop(rank)


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Token ids of one pre-token; ``queue`` is empty before and after."""
    rank_of, push, pop = ranks.get, queue.push, queue.pop
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that begins at a place; -1: none
    pair += (-1, -1)
    for i, rank in enumerate(pair):
        if rank >= 0:
            push(rank, i)
    while queue.top:
        rank, places = pop()
        places.sort()
        for at, i in enumerate(places, 1):
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            pair[j] = -1
            pair[i] = right = rank_of(piece[i : after[k]], -1) if k < n else -1
            if right >= 0:
                push(right, i)
            h, left = before[i], -1
            if h >= 0:
                pair[h] = left = rank_of(piece[h:k], -1)
                if left >= 0:
                    push(left, h)
            if 0 <= right < rank or 0 <= left < rank:  # a lower rank goes first
                for p in places[at:]:
                    push(rank, p)
                break
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Merger:
    """Merges many pre-tokens at once; the same ids as ``merge`` gives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.most = ranks, max(ranks.values(), default=0)
        self.queue = RankQueue(self.most)
        self.single = np.array([ranks.get(bytes([k]), -1) for k in range(256)], np.int64)
        found = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, made = np.array(found, np.int64).reshape(-1, 3).T
        keys = left * (self.most + 1) + right
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], np.iinfo(np.int64).max), np.append(made[order], -1)

    def _ranks(self, left, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; -1: none, or one of them is a border."""
        key = np.where((left < 0) | (right < 0), -1, left * (self.most + 1) + right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens in a row, number of each).

        A merge may make a pair of lower rank than its own, which goes before other
        merges of that rank; pre-tokens where this happens are done again, one by one.
        """
        lengths = np.array([len(p) for p in pieces], np.int64)
        piece = np.repeat(np.arange(len(pieces)), lengths)
        place = np.arange(len(piece)) + piece + 1  # place 0 and one behind each pre-token are borders
        n = len(piece) + len(pieces) + 2
        token = np.full(n, -1, np.int64)
        token[place] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.zeros(n, np.int64)
        of[place] = piece
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.append(self._ranks(token[:-1], token[1:]), -1)
        queue, again = self.queue, []
        if len(fits := np.flatnonzero(pair >= 0)):
            self._push(pair[fits], fits)
        while queue.top:
            rank, parts = queue.pop()
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            j = after[at]
            touch = at[1:] == j[:-1]
            if touch.any():  # of pairs in a row that share tokens every other one counts, from the left
                run = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.append(True, ~touch), run, 0))
                at = at[(run - first) % 2 == 0]
                j = after[at]
            k = after[j]
            next_to = k[:-1] == at[1:]
            if next_to.any():  # what the first merge makes with the second one's left token
                between = self._ranks(rank, token[at[1:]])
                again.append(of[at[1:][next_to & (between >= 0) & (between < rank)]])
            token[at], token[j], after[at], before[k], pair[j] = rank, -2, k, at, -1
            h = before[at]
            pair[at] = right = self._ranks(rank, token[k])
            pair[h] = left = self._ranks(token[h], np.full(len(h), rank))
            new = np.concatenate([right, left])
            if (fits := new >= 0).any():
                new, places = new[fits], np.concatenate([at, h])[fits]
                if (new < rank).any():
                    again.append(of[places[new < rank]])
                self._push(new, places)
        kept = np.flatnonzero(token >= 0)
        ids, counts = token[kept], np.bincount(of[kept], minlength=len(pieces))
        if any(map(len, again)):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for p in np.unique(np.concatenate(again)).tolist():
                parts[p] = np.array(merge(pieces[p], self.ranks, self.queue), np.int64)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids.astype(np.int32), counts

    def _push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Places into the buckets of their ranks, in order and once each."""
        order = np.lexsort((places, ranks))
        ranks, places = ranks[order], places[order]
        once = np.append(True, (ranks[1:] != ranks[:-1]) | (places[1:] != places[:-1]))
        ranks, places = ranks[once], places[once]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()]
        for rank, a, b in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(ranks)], strict=True):
            self.queue.push(rank, places[a:b])


class _Known(dict):
    """Numbers of pre-tokens; those that were not met before wait in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, match: str) -> int:
        number = self[match] = len(self)
        self.fresh.append(match)
        return number


class Tokenizer:
    """Encodes and decodes by a rank table; each match of the pattern on its own, no special tokens.

    Pre-tokens are numbered, and the ids of those that were met are remembered
    side by side, until they are REMEMBERED many or REMEMBERED_BYTES long.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._pattern, self._ranks, self._merger = regex.compile(pattern), ranks, Merger(ranks)
        self._tokens = {v: k for k, v in ranks.items()}
        self._forget()

    def _forget(self) -> None:
        self._known, self._bytes = _Known(), 0
        self._ids, self._starts, self._counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Ids of all pre-tokens that were met for the first time."""
        fresh, self._known.fresh = [m.encode("utf-8", "surrogatepass") for m in self._known.fresh], []
        if not fresh:
            return
        self._bytes += sum(map(len, fresh))
        whole = np.fromiter((self._ranks.get(piece, -1) for piece in fresh), np.int32, len(fresh))
        rest = np.flatnonzero(whole < 0)
        pieces = [fresh[k] for k in rest]
        if len(rest) < FEW:
            made = [merge(piece, self._ranks, self._merger.queue) for piece in pieces]
            ids, sizes = np.array([i for m in made for i in m], np.int32), np.array([len(m) for m in made], np.int64)
        else:
            ids, sizes = self._merger.merge_all(pieces)
        counts = np.ones(len(fresh), np.int64)
        counts[rest] = sizes
        owner = np.concatenate([np.flatnonzero(whole >= 0), np.repeat(rest, sizes)])
        ids = np.concatenate([whole[whole >= 0], ids])[np.argsort(owner, kind="stable")]
        starts = np.cumsum(counts) - counts + len(self._ids)
        self._ids = np.concatenate([self._ids, ids.astype(np.int32)])
        self._starts, self._counts = np.append(self._starts, starts), np.append(self._counts, counts)

    def _numbers(self, text: str) -> np.ndarray:
        if len(text) <= _BLOCK:
            found = self._pattern.findall(text)
        else:  # one match at a time: the matches of a long text are not all held
            found = (m.group() for m in self._pattern.finditer(text))
        return np.fromiter(map(self._known.__getitem__, found), np.int32)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, a block of texts at a time."""
        at = 0
        while at < len(texts):
            if len(self._known) > REMEMBERED or self._bytes > REMEMBERED_BYTES:
                self._forget()
            block, size = [], 0
            while at < len(texts) and size < _BLOCK * 4:  # a block of texts, so that what is held stays small
                block.append(self._numbers(texts[at]))
                size, at = size + len(texts[at]), at + 1
            self._learn()
            for numbers in block:
                counts = self._counts[numbers]
                place = np.repeat(self._starts[numbers] - np.cumsum(counts) + counts, counts)
                yield self._ids[place + np.arange(len(place))]

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._tokens.__getitem__, ids.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


_tokenizers: dict[tuple[int, str], Tokenizer] = {}


def _tokenizer(shared: Broadcast, pattern: str) -> Tokenizer:
    """One tokenizer for each Python worker."""
    key = shared._jid if hasattr(shared, "_jid") else id(shared), pattern
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(shared.value, pattern)
    return _tokenizers[key]


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank table for all tasks: a vocabulary's size, whatever the corpus."""
    return spark.sparkContext.broadcast(read_ranks(path))


def _column(fn, kind: str):
    """A scalar function of one column of batches."""
    fn.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(fn, kind)


def encode(docs: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """All columns of ``docs`` and ``ids``, the token ids of its whole text.

    Null text is the empty text and has no ids; repeated rows get equal ids; a
    column named ids is replaced; an empty table gives no rows.
    """

    def ids(column):
        tokenizer = _tokenizer(ranks, pattern)
        return pd.Series(list(tokenizer.encode_all(column.tolist())), dtype=object)

    # called nondeterministic, so that Spark doesn't encode anew for each use of the ids
    made = _column(ids, "array<int>").asNondeterministic()
    return docs.withColumn("ids", made(F.coalesce(docs["text"].cast("string"), F.lit(""))))


def decode(tokens: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """All columns of ``tokens`` and ``decoded``, the bytes of its ``ids`` (null: null)."""

    def back(column):
        tokenizer = _tokenizer(ranks, pattern)
        return pd.Series([None if x is None else tokenizer.decode(x) for x in column], dtype=object)

    return tokens.withColumn("decoded", _column(back, "binary")("ids"))


def token_digests(docs: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers) and decoded_sha256 of each text.

    Texts are encoded and their ids decoded as ``encode`` and ``decode`` do, in one
    Python process for each task, which hands on nothing but the digests.
    """

    def digests(column):
        tokenizer = _tokenizer(ranks, pattern)
        rows = []
        for ids in tokenizer.encode_all(column.tolist()):
            rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    digests.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
    made = F.pandas_udf(digests, "n_tokens long, ids_sha256 string, decoded_sha256 string").asNondeterministic()
    return docs.select("doc_id", made(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("d")).select("doc_id", "d.*")
