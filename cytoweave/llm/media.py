"""Media columns: texts as 8-bit media in a chunk store that holds each chunk once.

A payload is cut where a rolling gear hash of its last 32 bytes has zero top
bits, so equal passages give equal chunks wherever they stand.  Chunk digests are
grouped and joined by Spark: a chunk that occurs once stays inside its payload's
store row, one that occurs more often is kept by its first payload only.  Ordered
chunk lists then rebuild each payload, and every chunk is verified on the way.

The media form of a payload is a container: a header (magic, chunk count, length
and SHA-256 of each chunk in order), then the samples, one byte each.  The header
is stored as it is and is the ordered chunk list; the samples are stored by chunks.
Reading joins the stored header with the stored chunks, and digests of the media
form are taken of these bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise
from .hashing import U, mix64

UNIT = 64
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 11, 8192
MAGIC = b"CWM1"
#: Texts that the store's compression dictionary is trained on, about, and their characters at most.
DICTIONARY_TEXTS, DICTIONARY_CHARS = 800, 20_000
_LEVEL = 6
_LAST = (1 << 63) - 1
_GEAR = (mix64(np.arange(1, 257, dtype=U)) >> U(32)).astype(np.uint32)
_BLOCK = 1 << 20


def padded(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def _cut_candidates(data: np.ndarray) -> np.ndarray:
    """Ends of all places whose gear hash has zero top bits."""
    out = []
    for at in range(0, len(data), _BLOCK):
        lead = min(at, 31)
        h = _GEAR[data[at - lead : at + _BLOCK]]
        for s in (1, 2, 4, 8, 16):  # doubling: the sum over a window of 32 bytes, each shifted by its age
            before = h[:-s] << np.uint32(s)
            h = h.copy()
            h[s:] += before
        out.append(np.flatnonzero(h[lead:] >> np.uint32(32 - MASK_BITS) == 0) + at + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cut(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    n, start, ends = len(payload), 0, []
    places = _cut_candidates(np.frombuffer(payload, np.uint8)) if n > MIN_CHUNK else np.zeros(0, np.int64)
    while n - start > MIN_CHUNK:
        k = np.searchsorted(places, start + MIN_CHUNK)
        end = min(int(places[k]) if k < len(places) else n, start + MAX_CHUNK, n)
        ends.append(end)
        start = end
    return ends + [n] if start < n else ends


def _chunks(payload: bytes) -> list[bytes]:
    ends = cut(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _given(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_d"), F.xxhash64(text).alias("_h"), text.cast("binary").alias("text"))


def _slices(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches in slices, so that what a task makes of texts never piles up."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows].reset_index(drop=True)


def _list_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _slices(batches):
        digests = [[hashlib.sha256(c).digest() for c in _chunks(padded(t))] for t in batch["text"]]
        yield pd.DataFrame({"_d": batch["_d"], "_h": batch["_h"], "digests": digests})


def _dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample; empty where there is too little."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter(F.length("text").between(1, DICTIONARY_CHARS))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 31))
    share = min(1.0, DICTIONARY_TEXTS / max(1, texts.count()))
    rows = texts.filter(place < int(share * (1 << 31))).limit(2 * DICTIONARY_TEXTS).collect()
    samples = sorted(r["text"].encode("utf-8", "surrogatepass") for r in rows)
    try:
        return zstandard.train_dictionary(1 << 17, samples).as_bytes() if len(samples) >= 100 else b""
    except zstandard.ZstdError:
        return b""


class _Codec:
    def __init__(self, dictionary: bytes):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=_LEVEL, dict_data=shared).compress
        self._unpack = zstandard.ZstdDecompressor(dict_data=shared)

    def unpack(self, packed: bytes) -> bytes:
        return self._unpack.decompress(packed)


STORE = "doc_id long, _d long, _h long, n_bytes long, header binary, shared boolean, private binary, owned array<struct<digest:binary,body:binary,n:long>>"


def write_store(docs: DataFrame, path: str) -> str:
    """Write the chunk store of all texts under ``path``.

    One row for each text: its container's header, which is the ordered chunk
    list, its private chunks as one compressed body, and the bodies of the shared chunks that it owns.  A chunk
    is shared if it occurs more than once anywhere; its owner is the first text
    by doc_id (null last) and hash.  Null text is the empty text; repeated rows
    are stored once each and share all their chunks.
    """
    spark = docs.sparkSession
    given = _given(docs)
    dictionary = spark.sparkContext.broadcast(_dictionary(docs))
    listed = given.mapInPandas(_list_chunks, "_d long, _h long, digests array<binary>").select("_d", "_h", F.posexplode("digests").alias("seq", "digest"))
    shared = listed.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("_d", "_h", "seq")).alias("owner")).filter("n > 1")
    met = join_hot(listed, materialise(shared, "shared"), ["digest"], "n")
    marks = met.groupBy("_d", "_h").agg(F.collect_set(F.struct("seq", "n", (F.struct("_d", "_h", "seq") == F.col("owner")).alias("owned"))).alias("marks"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _Codec(dictionary.value)
        for batch in _slices(batches):
            yield batch.assign(text=[codec.pack(t) for t in batch["text"]])

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _Codec(dictionary.value)
        for batch in _slices(batches):
            rows = []
            for packed, marks in zip(batch["text"], batch["marks"], strict=True):
                text = codec.unpack(packed)
                chunks = _chunks(padded(text))
                digests = [hashlib.sha256(c).digest() for c in chunks]
                seen = {m["seq"]: (m["owned"], m["n"]) for m in marks} if marks is not None else {}
                private = b"".join(c for k, c in enumerate(chunks) if k not in seen)
                owned = [{"digest": digests[k], "body": codec.pack(chunks[k]), "n": n} for k, (own, n) in sorted(seen.items()) if own]
                rows.append((len(text), header(chunks, digests), bool(seen), codec.pack(private), owned))
            made = pd.DataFrame(rows, columns=["n_bytes", "header", "shared", "private", "owned"])
            yield pd.concat([batch[["doc_id", "_d", "_h"]].astype({"doc_id": "Int64"}).reset_index(drop=True), made], axis=1)

    packed = given.mapInPandas(pack, "doc_id long, _d long, _h long, text binary")
    joined = packed.join(marks, ["_d", "_h"], "left").select("doc_id", "_d", "_h", "text", "marks")
    joined.mapInPandas(store, STORE).write.option("compression", "none").parquet(f"{path}/chunks")
    spark.createDataFrame([(bytearray(dictionary.value),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def _read(spark, path: str, schema: str, finish=None) -> DataFrame:
    """Rebuild payloads from the store; ``finish`` goes on with them in the same task."""
    store = spark.read.schema(STORE).parquet(f"{path}/chunks")
    dictionary = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"]))
    bodies = store.filter("shared").select(F.explode("owned").alias("o")).select("o.*").groupBy("digest").agg(F.first("body").alias("body"), F.max("n").alias("n"))
    entry = lambda k: F.substring("header", 13 + 36 * k, F.lit(32))
    chunks = ((F.octet_length("header") - 8) / 36).cast("int")
    listed = F.when(chunks > 0, F.transform(F.sequence(F.lit(0), chunks - 1), entry))
    wanted = store.filter("shared").select("_d", "_h", F.explode(F.array_distinct(listed)).alias("digest")).distinct()
    total = store.filter("shared").agg(F.sum(F.aggregate("owned", F.lit(0).cast("long"), lambda s, o: s + o["n"]))).first()[0] or 0
    fetched = join_hot(wanted, bodies, ["digest"], "n", total=total).groupBy("_d", "_h").agg(F.collect_list(F.struct("digest", "body")).alias("bodies"))

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _Codec(dictionary.value)
        for batch in _slices(batches):
            payloads = []
            for head, private, bodies in zip(batch["header"], batch["private"], batch["bodies"], strict=True):
                shared = {bytes(b["digest"]): b["body"] for b in bodies} if bodies is not None else {}
                own, at, parts = codec.unpack(private), 0, []
                for size, digest in chunk_list(head):
                    if digest in shared:
                        part = codec.unpack(shared[digest])
                    else:
                        part, at = own[at : at + size], at + size
                    if len(part) != size or hashlib.sha256(part).digest() != digest:
                        raise ValueError("a chunk does not match its digest")
                    parts.append(part)
                payloads.append(b"".join(parts))
            yield batch[["doc_id", "n_bytes", "header"]].assign(doc_id=batch["doc_id"].astype("Int64"), payload=payloads)

    columns = ["doc_id", "n_bytes", "header", "private"]
    alone = store.filter("not shared").select(*columns, F.lit(None).cast("array<struct<digest:binary,body:binary>>").alias("bodies"))
    sharing = store.filter("shared").join(fetched, ["_d", "_h"]).select(*columns, "bodies")
    return alone.union(sharing).mapInPandas(rebuild if finish is None else lambda batches: finish(rebuild(batches)), schema)


def read_store(spark, path: str) -> DataFrame:
    """(doc_id, n_bytes, header, payload) of each stored text, rebuilt from its header's chunk list.

    The media form is header and payload in a row.

    Each chunk's SHA-256 is verified; a missing or wrong chunk is an error.
    """
    return _read(spark, path, "doc_id long, n_bytes long, header binary, payload binary")


def store_digests(spark, path: str) -> DataFrame:
    """Digests and features of each stored text, read back as ``read_store`` does."""
    return _read(spark, path, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", _digest)


def header(chunks: list[bytes], digests: list[bytes]) -> bytes:
    """The head of a payload's container."""
    return b"".join([MAGIC, struct.pack("<I", len(chunks)), *[struct.pack("<I", len(c)) + d for c, d in zip(chunks, digests, strict=True)]])


def chunk_list(head: bytes) -> list[tuple[int, bytes]]:
    """(length, SHA-256) of each chunk of a header."""
    (n,) = struct.unpack_from("<I", head, 4)
    if head[:4] != MAGIC or len(head) != 8 + 36 * n:
        raise ValueError("no media header")
    return list(struct.iter_unpack("<I32s", head[8:]))


def feature(payload: bytes, lengths: list[int]) -> str:
    """Chunks, mean, root mean square and changes of direction of the samples, in whole thousandths."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    step = np.sign(np.diff(x))
    turns = int((step[1:] * step[:-1] < 0).sum())
    n = len(x)
    return f"chunks={len(lengths)};mean={int(x.sum()) * 1000 // n};rms={int(np.sqrt(float((x * x).sum()) / n) * 1000)};turns={turns * 1000 // n}"


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of each media form and of the payload in it, as they were read."""
    for batch in batches:
        rows = []
        for head, payload in zip(batch["header"], batch["payload"], strict=True):
            media = hashlib.sha256(head)
            media.update(payload)
            sizes = [size for size, _ in chunk_list(head)]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(head) + len(payload), media.hexdigest(), feature(payload, sizes)))
        made = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        yield pd.concat([batch[["doc_id", "n_bytes"]].astype({"doc_id": "Int64"}).reset_index(drop=True), made], axis=1)
