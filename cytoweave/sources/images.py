"""Tiled images as files: scan, metadata scan, sink, pairing and raw frames."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(_SIGNATURE)
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def read_description(data: bytes) -> dict:
    """The JSON in the PNG's Description text, without unpacking pixels."""
    for kind, body in _chunks(data):
        if kind == b"tEXt" and body.startswith(b"Description\0"):
            return json.loads(body[12:].decode("latin-1"))
    return {}


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a grey PNG of 8 or 16 bits, not interlaced."""
    parts, w, h, depth = [], 0, 0, 8
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if colour != 0 or interlace or depth not in (8, 16):
                raise ValueError("only grey images of 8 or 16 bits are read")
        elif kind == b"IDAT":
            parts.append(body)
    step = depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.int32)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            line = (line + above) & 255
        elif kind in (1, 3, 4):
            for x in range(w * step):
                a = line[x - step] if x >= step else 0
                b, c = above[x], above[x - step] if x >= step else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        out[y], above = line, line
    return out.astype(np.uint8) if step == 1 else out.view(">u2").astype(np.uint16).reshape(h, w)


def encode_png(img: np.ndarray, info: dict) -> bytes:
    """A grey PNG of a uint8 or uint16 image with a JSON Description."""
    h, w = img.shape
    depth = 16 if img.dtype == np.uint16 else 8
    body = img.astype(">u2" if depth == 16 else np.uint8).tobytes()
    row = w * depth // 8
    raw = b"".join(b"\0" + body[y * row : (y + 1) * row] for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    text = b"Description\0" + json.dumps(info).encode("latin-1", "replace")
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 0, 0, 0, 0)) + chunk(b"tEXt", text) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def layout(n: int) -> tuple[int, int]:
    """Rows and columns of the grid that n tiles are laid in."""
    rows = max(1, int(np.floor(np.sqrt(n))))
    return rows, max(1, -(-n // rows))


def lay_tiles(tiles: np.ndarray, fill: int = 0, grid: tuple[int, int] | None = None) -> np.ndarray:
    """Tiles (h, w, n) laid row by row; the last row may be short."""
    h, w, n = tiles.shape
    rows, cols = grid or layout(n)
    out = np.full((rows * h, cols * w), fill, tiles.dtype)
    for k in range(n):
        out[k // cols * h : (k // cols + 1) * h, k % cols * w : (k % cols + 1) * w] = tiles[:, :, k]
    return out


def scan_metadata(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(path, description): JSON of each file, as text for from_json."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "description": [json.dumps(read_description(c)) for c in b["content"]]})

    return _files(spark, path, glob).mapInPandas(read, "path string, description string")


def scan_tiles(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(path, tile, r, c, v): one row for each pixel of each tile; a file that fails has one row with an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                try:
                    img, info = decode_png(content), read_description(content)
                    th, tw = info.get("tilesize", img.shape)
                    n, cols = info.get("ntiles", 1), img.shape[1] // tw
                    r, c = np.divmod(np.arange(img.size), img.shape[1])
                    tile = r // th * cols + c // tw
                    keep = tile < n
                    yield pd.DataFrame({"path": file, "tile": tile[keep].astype(np.int32), "r": (r % th)[keep].astype(np.int32), "c": (c % tw)[keep].astype(np.int32), "v": img.ravel()[keep].astype(np.int32), "error": None})
                except Exception as x:  # a broken file is a row of its own, not the end of the job
                    yield pd.DataFrame({"path": [file], "tile": [-1], "r": [0], "c": [0], "v": [0], "error": [str(x)]})

    return _files(spark, path, glob).mapInPandas(read, "path string, tile int, r int, c int, v int, error string")


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def encode_tiles(px: DataFrame, bits: int = 16, fill: int = 0) -> DataFrame:
    """(frame_id, content): each frame's tiles (frame_id, tile, r, c, v) as one PNG."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1, int(pdf["tile"].max()) + 1)
        t = np.full(shape, fill, np.uint16 if bits == 16 else np.uint8)
        t[pdf["r"], pdf["c"], pdf["tile"]] = pdf["v"]
        info = {"tilesize": list(shape[:2]), "ntiles": shape[2], "layout": list(layout(shape[2]))}
        return pd.DataFrame({"frame_id": [pdf["frame_id"].iloc[0]], "content": [encode_png(lay_tiles(t, fill), info)]})

    return px.groupBy("frame_id").applyInPandas(encode, "frame_id long, content binary")


def write_tiles(px: DataFrame, folder: str, bits: int = 16, fill: int = 0) -> DataFrame:
    """Write each frame as ``<frame_id>.png`` under ``folder``: (frame_id, path, size) of the files.

    The folder is any place that executors share.  A task that runs again writes
    the same bytes under the same name.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            paths = [f"{root}/{k}.png" for k in b["frame_id"]]
            for path, content in zip(paths, b["content"], strict=True):
                with store.open_output_stream(path) as out:
                    out.write(content)
            yield pd.DataFrame({"frame_id": b["frame_id"], "path": paths, "size": [len(c) for c in b["content"]]})

    return encode_tiles(px, bits, fill).mapInPandas(write, "frame_id long, path string, size long")


def pair_files(files: DataFrame, kinds: Sequence[str], strict: bool = True) -> DataFrame:
    """(prefix, <kind>...): files named prefix_kind.png side by side.

    ``strict``: a prefix that lacks a kind is an error; else only prefixes with
    exactly one file of each kind are kept.
    """
    pattern = f"(?i)^(.*)_({'|'.join(kinds)})\\.png$"
    named = files.select("path", F.regexp_extract("path", pattern, 1).alias("prefix"), F.lower(F.regexp_extract("path", pattern, 2)).alias("kind")).filter("kind <> ''")
    table = named.groupBy("prefix").agg(*[F.collect_list(F.when(F.col("kind") == k.lower(), F.col("path"))).alias(k) for k in kinds])
    whole = " and ".join(f"size(`{k}`) = 1" for k in kinds)
    if strict:
        table = table.withColumn("prefix", F.when(F.expr(whole), F.col("prefix")).otherwise(F.raise_error(F.concat(F.lit("no full set of files for "), "prefix"))))
    else:
        table = table.filter(whole)
    return table.select("prefix", *[F.col(k)[0].alias(k) for k in kinds])


def new_pairs(found: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose prefix is not known yet."""
    return found.join(known.select("prefix"), "prefix", "left_anti")


def frames_from_bytes(messages: DataFrame) -> DataFrame:
    """(frame_id, z, r, c, v, error) from raw bytes in column-major order with dims n, w, h, z and bits.

    A message whose size does not fit its dims gives one row with an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b.itertuples(index=False):
                dims = (m.n, m.w, m.h, m.z)
                if len(m.content) != int(np.prod(dims)) * m.bits // 8:
                    yield pd.DataFrame({"message": [m.message], "n": [-1], "z": [0], "r": [0], "c": [0], "v": [0], "error": ["size"]})
                    continue
                img = np.frombuffer(m.content, np.uint8 if m.bits == 8 else "<u2").reshape(dims, order="F")
                n, c, r, z = np.indices(dims)
                yield pd.DataFrame({"message": m.message, "n": n.ravel(), "z": z.ravel(), "r": r.ravel(), "c": c.ravel(), "v": img.ravel().astype(np.int32), "error": None})

    return messages.select("message", "content", "n", "w", "h", "z", "bits").mapInPandas(read, "message long, n int, z int, r int, c int, v int, error string")
