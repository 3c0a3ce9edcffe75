"""Pairs of objects that meet in places of one table, counted from packed runs of pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import starts
from .tables import stored

#: Meetings or pairs that a task sorts at once.
CHUNK = 4_000_000
#: Rows of an Arrow batch of results.
OUT = 65_536
WHOLE = ("tinyint", "smallint", "int", "bigint")


def countable(rows: DataFrame, key: Sequence[str]) -> bool:
    """Whether objects are told by whole numbers, as packed runs need."""
    kinds = dict(rows.dtypes)
    return all(kinds[c] in WHOLE for c in (*key, "cell"))


def counted(rows: DataFrame, place: Sequence[str], key: Sequence[str], block: int, meetings: int) -> DataFrame:
    """(key, ta, tb, n, area_a, area_b) of a table with itself, ta < tb.

    The objects of a place are sorted lists of at most ``block``, each object with its
    area.  A task expands lists, and pairs of lists of one place, to their pairs,
    counts equal ones at once and sends them on as sorted runs, packed: steps from pair
    to pair take a byte or two, and areas come along, so pairs are never shuffled as rows.
    All runs of a first object meet in one task, which keeps its different pairs; there
    is a task for each so many ``meetings``.
    """
    on, kinds = [*key, *place], dict(rows.dtypes)
    sized = rows.select(*on, "cell", F.count("*").over(Window.partitionBy(*key, "cell")).alias("_area")).dropna(subset=[*on, "cell"])
    number = F.row_number().over(Window.partitionBy(*on).orderBy("cell"))
    ranked = sized.withColumn("_block", F.floor((number - 1) / block).cast("int"))
    lists = ranked.groupBy(*on, "_block").agg(F.sort_array(F.collect_list(F.struct("cell", "_area"))).alias("_l"))
    lists = stored(lists.select(*on, "_block", F.col("_l.cell").alias("_low"), F.col("_l._area").alias("_low_area")))
    size = F.size("_low").cast("long")
    told = lists.agg(F.sum(size * (size - 1) / 2 + size * F.col("_block") * block).alias("meetings"), F.max("_block").alias("last")).first()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil((told["meetings"] or 0) / meetings))
    own, high = lists.filter(size > 1), lists.select(*on, F.col("_block").alias("_later"), F.col("_low").alias("_high"), F.col("_low_area").alias("_high_area"))
    met = own.select(*key, "_low", "_low_area", F.lit(None).cast(high.schema["_high"].dataType).alias("_high"), F.lit(None).cast(high.schema["_high_area"].dataType).alias("_high_area"))
    if told["last"]:  # places of several lists
        later = high.filter("_later > 0").withColumn("_block", F.explode(F.expr("sequence(0, _later - 1)")))
        met = met.union(later.join(lists, [*on, "_block"]).select(*met.columns))
    dealt = met.mapInArrow(_pack_runs(len(key), tasks, CHUNK), "bucket int, run binary").repartitionById(tasks, "bucket")
    names = [*key, "ta", "tb", "n", "area_a", "area_b"]
    found = dealt.select("run").mapInArrow(_count_runs(len(key), CHUNK), ", ".join(f"`{c}` long" for c in names))
    kinds |= {"ta": kinds["cell"], "tb": kinds["cell"]}
    return found.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names[: len(key) + 2]], "n", "area_a", "area_b")


def _pack_runs(keys: int, tasks: int, chunk: int):
    """Rows (keys, _low, _low_area, _high, _high_area) to (bucket, run); without _high the pairs lie inside _low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            n, m = (batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_low", "_high"))
            ends, at = np.cumsum([0, *np.where(m > 0, n * m, n * (n - 1) // 2)]), 0
            while at < batch.num_rows:  # rows with about a chunk of pairs
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + chunk - held, side="right")) - 1)
                kept.append(_elements(batch.slice(at, to - at), keys))
                held += int(ends[to] - ends[at])
                at = to
                if held >= chunk:
                    yield _runs(*_pairs(kept), tasks)
                    kept, held = [], 0
        if held:
            yield _runs(*_pairs(kept), tasks)

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of some lists, and the length of each; null counts as empty."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _elements(batch: pa.RecordBatch, keys: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Where the partners of each listed object begin, how many they are, and (keys, cell, area) of all listed objects."""
    (low, n), (area, _) = _flat(batch.column("_low")), _flat(batch.column("_low_area"))
    (high, m), (high_area, _) = _flat(batch.column("_high")), _flat(batch.column("_high_area"))
    inside = batch.column("_high").is_null().to_numpy(zero_copy_only=False)
    at = np.arange(len(low))
    end, of = np.repeat(np.cumsum(n), n), np.repeat(inside, n)
    first = np.where(of, at + 1, len(low) + np.repeat(np.cumsum(m) - m, n))
    count = np.where(of, end - at - 1, np.repeat(m, n))
    told = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)]
    table = [np.concatenate([np.repeat(k, n), np.repeat(k, m)]) for k in told] + [np.concatenate([low, high]), np.concatenate([area, high_area])]
    return first, np.concatenate([count, np.zeros(len(high), np.int64)]), table


def _pairs(kept: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Places in the table of both objects of each pair, and the table."""
    sizes = np.cumsum([0, *(len(count) for _, count, _ in kept)])
    first = np.concatenate([np.pad(f, (0, len(c) - len(f))) + s for (f, c, _), s in zip(kept, sizes, strict=False)])
    n = np.concatenate([c for _, c, _ in kept])
    other = np.arange(int(n.sum()))
    other += np.repeat(first - np.cumsum(n) + n, n)
    return np.repeat(np.arange(len(n)), n), other, [np.concatenate(x) for x in zip(*(t for _, _, t in kept), strict=True)]


def _runs(one: np.ndarray, other: np.ndarray, table: list[np.ndarray], tasks: int) -> pa.RecordBatch:
    """(bucket, run) of each bucket with pairs: different pairs in order, with counts."""
    order = np.lexsort(table[-2::-1])
    begins = starts(*(c[order] for c in table[:-1]))
    rank, size = np.empty(len(order), np.int64), len(begins)
    rank[order] = np.repeat(np.arange(size), np.diff(np.append(begins, len(order))))
    objects = [c[order[begins]] for c in table]
    mixed = np.zeros(size, np.uint64)
    for c in objects[:-1]:
        mixed = (mixed ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    bucket = (mixed % np.uint64(tasks)).astype(np.int64)
    dealt = np.argsort(bucket, kind="stable")
    place = np.empty(size, np.int64)
    place[dealt] = np.arange(size)
    code, other = place[rank[one]], rank[other]  # first objects by bucket
    apart = dealt[code] != other
    if not apart.all():  # an object twice in a place
        code, other = code[apart], other[apart]
    code *= size
    code += other
    del one, other, apart
    code.sort()
    fresh = starts(code)
    n, code = np.diff(np.append(fresh, len(code))), code[fresh]
    to, codec = starts(bucket[dealt]), pa.Codec("zstd", compression_level=1)
    cuts = np.searchsorted(code, np.append(to, size) * size)
    found, packed = [], []
    for k, i, j in zip(bucket[dealt[to]], cuts, cuts[1:], strict=False):
        if i < j:
            a, b = dealt[code[i:j] // size], code[i:j] % size
            found.append(k)
            packed.append(pack([*(c[a] for c in objects[:-1]), objects[-2][b], n[i:j], objects[-1][a], objects[-1][b]], len(table), codec))
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "run"])


def pack(columns: list[np.ndarray], steps: int, codec: pa.Codec) -> bytes:
    """Columns of whole numbers as bytes, the first ``steps`` as steps from row to row, low bytes first and each byte's place by itself."""
    widths, planes = [], []
    for k, c in enumerate(columns):
        c = c.astype(np.int64)
        if k < steps:
            c = np.diff(c, prepend=np.int64(0))
        c = ((c << 1) ^ (c >> 63)).astype("<u8")
        widths.append((int(c.max()).bit_length() + 7) // 8)
        planes.append(c.view(np.uint8).reshape(-1, 8)[:, : widths[-1]].T.tobytes())
    return len(columns[0]).to_bytes(8, "little") + bytes(widths) + codec.compress(b"".join(planes), asbytes=True)


def unpack(run: bytes, columns: int, steps: int, codec: pa.Codec) -> list[np.ndarray]:
    n, widths = int.from_bytes(run[:8], "little"), list(run[8 : 8 + columns])
    planes, at, out = np.frombuffer(codec.decompress(run[8 + columns :], n * sum(widths), asbytes=True), np.uint8), 0, []
    for k, wide in enumerate(widths):
        c = np.zeros((n, 8), np.uint8)
        c[:, :wide] = planes[at : at + n * wide].reshape(wide, n).T
        at += n * wide
        c = c.view("<u8").reshape(n)
        c = (c >> np.uint64(1)).astype(np.int64) ^ -(c & np.uint64(1)).astype(np.int64)
        out.append(np.cumsum(c) if k < steps else c)
    return out


def _summed(parts: list[list[np.ndarray]], steps: int) -> list[np.ndarray]:
    """Different pairs in order, with the sum of their counts; the parts are used up."""
    columns = []
    for _ in range(len(parts[0])):
        columns.append(np.concatenate([x.pop(0) for x in parts]))
    code, room = np.zeros(len(columns[0]), np.int64), 1
    for c in columns[:steps]:
        low, wide = int(c.min()), int(c.max()) - int(c.min()) + 1
        room *= wide
        if room < 1 << 62:
            code *= wide
            code += c - low
    order = np.argsort(code) if room < 1 << 62 else np.lexsort(columns[:steps][::-1])
    del code
    for k in range(len(columns)):
        columns[k] = columns[k][order]
    fresh = starts(*columns[:steps])
    return [np.add.reduceat(c, fresh) if k == steps else c[fresh] for k, c in enumerate(columns)]


def _count_runs(keys: int, chunk: int):
    """Runs of a task's pairs to rows (keys, ta, tb, n, area_a, area_b)."""
    steps = keys + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, parts, held, room = pa.Codec("zstd"), [], 0, chunk
        for batch in batches:
            for packed in batch.column(0):
                parts.append(unpack(packed.as_py(), steps + 3, steps, codec))
                held += len(parts[-1][0])
                if held >= room:
                    parts = [_summed(parts, steps)]
                    held = len(parts[0][0])
                    room = max(chunk, 2 * held)
        if parts:
            columns = _summed(parts, steps)
            parts = []
            for k in range(0, len(columns[0]), OUT):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + OUT]) for c in columns], names=[str(x) for x in range(len(columns))])

    return run
