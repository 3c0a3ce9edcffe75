"""Hard-negative mining with segment summaries.

A vector is cut into segments; of each its mean and its deviation from it are
stored.  The inner product of two segments of length L is L times the product of
their means, plus or minus at most the product of their deviations, so the sum
over segments bounds a score from both sides.  Summaries are stored on several
levels, from one segment to many: pairs that the coarse bound can't rule out are
looked at on the next finer level, and only what is left gets its exact score.

The stated anchors meet all rows in blocks.  Rows are dealt over slices by a hash,
anchors are sent to every slice, and a task holds one slice of bounded size at a
time while anchors stream past it.  Inside a slice rows are sorted by label, so
rows of one label are a range.  Each slice answers with its best rows of every
anchor, and these meet by anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score, in hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
#: Components are whole multiples of one in SCALE.
SCALE = 256
#: Rows of a slice, about, and slices at least.
SLICE_ROWS, LEAST_SLICES = 1 << 18, 64
#: A scaled component beyond this is an error: sums of products would leave 64 bits.
LARGEST = 1 << 26
_ANCHORS, _FIRST_TILE, _TILE = 256, 256, 8192
_BEST = "array<struct<lack:bigint,id:bigint>>"
_FOUND = f"anchor_id bigint, anchor_key bigint, w int, best {_BEST}"


def levels(dims: int) -> list[int]:
    """Numbers of segments from coarse to fine: 1, 4, 16, ... while a segment has 4 components."""
    out = [1]
    while out[-1] * 16 <= dims:
        out.append(out[-1] * 4)
    return out


def summaries(v: np.ndarray) -> np.ndarray:
    """Of each vector and level: for each segment the mean times the root of its length, then the deviations."""
    out = []
    for k in levels(v.shape[1]):
        edges = np.linspace(0, v.shape[1], k + 1).astype(int)
        lengths = np.maximum(np.diff(edges), 1)
        sums = np.add.reduceat(v, edges[:-1], axis=1) if v.shape[1] else np.zeros((len(v), k))
        squares = np.add.reduceat(v * v, edges[:-1], axis=1) if v.shape[1] else np.zeros((len(v), k))
        means = sums / np.sqrt(lengths)
        out += [means, np.sqrt(np.maximum(squares - means * means, 0))]
    return np.concatenate(out, axis=1).astype(np.float32)


class Vectors:
    """Rows of one slice or of one batch of anchors: ids, labels, components, norms and summaries by level."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, dims: int):
        self.ids = rows.column("vec_id").to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column("vec_id").to_numpy()
        self.labels = np.asarray(rows.column("label").to_pylist(), np.int64)
        whole = np.frombuffer(b"".join(rows.column("v").to_pylist()), "<i4").reshape(-1, dims)
        self.norms = np.sqrt((whole.astype(np.float64) ** 2).sum(axis=1))
        self.whole = whole
        self.exact = whole.astype(np.float32)
        flat = np.frombuffer(b"".join(rows.column("s").to_pylist()), "<f4").reshape(len(whole), -1)
        self.levels, at = [], 0
        for k in levels(dims):
            self.levels.append((np.ascontiguousarray(flat[:, at : at + k]), np.ascontiguousarray(flat[:, at + k : at + 2 * k])))
            at += 2 * k


def exact_scores(a: Vectors, pick: slice | np.ndarray, b: Vectors, there: slice) -> np.ndarray:
    """All inner products of some anchors with a range of rows, exact."""
    most = float(a.norms[pick].max(initial=0)) * float(b.norms[there].max(initial=0))
    if most < 2**24:  # no sum of products leaves what 32-bit floats hold exactly
        return (a.exact[pick] @ b.exact[there].T).astype(np.int64)
    if most < 2**53:
        return (a.whole[pick].astype(np.float64) @ b.whole[there].astype(np.float64).T).astype(np.int64)
    return a.whole[pick].astype(np.int64) @ b.whole[there].astype(np.int64).T


def exact_pairs(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", a.whole[i].astype(np.int64), b.whole[j].astype(np.int64))


def _survivors(a: Vectors, pick: np.ndarray, b: Vectors, there: slice, low: np.ndarray, high: np.ndarray) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Pairs whose score may lie in low..high of their anchor: a mask, or (anchor, row) once they are few.

    ``low`` and ``high`` have one bound for each of ``pick``.  Bounds are widened by
    more than their rounding error, so no pair in the window is lost.
    """
    slack = 1 + 1e-4 * a.norms[pick].max(initial=0) * b.norms[there].max(initial=0)
    low, high = (low - slack).astype(np.float32), (high + slack).astype(np.float32)
    left: np.ndarray | None = None
    pairs = None
    for (am, ad), (bm, bd) in zip(a.levels, b.levels, strict=True):
        if pairs is None:
            middle, width = am[pick] @ bm[there].T, ad[pick] @ bd[there].T
            fits = (middle + width >= low[:, None]) & (middle - width <= high[:, None])
            left = fits if left is None else left & fits
            if np.count_nonzero(left) * 16 < left.size:
                i, j = np.nonzero(left)
                pairs = (i, j)
        else:
            i, j = pairs
            middle = np.einsum("nd,nd->n", am[pick][i], bm[there][j])
            width = np.einsum("nd,nd->n", ad[pick][i], bd[there][j])
            fits = (middle + width >= low[i]) & (middle - width <= high[i])
            pairs = (i[fits], j[fits])
    return left if pairs is None else pairs


def _best_in_windows(a: Vectors, pick: np.ndarray, low: np.ndarray, high: np.ndarray, b: Vectors, ranges: list[tuple[int, int]], k: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(anchor, window) -> scores and ids of its ``k`` best rows inside low..high, ties by id.

    ``low`` and ``high`` are int64 of shape (anchors, windows); a window without a
    score has low over high.  A window's floor rises to its k-th best score so far.
    """
    n, windows = low.shape
    floor = low.copy()
    best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    tile = _FIRST_TILE
    for start, end in ranges:
        at = start
        while at < end:
            there = slice(at, min(end, at + tile))
            at, tile = there.stop, min(_TILE, 2 * tile)
            open_ = floor <= high
            if not open_.any():
                return best
            least = np.where(open_, floor, np.iinfo(np.int64).max).min(axis=1).astype(np.float64)
            most = np.where(open_, high, np.iinfo(np.int64).min).max(axis=1).astype(np.float64)
            left = _survivors(a, pick, b, there, least, most)
            if isinstance(left, tuple):
                i, j = left
                s = exact_pairs(a, pick[i], b, there.start + j)
            else:
                scores = exact_scores(a, pick, b, there)
                i, j = np.nonzero(left & (scores >= least[:, None]) & (scores <= most[:, None]))
                s = scores[i, j]
            ids = b.ids[there.start + j]
            other = ids != a.ids[pick[i]]
            i, s, ids = i[other], s[other], ids[other]
            for w in range(windows):
                fits = (s >= floor[i, w]) & (s <= high[i, w])
                if not fits.any():
                    continue
                who, got, named = i[fits], s[fits], ids[fits]
                order = np.lexsort((named, -got, who))
                who, got, named = who[order], got[order], named[order]
                cuts = np.flatnonzero(np.diff(who, prepend=-1))
                for x, y in zip(cuts, [*cuts[1:], len(who)], strict=True):
                    q, y = int(who[x]), min(int(y), int(x) + k)
                    sc, nm = got[x:y], named[x:y]
                    if (q, w) in best:
                        sc, nm = np.concatenate([best[q, w][0], sc]), np.concatenate([best[q, w][1], nm])
                        o = np.lexsort((nm, -sc))[:k]
                        sc, nm = sc[o], nm[o]
                    best[q, w] = sc, nm
                    if len(sc) == k:
                        floor[q, w] = max(floor[q, w], sc[-1])
    return best


def _score_slices(dims: int, k: int, same: bool):
    """Fold over sorted rows: a slice's rows, by label, then the anchors that meet them."""

    def answers(a: pa.RecordBatch, b: Vectors | None) -> Iterator[pa.RecordBatch]:
        if b is None:  # no row in this slice
            return
        anchors = Vectors(a, dims)
        key = a.column("anchor_key").to_numpy(zero_copy_only=False)
        lows, highs = a.column("low").to_pylist(), a.column("high").to_pylist()
        out = []
        for label in np.unique(anchors.labels):
            x, y = (int(p) for p in np.searchsorted(b.labels, [label, label + 1]))
            ranges = [(x, y)] if same else [(0, x), (y, len(b.labels))]
            mine = np.flatnonzero(anchors.labels == label)
            for at in range(0, len(mine), _ANCHORS):
                pick = mine[at : at + _ANCHORS]
                windows = max((len(lows[i]) for i in pick), default=0)
                low, high = np.full((len(pick), windows), 1, np.int64), np.zeros((len(pick), windows), np.int64)
                for q, i in enumerate(pick):
                    low[q, : len(lows[i])], high[q, : len(highs[i])] = lows[i], highs[i]
                for (q, w), (scores, ids) in _best_in_windows(anchors, pick, low, high, b, ranges, k).items():
                    i = pick[q]
                    out.append((int(anchors.ids[i]), int(key[i]), w, [{"lack": -int(s), "id": int(n)} for s, n in zip(scores, ids, strict=True)]))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("lack", pa.int64()), ("id", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor_id", "anchor_key", "w", "best"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            slices = batch.column("slice").to_numpy(zero_copy_only=False)
            anchor = batch.column("is_anchor").to_numpy(zero_copy_only=False)
            runs = np.flatnonzero(np.diff(slices * 2 + anchor, prepend=-1))
            for x, y in zip(runs, [*runs[1:], len(slices)], strict=True):
                part = batch.slice(int(x), int(y - x))
                if slices[x] != now:
                    now, parts, block = slices[x], [], None
                if not anchor[x]:
                    parts.append(part)
                    continue
                if parts:
                    block, parts = Vectors(pa.Table.from_batches(parts), dims), []
                yield from answers(part, block)

    return fold


def prepare(rows: DataFrame, dims: int) -> DataFrame:
    """(vec_id, label, v, s): scaled whole components and segment summaries, as binary."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            v = np.zeros((len(sizes), dims))
            v[np.arange(dims)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            v = np.floor(SCALE * v)
            if np.abs(v).max(initial=0) > LARGEST:
                raise ValueError(f"a component times {SCALE} is beyond {LARGEST}")
            whole, short = v.astype("<i4"), summaries(v)
            made = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (whole, short)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *made], names=["vec_id", "label", "v", "s"])

    return rows.mapInArrow(pack, "vec_id bigint, label bigint, v binary, s binary")


def _usable(rows: DataFrame) -> DataFrame:
    """Rows that take part: an id, a label, and a vector of finite components."""
    x = F.col("embedding").cast("array<double>")
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return given.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)


def _meet(rows: DataFrame, anchors: DataFrame, slices: int, dims: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, anchor_key, w, best): each anchor's ``k`` best rows in each of its windows."""
    no_key, none = F.lit(0).cast("long"), F.expr("cast(array() as array<bigint>)")
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"), F.lit(0).alias("is_anchor"), "vec_id", "label", "v", "s", no_key.alias("anchor_key"), none.alias("low"), none.alias("high"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(1).alias("is_anchor"), "vec_id", "label", "v", "s", "anchor_key", "low", "high")
    sorted_ = dealt.union(sent).repartition("slice").sortWithinPartitions("slice", "is_anchor", "label")
    found = sorted_.mapInArrow(_score_slices(dims, k, same), _FOUND)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    return found.groupBy("anchor_id", "anchor_key", "w").agg(best.alias("best"))


def mine_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives.

    Takes ``vec_id``, ``label`` and ``embedding``; further columns are ignored.
    Scores are inner products of components floored to multiples of 1/256, as
    whole numbers; vectors shorter than the longest count as filled up with zeros.
    An anchor (a row with ``is_anchor``, a condition on vec_id and label) has as
    positives its ``positives`` best other rows of its label, and for each of them
    the ``negatives`` best rows of other labels with lowest * positive_score <=
    100 * score <= highest * positive_score; ties go by vec_id.  Rows with a null
    id, label, vector, or component that is null or not finite take no part.  A
    row with an anchor's vec_id is never its partner; otherwise repeated rows
    count as often as they stand there, and repeated anchors count once.  Anchors
    without a positive or without a negative have no row, nor has an empty table.
    """
    usable = _usable(rows)
    n, dims = usable.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    dims = max(1, dims)
    slices = max(LEAST_SLICES, math.ceil(n / SLICE_ROWS))
    packed = materialise(prepare(usable, dims), "vectors")
    key = F.xxhash64("label", "v").alias("anchor_key")
    anchors = packed.filter(is_anchor).select("*", key).dropDuplicates(["vec_id", "anchor_key"])
    everything = F.array(F.lit(-(1 << 62)).cast("long")), F.array(F.lit(1 << 62).cast("long"))
    first = _meet(packed, anchors.withColumns({"low": everything[0], "high": everything[1]}), slices, dims, positives, True)
    first = materialise(first.select("anchor_id", "anchor_key", F.col("best").alias("positives")), "positives")
    # scores are whole: 100 * s >= lowest * p is s >= ceil(lowest * p / 100)
    low = F.transform("positives", lambda p: _ceil_div(-p["lack"] * lowest))
    high = F.transform("positives", lambda p: _floor_div(-p["lack"] * highest))
    asking = anchors.join(first.hint("merge"), (F.col("vec_id") == F.col("anchor_id")) & (anchors["anchor_key"] == first["anchor_key"])).select("vec_id", "label", "v", "s", anchors["anchor_key"], low.alias("low"), high.alias("high"))
    second = _meet(packed, asking, slices, dims, negatives, False)
    met = second.join(first.hint("merge"), ["anchor_id", "anchor_key"]).select("anchor_id", F.element_at("positives", F.col("w") + 1).alias("p"), F.posexplode("best").alias("at", "n"))
    return met.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), (-F.col("p.lack")).alias("positive_score"), (-F.col("n.lack")).alias("negative_score"))


def _floor_div(x: Column) -> Column:
    """A whole number over 100, rounded down."""
    return ((x - F.pmod(x, F.lit(100))) / 100).cast("long")


def _ceil_div(x: Column) -> Column:
    return -_floor_div(-x)


#: The query: brute force over anchors and rows.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
