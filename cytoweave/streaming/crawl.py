"""Frames as they arrive to objects with labels and mothers: the whole step per series, with state of several kinds.

A series keeps a clock (last time, highest label), a list of its last frames, a map
of pair scores and a map of what is known of each label.  All of it expires when
the series has been idle for ``ttl``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import morph
from ..operators.segment import GroupParams
from ..operators.track import gaussian_score, link_frames

CRAWLED = "series long, tp int, cell int, grp int, area int, centroid_r double, centroid_c double, label long, mother long, error string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Probability of each pair from columns m_area, m_r, m_c, d_area, d_r, d_c and p_bud (the bud map's mean over the bud).
PairScore = Callable[[pd.DataFrame], np.ndarray]


def _spread(masks: np.ndarray, n: int = 1) -> np.ndarray:
    """n dilations by a cross of masks (object, r, c)."""
    for _ in range(n):
        out = masks.copy()
        out[:, 1:] |= masks[:, :-1]
        out[:, :-1] |= masks[:, 1:]
        out[:, :, 1:] |= masks[:, :, :-1]
        out[:, :, :-1] |= masks[:, :, 1:]
        masks = out
    return masks


def _shrink(masks: np.ndarray, n: int = 1) -> np.ndarray:
    """n erosions by a cross; what lies outside the frame counts as not set."""
    for _ in range(n):
        wide = np.pad(masks, ((0, 0), (1, 1), (1, 1)))
        masks = masks & wide[:, 2:, 1:-1] & wide[:, :-2, 1:-1] & wide[:, 1:-1, 2:] & wide[:, 1:-1, :-2]
    return masks


def _rims(masks: np.ndarray) -> np.ndarray:
    """Pixels with a neighbour (of eight) inside the frame that is not set."""
    wide = np.pad(masks, ((0, 0), (1, 1), (1, 1)), constant_values=True)
    inner = np.ones_like(masks)
    for dr in range(3):
        for dc in range(3):
            inner &= wide[:, dr : dr + masks.shape[1], dc : dc + masks.shape[2]]
    return masks & ~inner


def frame_objects(maps: dict[str, np.ndarray], groups: Sequence[GroupParams], containment: float) -> tuple[np.ndarray, np.ndarray]:
    """(masks, groups) of one frame's objects: the rules of ``segment.segment``, on dense maps of one shape."""
    none = np.zeros(next(iter(maps.values())).shape)
    masks, of = [], []
    for k, p in enumerate(groups):
        inside = np.max([np.maximum(maps.get(m, none), 0) for m in p.members], axis=0)
        edge = maps.get(p.edge, none) if p.edge else None
        if edge is not None:
            inside = inside * (1 - edge)
        r, c = np.nonzero(inside > (p.threshold or 0.5))
        part = morph.label_pixels(np.zeros(len(r), np.int64), r, c, p.connectivity == 2)
        found = np.zeros((int(part.max(initial=0)), *none.shape), bool)
        found[part - 1, r, c] = True
        found = _shrink(_spread(found, p.closing), p.closing)
        found = _spread(_shrink(found, p.opening), p.opening)
        found = _spread(found, p.grow)
        area = found.sum(axis=(1, 2))
        keep = (area >= p.lower) & (area > 0) & (area < (np.inf if p.upper is None else p.upper))
        if edge is not None and p.edge_min is not None:
            wide = _spread(_rims(found), 2)
            n = wide.sum(axis=(1, 2))
            keep &= (n > 0) & ((wide * edge).sum(axis=(1, 2)) > p.edge_min * np.maximum(n, 1))
        masks.append(found[keep])
        of += [k] * int(keep.sum())
    whole, of = np.concatenate(masks), np.array(of, int)
    flat = whole.reshape(len(whole), -1).astype(np.int64)
    both, area = flat @ flat.T, flat.sum(axis=1)
    gone = np.zeros(len(whole), bool)
    share = both / np.maximum(np.minimum(area[:, None], area[None, :]), 1)
    for a, b in zip(*np.nonzero((of[:, None] + 1 == of[None, :]) & (share > containment)), strict=True):
        if not gone[a] and not gone[b]:
            gone[a if area[a] < area[b] else b] = True
    return whole[~gone], of[~gone]


class Crawler(StatefulProcessor):
    """Segments, tracks and assigns mothers, frame by frame."""

    def __init__(self, groups: Sequence[GroupParams], h: int, w: int, pair_score: PairScore, bud: str, containment: float, scale: Sequence[float], depth: int, threshold: float, min_budness: float, min_lifetime: int, ttl_ms: int | None):
        self.groups, self.h, self.w, self.pair_score, self.bud, self.containment = tuple(groups), h, w, pair_score, bud, containment
        self.scale, self.depth, self.threshold = tuple(scale), depth, threshold
        self.min_budness, self.min_lifetime, self.ttl_ms = min_budness, min_lifetime, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "last int, top long", self.ttl_ms)
        self.frames = handle.getListState("frames", "labels array<bigint>, places array<double>", self.ttl_ms)
        self.pairs = handle.getMapState("pairs", "mother long, bud long", "score double", self.ttl_ms)
        self.labels = handle.getMapState("labels", "label long", "seen int, budness double, motherness double", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows))
        for tp, frame in got.groupby("tp", sort=True):
            out = self._frame(int(tp), frame)
            yield out.assign(series=key[0], tp=int(tp)).astype({"tp": "int32", "cell": "Int32", "grp": "Int32", "area": "Int32", "label": "Int64", "mother": "Int64"})[[c.split()[0] for c in CRAWLED.split(", ")]]

    def _frame(self, tp: int, frame: pd.DataFrame) -> pd.DataFrame:
        last, top = self.clock.get() if self.clock.exists() else (None, 0)
        nothing = {"cell": [None], "grp": [None], "area": [None], "centroid_r": [None], "centroid_c": [None], "label": [None], "mother": [None]}
        if last is not None and tp <= last:
            return pd.DataFrame(nothing | {"error": ["late"]})
        try:
            maps = {}
            for target, px in frame.groupby("target"):
                maps[target] = np.zeros((self.h, self.w))
                maps[target][px["r"].to_numpy(), px["c"].to_numpy()] = px["p"].to_numpy()
            masks, of = frame_objects(maps, self.groups, self.containment)
        except Exception as failure:  # one frame must not end the stream
            return pd.DataFrame(nothing | {"error": [f"{type(failure).__name__}: {failure}"[:200]]})
        area = masks.sum(axis=(1, 2))
        rows, cols = np.arange(self.h)[:, None], np.arange(self.w)[None, :]
        places = np.stack([(masks * x).sum(axis=(1, 2)) / np.maximum(area, 1) for x in (rows, cols)], axis=1) if len(masks) else np.zeros((0, 2))
        window = [(np.array(a, np.int64), np.array(b, float).reshape(-1, 2)) for a, b in self.frames.get()]
        labels, top = link_frames(window, places, gaussian_score(self.scale), int(top), self.threshold)
        self.frames.put([(a.tolist(), b.ravel().tolist()) for a, b in [*window, (labels, places)][-self.depth :]])
        self.clock.update((tp, int(top)))
        bud = maps.get(self.bud, np.zeros((self.h, self.w)))
        mothers = self._mothers(labels, area, places, (masks * bud).sum(axis=(1, 2)) / np.maximum(area, 1))
        return pd.DataFrame({"cell": np.arange(1, len(masks) + 1), "grp": of, "area": area, "centroid_r": places[:, 0], "centroid_c": places[:, 1], "label": labels, "mother": mothers, "error": None})

    def _mothers(self, labels: np.ndarray, area: np.ndarray, places: np.ndarray, p_bud: np.ndarray) -> list[int]:
        """Mothers of a frame's labels by the rules of ``track.assign_mothers``; scores go on in the state."""
        n = len(labels)
        m, d = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
        m, d = m[m != d], d[m != d]
        table = pd.DataFrame({"m_area": area[m], "m_r": places[m, 0], "m_c": places[m, 1], "d_area": area[d], "d_r": places[d, 0], "d_c": places[d, 1], "p_bud": p_bud[d]})
        p = np.asarray(self.pair_score(table), float) if len(table) else np.zeros(0)
        as_mother, as_bud = np.zeros(n), np.zeros(n)
        np.add.at(as_mother, m, p)
        np.maximum.at(as_bud, d, p)
        known = {}
        for k, label in enumerate(labels.tolist()):
            seen, budness, motherness = self.labels.getValue((label,)) or (0, 0.0, 0.0)
            known[label] = (seen + 1, max(budness, float(as_bud[k])), max(motherness, float(as_mother[k])))
            self.labels.updateValue((label,), known[label])
        for a, b, q in zip(labels[m].tolist(), labels[d].tolist(), p.tolist(), strict=True):
            old = self.pairs.getValue((a, b))
            self.pairs.updateValue((a, b), ((old[0] if old else 0.0) + q * (1 - known[b][2]),))
        best: dict[int, tuple[float, int]] = {}
        for (mother, bud), (score,) in self.pairs.iterator():
            if bud in known and score > 0:
                best[bud] = max(best.get(bud, (0.0, 0)), (score, -mother))
        ready = {x for x, (seen, budness, _) in known.items() if seen >= self.min_lifetime and budness > self.min_budness}
        return [-best[x][1] if x in ready and x in best else 0 for x in labels.tolist()]

    def close(self) -> None:
        pass


def crawl(preds: DataFrame, groups: Sequence[GroupParams], h: int, w: int, pair_score: PairScore, bud: str = "bud", containment: float = 0.8, scale: Sequence[float] = (10.0, 10.0), depth: int = 3, threshold: float = 0.5, min_budness: float = 0.5, min_lifetime: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """A stream of prediction maps (series, tp, target, r, c, p) to objects with labels and mothers.

    A frame (all maps of a series at one time) must arrive in one batch.  Objects
    are those of ``segment.segment``, labels those of ``track.track`` on centroids,
    mothers those of ``track.assign_mothers``.  A frame that is not newer than the
    last one, or that fails, keeps the state as it is and gives one row with an
    error; so a series' state depends on its good frames only.  With ``ttl_ms`` what
    a series hasn't touched for so long is dropped, and it begins anew.  State needs
    the RocksDB provider, which is set for the session.
    """
    preds.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    processor = Crawler(groups, h, w, pair_score, bud, containment, scale, depth, threshold, min_budness, min_lifetime, ttl_ms)
    given = preds.selectExpr("cast(series as long) as series", "cast(tp as int) as tp", "target", "cast(r as int) as r", "cast(c as int) as c", "cast(p as double) as p")
    return given.groupBy("series").transformWithStateInPandas(statefulProcessor=processor, outputStructType=CRAWLED, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
