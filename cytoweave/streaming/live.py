"""Incremental segmentation and tracking with state for each series, and event-time activity windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import fold, morph
from ..operators.track import Score, gaussian_score, link_frames

OUTPUT = "series long, tp int, cell int, label int, error string"
PIXELS = "series long, tp int, cell int, r int, c int, label int, error string"
STATE = "state string"


@dataclass
class SeriesState:
    """What a series carries on: its last time, highest label and last frames (labels and features)."""

    last: int | None = None
    top: int = 0
    window: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps([self.last, int(self.top), [[a.tolist(), b.tolist()] for a, b in self.window]])

    @classmethod
    def load(cls, text: str | None) -> SeriesState:
        if not text:
            return cls()
        last, top, window = json.loads(text)
        return cls(last, top, [(np.array(a, np.int64), np.array(b, float)) for a, b in window])

    def advance(self, tp: int, now: np.ndarray, score: Score, depth: int, threshold: float, keep: bool) -> tuple[list | None, str | None]:
        """(labels, error) of the next frame's objects; a failing or late frame leaves the state as it is.

        A late frame has no labels; the objects of a failing one are numbered from 1.
        """
        if self.last is not None and tp <= self.last:
            return None, "late"
        try:
            if not np.isfinite(now).all():
                raise ValueError("a feature is no finite number")
            labels, top = link_frames(self.window[-depth:], now, score, self.top, threshold)
        except Exception as failure:  # one frame must not end the stream
            return list(range(1, len(now) + 1)), f"{type(failure).__name__}: {failure}"[:200]
        window = [*self.window, (labels, now)]
        self.last, self.top, self.window = tp, top, window if keep else window[-depth:]
        return labels.tolist(), None


def _stateful(rows: DataFrame, start: DataFrame | None, per_frame: Callable[[SeriesState, int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``per_frame`` over the frames of each series as they arrive, with its state.

    ``start`` (series, state) gives states to begin with where a series has none yet.
    """
    given = rows.withColumn("_start", F.lit(None).cast("string")) if start is None else rows.join(start.select("series", F.col("state").alias("_start")), "series", "left")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        now = SeriesState.load(state.get[0] if state.exists else next(iter(pdf["_start"].dropna()), None))
        out = [per_frame(now, int(tp), frame.drop(columns="_start")) for tp, frame in pdf.groupby("tp", sort=True)]
        state.update((now.dump(),))
        for x in out:
            yield x.assign(series=key[0]).astype({"label": "Int32"})[[c.split()[0] for c in schema.split(", ")]]

    return given.groupBy("series").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def _track_frame(features: Sequence[str], scale: Sequence[float], depth: int, threshold: float, keep: bool) -> Callable[[SeriesState, int, pd.DataFrame], pd.DataFrame]:
    score, names = gaussian_score(scale), list(features)

    def frame_of(state: SeriesState, tp: int, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cell")
        labels, error = state.advance(tp, frame[names].to_numpy(float), score, depth, threshold, keep)
        return pd.DataFrame({"tp": tp, "cell": frame["cell"].to_numpy(), "label": labels, "error": error})

    return frame_of


def track_stream(objects: DataFrame, features: Sequence[str] = ("x", "y"), scale: Sequence[float] = (50.0, 20000.0), depth: int = 3, threshold: float = 0.5, keep_full_state: bool = False, start: DataFrame | None = None) -> DataFrame:
    """Labels of objects as frames arrive: the same links as the batch operator gives.

    A frame (all objects of a series at one time) must arrive in one batch.  Its
    objects are linked to the state's last ``depth`` frames.  A frame that is not
    newer than the last one keeps the state as it is and comes out with label null
    and an error, for a side output; so does a frame that fails, with its objects
    numbered from 1.  ``start`` resumes from states that ``track_with_states`` gave.
    """
    return _stateful(objects, start, _track_frame(features, scale, depth, threshold, keep_full_state), OUTPUT)


def segment_and_track_stream(px: DataFrame, cut: float = 0.5, least: int = 1, scale: Sequence[float] = (10.0, 10.0), depth: int = 3, threshold: float = 0.5, start: DataFrame | None = None) -> DataFrame:
    """Pixels (series, tp, r, c, v) as they arrive to labelled objects, one row for each pixel of an object.

    Pixels above ``cut`` make components of at least ``least`` pixels, which are
    tracked by their centroids.  Late and failing frames as in ``track_stream``.
    """
    score = gaussian_score(scale)

    def frame_of(state: SeriesState, tp: int, frame: pd.DataFrame) -> pd.DataFrame:
        inside = frame[frame["v"] > cut].sort_values(["r", "c"]).drop_duplicates(["r", "c"])
        cell = morph.label_pixels(np.zeros(len(inside), np.int64), inside["r"].to_numpy(), inside["c"].to_numpy(), True)
        inside = inside.assign(cell=cell)
        inside = inside[inside.groupby("cell")["r"].transform("size") >= least]
        objects = inside.groupby("cell")[["r", "c"]].mean()
        labels, error = state.advance(tp, objects.to_numpy(float).reshape(-1, 2), score, depth, threshold, False)
        by_cell = dict(zip(objects.index, labels or [None] * len(objects), strict=True))
        out = inside[["cell", "r", "c"]].assign(tp=tp, error=error)
        return out.assign(label=[by_cell[k] for k in out["cell"]])

    return _stateful(px, start, frame_of, PIXELS)


def track_with_states(objects: DataFrame, features: Sequence[str] = ("x", "y"), scale: Sequence[float] = (50.0, 20000.0), depth: int = 3, threshold: float = 0.5, start: DataFrame | None = None) -> DataFrame:
    """The batch form: (series, tp, cell, label, error) of all frames, and a last row for each series whose ``state`` to resume from is set.

    ``start`` (series, state) continues earlier runs.
    """
    frame_of, names = _track_frame(features, scale, depth, threshold, False), ["tp", "cell", "label", "error"]
    rows = objects.select(F.col("series").cast("long").alias("series"), F.col("tp").cast("int").alias("tp"), F.col("cell").cast("int").alias("cell"), *features)
    given = rows.withColumn("_start", F.lit(None).cast("string")) if start is None else rows.join(start.select("series", F.col("state").alias("_start")), "series", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for series, part in pdf.groupby("series", sort=False):
            state = SeriesState.load(next(iter(part["_start"].dropna()), None))
            out += [frame_of(state, int(tp), frame)[names].assign(series=series, state=None) for tp, frame in part.groupby("tp", sort=True)]
            out.append(pd.DataFrame({"series": [series], "tp": [None], "cell": [None], "label": [None], "error": [None], "state": [state.dump()]}))
        return pd.concat([x.astype({"tp": "Int32", "cell": "Int32", "label": "Int32"}) for x in out])[["series", *names, "state"]]

    return fold.in_groups(given, ["series"], ["tp", "cell"], run, f"{OUTPUT}, state string")


def activity(events: DataFrame, width: str = "1 day", delay: str | None = None) -> DataFrame:
    """Events and mean value of each series in tumbling windows; ``delay`` sets a watermark on streams."""
    e = events.withWatermark("ts", delay) if delay else events
    return e.groupBy(F.window("ts", width), "series").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("series", F.col("window.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str | None = None) -> DataFrame:
    """Spans of activity of each series; a gap ends a span."""
    e = events.withWatermark("ts", delay) if delay else events
    return e.groupBy(F.session_window("ts", gap), "series").agg(F.count("*").alias("n")).select("series", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
