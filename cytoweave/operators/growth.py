"""Growth rates and times of birth from volume series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fold


def local_slope(volumes: DataFrame, half: int = 3, log: bool = False) -> DataFrame:
    """Least-squares slope of volume over time in a centred window of rows; null below 3 points."""
    w = Window.partitionBy("series").orderBy("tp").rowsBetween(-half, half)
    v = F.log("vol") if log else F.col("vol")
    slope = F.when(F.count("vol").over(w) >= 3, F.regr_slope(v, F.col("tp")).over(w))
    return volumes.withColumn("gr", slope)


def _matern(scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drift, raised by its rate to a nilpotent matrix, and stationary covariance of value, slope and second derivative.

    The Matern kernel of order 5/2 and variance 1 is that of a linear stochastic
    equation of third order with rate sqrt(5) / scale.
    """
    rate = np.sqrt(5.0) / np.asarray(scale, float)
    zero, one = np.zeros_like(rate), np.ones_like(rate)
    drift = np.array([[rate, one, zero], [zero, rate, one], [-(rate**3), -3 * rate**2, -2 * rate]])
    k = rate**2 / 3
    still = np.array([[one, zero, -k], [zero, k, zero], [-k, zero, rate**4]])
    return np.moveaxis(drift, (0, 1), (-2, -1)), np.moveaxis(still, (0, 1), (-2, -1))


def _transition(gap: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Transition matrices over gaps in time."""
    drift, _ = _matern(scale)
    step = drift * gap[..., None, None]
    return np.exp(-np.sqrt(5.0) * gap / scale)[..., None, None] * (np.eye(3) + step + step @ step / 2)


def _kalman(t: np.ndarray, y: np.ndarray, seen: np.ndarray, scale: np.ndarray, noise: np.ndarray, smooth: bool):
    """Filter, and smoother if asked, over rows of series side by side (rows, points), prior variance 1.

    Points that aren't ``seen`` are only predicted.  Gives for each row the sum of
    squared innovations by their variance and the sum of these variances'
    logarithms; with ``smooth`` also means (rows, points, 3) and variances.
    """
    rows, n = y.shape
    _, still = _matern(scale)
    mean, cov = np.zeros((rows, 3)), still.copy()
    squares, logs = np.zeros(rows), np.zeros(rows)
    gaps = np.diff(t, axis=1, prepend=t[:, :1])
    kept = []
    for k in range(n):
        if k:
            a = _transition(gaps[:, k], scale)
            mean = (a @ mean[..., None])[..., 0]
            cov = still + a @ (cov - still) @ np.swapaxes(a, 1, 2)
            if smooth:
                kept[-1] += (a, mean, cov)
        use = seen[:, k]
        s, off = cov[:, 0, 0] + noise, y[:, k] - mean[:, 0]
        gain = np.where(use[:, None], cov[:, :, 0] / s[:, None], 0.0)
        squares += np.where(use, off * off / s, 0.0)
        logs += np.where(use, np.log(s), 0.0)
        mean = mean + gain * off[:, None]
        cov = cov - gain[:, :, None] * cov[:, None, 0, :]
        if smooth:
            kept.append((mean, cov))
    if not smooth:
        return squares, logs
    means, variances = np.zeros((rows, n, 3)), np.zeros((rows, n, 3))
    means[:, -1], variances[:, -1] = mean, np.diagonal(cov, axis1=1, axis2=2)
    for k in range(n - 2, -1, -1):
        here, around, a, ahead, spread = kept[k]
        back = np.swapaxes(np.linalg.solve(spread, a @ around), 1, 2)
        mean = here + (back @ (mean - ahead)[..., None])[..., 0]
        cov = around + back @ (cov - spread) @ np.swapaxes(back, 1, 2)
        means[:, k], variances[:, k] = mean, np.diagonal(cov, axis1=1, axis2=2)
    return means, variances, squares, logs


#: Starts and bounds of the search for length (in units of time) and noise (share of the signal's variance).
SCALES, NOISES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0), (0.001, 0.01, 0.1, 0.5)
SCALE_BOUNDS, NOISE_BOUNDS = (0.25, 256.0), (1e-4, 10.0)
#: Points of a window; a longer series is cut into windows that are filtered side by side.
WINDOW = 1024
#: Lengths of time after which what lies before counts for nothing (below 1e-15).
FORGET = 20.0
#: Rows by points that are worked on at once.
CELLS = 1 << 17


def _likelihood(t, y, seen, part, series, scale, noise):
    """Of each series the log likelihood, with its best signal variance; windows (rows) add up to their series."""
    squares, logs = _kalman(t, y, seen, scale[part], noise[part], False)
    n = np.bincount(part, seen.sum(axis=1), series)
    var = np.maximum(np.bincount(part, squares, series) / np.maximum(n, 1), 1e-12)
    return -0.5 * n * np.log(var) - 0.5 * np.bincount(part, logs, series), var


def _search(t, y, seen, part, series):
    """Length, noise and variance of the largest likelihood for each series: the best start, then steps that halve."""
    best = np.full(series, -np.inf)
    scale, noise = np.full(series, SCALES[0]), np.full(series, NOISES[0])

    def attempt(s, r):
        nonlocal best, scale, noise
        s, r = np.clip(s, *SCALE_BOUNDS), np.clip(r, *NOISE_BOUNDS)
        value, _ = _likelihood(t, y, seen, part, series, s, r)
        better = value > best + 1e-9
        best, scale, noise = np.where(better, value, best), np.where(better, s, scale), np.where(better, r, noise)
        return better

    for s in SCALES:
        for r in NOISES:
            attempt(np.full(series, s), np.full(series, r))
    for step in (0.5, 0.25, 0.125, 0.0625):
        for _ in range(3):
            moved = False
            for ds, dr in ((1, 0), (-1, 0), (0, 2), (0, -2), (1, -2), (-1, 2)):
                moved |= attempt(scale * np.exp(ds * step), noise * np.exp(dr * step)).any()
            if not moved:
                break
    return scale, noise, _likelihood(t, y, seen, part, series, scale, noise)[1]


def _rows(starts: np.ndarray, ends: np.ndarray, t: np.ndarray, y: np.ndarray):
    """Parts of long arrays side by side, filled up with points that aren't seen."""
    n = int((ends - starts).max())
    at = np.minimum(starts[:, None] + np.arange(n), ends[:, None] - 1)
    return t[at], y[at], np.arange(n)[None, :] < (ends - starts)[:, None]


def gp_fit(t: np.ndarray, v: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Value, slope and second derivative with standard deviations of many series, by a Matern process in linear time.

    Series stand one after the other and begin at the places ``first``; times rise
    within each.  Lengths and noises are those of the largest likelihood.  A long
    series is cut into windows that begin and end FORGET lengths outside of what is
    taken from them, so its fit is that of the whole series to rounding.
    """
    out = [np.zeros(len(t)) for _ in range(6)]
    ends = np.append(first[1:], len(t))
    sizes = ends - first
    owner = np.repeat(np.arange(len(first)), sizes)
    centre = np.add.reduceat(v, first) / sizes
    spread = np.sqrt(np.add.reduceat((v - centre[owner]) ** 2, first) / sizes)
    spread[spread == 0] = 1.0
    y = (v - centre[owner]) / spread[owner]
    order = np.argsort(sizes, kind="stable")
    while len(order):
        # series of like lengths together, as many as CELLS allow
        longest = min(int(sizes[order[0]]) * 2, WINDOW)
        some = order[(sizes[order] <= longest)][: max(1, CELLS // longest)] if sizes[order[0]] <= WINDOW else order[:1]
        order = order[len(some) :]
        _fit_some(some, t, y, first, ends, centre, spread, out)
    return out


def _fit_some(some, t, y, first, ends, centre, spread, out) -> None:
    long = ends[some[0]] - first[some[0]] > WINDOW
    cuts = np.arange(first[some[0]], ends[some[0]], WINDOW) if long else first[some]
    stops = np.append(cuts[1:], ends[some[0]]) if long else ends[some]
    part = np.zeros(len(cuts), int) if long else np.arange(len(some))
    scale, noise, var = _search(*_rows(cuts, stops, t, y), part, len(some))
    if long:  # windows reach out on either side
        reach = FORGET * scale[0]
        low = np.maximum(np.searchsorted(t[first[some[0]] : ends[some[0]]], t[cuts] - reach) + first[some[0]], first[some[0]])
        high = np.minimum(np.searchsorted(t[first[some[0]] : ends[some[0]]], t[stops - 1] + reach, side="right") + first[some[0]], ends[some[0]])
    else:
        low, high = cuts, stops
    at_once = max(1, CELLS // int((high - low).max()))
    for k in range(0, len(cuts), at_once):
        w = slice(k, k + at_once)
        who = part[w]
        means, variances, _, _ = _kalman(*_rows(low[w], high[w], t, y), scale[who], noise[who], True)
        for row, s in enumerate(who):
            a, b, lead = cuts[k + row], stops[k + row], cuts[k + row] - low[k + row]
            size, shift = spread[some[s]], centre[some[s]]
            for d in range(3):
                out[2 * d][a:b] = means[row, lead : lead + b - a, d] * size + (shift if d == 0 else 0.0)
                out[2 * d + 1][a:b] = np.sqrt(np.maximum(variances[row, lead : lead + b - a, d] * var[s], 0.0)) * size


def gp_growth(volumes: DataFrame, log: bool = False) -> DataFrame:
    """svol, svol_std, gr, gr_std, d2v and d2v_std of each point; series below 3 points give none.

    With ``log`` all are of the volume's logarithm.
    """
    names = ["svol", "svol_std", "gr", "gr_std", "d2v", "d2v_std"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        first = fold.starts(pdf["series"].to_numpy())
        sizes = np.diff(np.append(first, len(pdf)))
        pdf = pdf[np.repeat(sizes >= 3, sizes)]
        if not len(pdf):
            return pd.DataFrame(columns=["series", "tp", "vol", *names])
        v = pdf["vol"].to_numpy(float)
        found = gp_fit(pdf["tp"].to_numpy(float), np.log(np.clip(v, 1e-9, None)) if log else v, fold.starts(pdf["series"].to_numpy()))
        return pdf.assign(**dict(zip(names, found, strict=True)))

    rows = volumes.filter("vol is not null").select(F.col("series").cast("long").alias("series"), F.col("tp").cast("int").alias("tp"), F.col("vol").cast("double").alias("vol"))
    return fold.in_groups(rows, ["series"], ["tp"], fit, "series long, tp int, vol double, " + ", ".join(f"{x} double" for x in names))


def append_growth(fitted: DataFrame, path: str, kind: str) -> None:
    """Add fits to the growth table at ``path``, partitioned by kind (as mothers and daughters) and kept as Parquet."""
    fitted.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").parquet(path)


def crossing(pairs: DataFrame, distance: Column, ofs: int = 2, lb: int = 2, ub: int = 15) -> DataFrame:
    """(series, birth): first time at which the daughter's rate nears the mother's, under a rising tolerance.

    pairs: (series, tp, start, end, d_gr, m_gr).  Times from start + ofs to before
    end - ofs are searched; of the tolerances lb..ub the smallest that is met by
    |distance| <= t with d_gr >= t decides, then the earliest time.
    """
    inside = pairs.filter((F.col("tp") >= F.col("start") + ofs) & (F.col("tp") < F.col("end") - ofs))
    # the smallest whole tolerance that a point meets
    need = F.greatest(F.ceil(F.abs(distance)), F.lit(lb))
    met = inside.withColumn("t", need).filter((F.col("t") <= ub) & (F.col("d_gr") >= F.col("t")))
    return met.groupBy("series").agg(F.min(F.struct("t", "tp")).alias("b")).select("series", F.col("b.tp").alias("birth"), F.col("b.t").cast("int").alias("tolerance"))


def split_at_births(frames: DataFrame, births: DataFrame, presence: DataFrame) -> DataFrame:
    """Adds ``segment`` to a mother's frames: cut at births, frames that miss the newest daughter go one back.

    births: (series, birth, daughter) of mothers; presence: (daughter, tp).  A
    frame after a birth in which the daughter is missing still shows the
    undivided cell.
    """
    cuts = births.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("birth", "daughter"))).alias("cuts"))
    f = frames.join(cuts, "series", "left").withColumn("past", F.filter("cuts", lambda c: c["birth"] <= F.col("tp")))
    f = f.withColumn("k", F.coalesce(F.size("past"), F.lit(0))).withColumn("k", F.when(F.col("k") < 0, 0).otherwise(F.col("k"))).withColumn("daughter", F.when(F.col("k") > 0, F.element_at("past", -1)["daughter"]))
    shown = presence.select("daughter", "tp").distinct().withColumn("_shown", F.lit(True))
    met = f.join(shown, ["daughter", "tp"], "left")
    flicker = (F.col("k") > 0) & F.col("_shown").isNull()
    return met.select("series", "tp", F.when(flicker, F.col("k") - 1).otherwise(F.col("k")).alias("segment"))


def savgol_weights(window: int, order: int) -> np.ndarray:
    """Weights of each place of a window: row k gives the fitted value at place k."""
    x = np.arange(window) - window // 2
    basis = np.vander(x, order + 1, increasing=True)
    return basis @ np.linalg.pinv(basis)


def savgol(history: DataFrame, window: int = 21, order: int = 3, value: str = "v") -> DataFrame:
    """Savitzky-Golay smoothing: centred windows inside, the first and last window's fit at the edges.

    (series, i, v) with i from 0; series shorter than the window stay as they are.
    """
    half, weights = window // 2, savgol_weights(window, order)
    n = F.count("*").over(Window.partitionBy("series"))
    h = history.withColumn("_n", n)
    place = F.when(F.col("i") < half, F.col("i")).when(F.col("i") >= F.col("_n") - half, F.col("i") - F.col("_n") + window).otherwise(half)
    first = F.least(F.greatest(F.col("i") - half, F.lit(0)), F.col("_n") - window)
    row = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in weights])
    around = Window.partitionBy("series").orderBy("i").rowsBetween(-(window - 1), window - 1)
    near = F.collect_list(value).over(around)
    skip = first - F.greatest(F.col("i") - (window - 1), F.lit(0))
    part = F.slice(near, (skip + 1).cast("int"), F.lit(window))
    smooth = F.aggregate(F.zip_with(part, F.get(row, place.cast("int")), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return h.withColumn("smooth", F.when(F.col("_n") >= window, smooth).otherwise(F.col(value))).drop("_n")
