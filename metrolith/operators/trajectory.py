"""Traces of phone sensors: runs, headings, steps, clock alignment, smoothing, scores.

Signals are batch tables (session, t, ...). What folds over time in order runs
once per session in ``applyInPandas``; the rest are windows and interval joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import angle_difference
from .intervals import interpolate, interval_join


def fixes(raw: DataFrame, start: Column) -> DataFrame:
    """GPS rows with ``t``, seconds since the start of the recording."""
    return raw.withColumn("t", (F.unix_micros("timestamp") - F.unix_micros(start)) / 1e6)


def cut_runs(turns: DataFrame, ends: DataFrame, least_s: float) -> DataFrame:
    """session, start_s, end_s of the stretches between turns (start_s, end_s), of
    ``least_s`` or more; ``ends(session, duration_s)`` closes the last one."""
    t = turns.select("session", "start_s", "end_s").unionByName(ends.select("session", F.col("duration_s").alias("start_s"), F.col("duration_s").alias("end_s")))
    w = Window.partitionBy("session").orderBy("start_s", "end_s")
    r = t.select("session", F.coalesce(F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_from"), F.col("start_s").alias("_to"))
    return r.where(F.col("_to") - F.col("_from") >= least_s).select("session", F.col("_from").alias("start_s"), F.col("_to").alias("end_s"))


def axis_runs(runs: DataFrame, axis_deg: float, tolerance_deg: float = 30.0, least_m: float = 0.0) -> DataFrame:
    """Runs along an axis with direction 1 (forward) or -1 (back)."""
    off = F.abs(angle_difference(F.col("bearing_deg"), F.lit(axis_deg)))
    d = F.when(off <= tolerance_deg, 1).when(off >= 180 - tolerance_deg, -1)
    return runs.withColumn("direction", d).where(F.col("direction").isNotNull() & (F.col("distance_m") >= least_m))


def quarter_headings(runs: DataFrame, axis_deg: float, least_m: float = 40.0) -> DataFrame:
    """runs with ``quarter`` (0..3, quarter turns from the axis): turns accumulate
    from run to run, and a run of ``least_m`` or more is anchored by its bearing."""

    def chain(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("start_s")
        anchored = df.distance_m >= least_m
        seen = np.round(((df.bearing_deg - axis_deg) % 360) / 90) % 4
        step = np.round(df.turn_deg.fillna(0) / 90).astype(int).to_numpy()
        q, now = np.zeros(len(df), int), None
        for k in range(len(df)):
            now = (now + step[k]) % 4 if now is not None else None
            if anchored.iloc[k]:
                now = int(seen.iloc[k])
            q[k] = -1 if now is None else now
        nxt = None
        for k in range(len(df) - 1, -1, -1):  # before the first anchor: back from it
            if q[k] < 0 and nxt is not None:
                q[k] = (nxt - step[k + 1]) % 4
            nxt = q[k] if q[k] >= 0 else nxt
        return df.assign(quarter=q)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields)
    return runs.groupBy("session").applyInPandas(chain, f"{ddl}, quarter int")


def _band_pass(x: np.ndarray, rate: float, lo: float, hi: float) -> np.ndarray:
    """Zero-phase second-order band-pass, run forth and back."""

    def once(x, kind, f):
        k = np.tan(np.pi * f / rate)
        n = 1 / (1 + np.sqrt(2) * k + k * k)
        b0 = k * k * n if kind == "low" else n
        b1, b2 = (2 * b0 if kind == "low" else -2 * b0), b0
        a1, a2 = 2 * (k * k - 1) * n, (1 - np.sqrt(2) * k + k * k) * n
        y, z1, z2 = np.empty_like(x), 0.0, 0.0
        for i, v in enumerate(x):
            y[i] = b0 * v + z1
            z1, z2 = b1 * v - a1 * y[i] + z2, b2 * v - a2 * y[i]
        return y

    for kind, f in (("high", lo), ("low", hi)):
        x = once(once(x, kind, f)[::-1], kind, f)[::-1]
    return x


def _peaks(t: np.ndarray, x: np.ndarray, apart: float, prominence: float) -> np.ndarray:
    k = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    keep = []
    for i in k:
        left, right = np.flatnonzero(x[:i] > x[i]), np.flatnonzero(x[i + 1 :] > x[i])
        a = x[left[-1] if left.size else 0 : i + 1].min()
        b = x[i : (i + 1 + right[0] if right.size else len(x)) + 1].min()
        if x[i] - max(a, b) >= prominence:
            keep.append(i)
    out: list[int] = []
    for i in sorted(keep, key=lambda i: -x[i]):
        if all(abs(t[i] - t[j]) >= apart for j in out):
            out.append(i)
    return t[sorted(out)]


def steps(accelerations: DataFrame, lo: float = 0.8, hi: float = 3.5, apart: float = 0.33, prominence: float = 1.0) -> DataFrame:
    """session, t of walking steps: peaks of the band-passed magnitude of x, y, z."""

    def detect(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("t")
        t = df.t.to_numpy()
        if len(t) < 5:
            return pd.DataFrame({"session": df.session.iloc[:0], "t": []})
        rate = 1 / np.median(np.diff(t))
        at = np.arange(t[0], t[-1], 1 / rate)
        x = np.interp(at, t, np.sqrt(df.x**2 + df.y**2 + df.z**2))
        found = _peaks(at, _band_pass(x - x.mean(), rate, lo, hi), apart, prominence)
        return pd.DataFrame({"session": [df.session.iloc[0]] * len(found), "t": found})

    return accelerations.groupBy("session").applyInPandas(detect, f"session {accelerations.schema['session'].dataType.simpleString()}, t double")


def outside_stops(times: DataFrame, stops: DataFrame, width: float = 60.0) -> DataFrame:
    """Times that lie in no half-open stop [start_s, end_s)."""
    return interval_join(times, stops, ["session"], "t", width, "left_anti", "left")


def three_knocks(t: np.ndarray, x: np.ndarray, span_s: float = 3.0, apart_s: float = 0.15, least: float = 12.0) -> np.ndarray | None:
    """Times of the first three peaks within ``span_s`` that stand ``least`` median
    deviations above the median; of peaks less than ``apart_s`` apart the
    highest counts. None if there are not three."""
    if len(t) < 3:
        return None
    middle = np.median(x)
    level = middle + least * np.median(np.abs(x - middle))
    apart = max(1, int(apart_s / np.median(np.diff(t))))
    k = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= level)) + 1
    out: list[int] = []
    for i in sorted(k.tolist(), key=lambda i: -x[i]):
        if all(abs(i - j) >= apart for j in out):
            out.append(i)
    p = t[sorted(out)]
    return next((p[i : i + 3] for i in range(len(p) - 2) if p[i + 2] - p[i] <= span_s), None)


def sync_offset(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], agree_s: float = 0.1) -> float | None:
    """b's clock minus a's by three knocks with equal spacing in both signals."""
    p, q = three_knocks(*a), three_knocks(*b)
    if p is None or q is None or np.abs(np.diff(p) - np.diff(q)).max() > agree_s:
        return None
    return float(np.median(q - p))


def best_lag(signal: DataFrame, reference: DataFrame, value: str, most: float, step: float) -> DataFrame:
    """session, lag, corr: the shift of ``signal`` by which it correlates best with
    ``reference``. Lags are exploded and read off the reference by interpolation."""
    n = int(round(2 * most / step)) + 1
    lags = F.explode(F.array(*[F.lit(round(-most + k * step, 6)) for k in range(n)]))
    s = signal.select("session", lags.alias("lag"), "t", F.col(value).alias("_v")).withColumn("t", F.col("t") + F.col("lag"))
    r = reference.select("session", "t", F.col(value).alias("_r"))
    c = interpolate(s, r, ["session"], "t", ["_r"]).groupBy("session", "lag").agg(F.corr("_v", "_r").alias("corr"))
    w = Window.partitionBy("session").orderBy(F.col("corr").desc_nulls_last(), F.abs("lag"), "lag")
    return c.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rts_smooth(observations: DataFrame, q: float, r: float) -> DataFrame:
    """session, t, u, v smoothed: a random walk with variance ``q`` a second between
    rows and ``r`` per observation, forward filter and backward (RTS) pass. Null
    observations are predicted only."""

    def smooth(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("t")
        t = df.t.to_numpy()
        dt = np.diff(t, prepend=t[0])
        out = {}
        for c in ("u", "v"):
            z = df[c].to_numpy(float)
            m, p = np.zeros(len(z)), np.zeros(len(z))
            mean, var = (z[~np.isnan(z)][0] if (~np.isnan(z)).any() else 0.0), 1e6
            for k in range(len(z)):
                var += q * dt[k]
                if not np.isnan(z[k]):
                    gain = var / (var + r)
                    mean, var = mean + gain * (z[k] - mean), (1 - gain) * var
                m[k], p[k] = mean, var
            for k in range(len(z) - 2, -1, -1):
                g = p[k] / (p[k] + q * dt[k + 1]) if p[k] + q * dt[k + 1] else 0.0
                m[k] += g * (m[k + 1] - m[k])
            out[c] = m
        return df[["session", "t"]].assign(**out)

    return observations.groupBy("session").applyInPandas(smooth, f"session {observations.schema['session'].dataType.simpleString()}, t double, u double, v double")


def rails(track: DataFrame, knots: DataFrame, half_m: float) -> DataFrame:
    """side, u, v, n: median v of track rows (side, u, v) near each knot (u)."""
    k = knots.select(F.col("u").alias("k"), F.explode(F.sequence(F.floor((F.col("u") - half_m) / half_m), F.floor((F.col("u") + half_m) / half_m))).alias("_b"))
    j = track.withColumn("_b", F.floor(F.col("u") / half_m)).join(F.broadcast(k), "_b").where(F.abs(F.col("u") - F.col("k")) <= half_m)
    return j.groupBy("side", F.col("k").alias("u")).agg(F.median("v").alias("v"), F.count("*").alias("n"))


def road_side(detections: DataFrame, frame_width: float, least_score: float = 0.5, share: float = 0.7, least: int = 5) -> DataFrame:
    """run, side: left or right if ``share`` of the run's boxes lie there, else abstain.

    Each side's own mean is compared: ``1 - share`` is rounded, and would lose runs
    that hold exactly that share."""
    left = (F.col("x0") + F.col("x1")) / 2 < frame_width / 2
    g = detections.where(F.col("score") >= least_score).groupBy("run").agg(F.avg(left.cast("double")).alias("l"), F.avg((~left).cast("double")).alias("r"), F.count("*").alias("n"))
    return g.select("run", F.when(F.col("n") < least, "abstain").when(F.col("l") >= share, "left").when(F.col("r") >= share, "right").otherwise("abstain").alias("side"), "n")


def score(track: DataFrame, curb: str = "curb", back: str = "back", centre: str = "centre") -> DataFrame:
    """side (1 or -1), n, inside (share on that side's sidewalk), to_middle_m (median
    distance to its middle), from_curb_m (median distance onto it; negative in the
    road), in_road and other_half (shares), of rows in which all is known."""
    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("v", curb, back, centre)]
    v, side = F.col("v"), F.col("side")
    onto = side * (v - F.col(curb))
    share = lambda test: F.avg(test.cast("double"))
    return track.where(known[0] & known[1] & known[2] & known[3]).groupBy("side").agg(
        F.count("*").alias("n"),
        share((onto >= 0) & (side * (F.col(back) - v) >= 0)).alias("inside"),
        F.median(F.abs(v - (F.col(curb) + F.col(back)) / 2)).alias("to_middle_m"),
        F.median(onto).alias("from_curb_m"),
        share(onto < 0).alias("in_road"),
        share(side * (v - F.col(centre)) < 0).alias("other_half"),
    )


def gauss_newton_lines(sessions: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], knots: np.ndarray, smooth: float = 1.0, rounds: int = 20, delta: float = 1.0) -> np.ndarray:
    """Values at knots of one line through robust observations (u, v, weight) of all
    sessions: iteratively reweighted (Huber) least squares on linear pieces with
    a second-difference penalty. A street's fit is small and runs on the driver."""
    u, v, w = (np.concatenate([s[k] for s in sessions.values()]) for k in range(3))
    at = np.clip(np.searchsorted(knots, u) - 1, 0, len(knots) - 2)
    f = np.clip((u - knots[at]) / (knots[at + 1] - knots[at]), 0, 1)
    a = np.zeros((len(u), len(knots)))
    a[np.arange(len(u)), at], a[np.arange(len(u)), at + 1] = 1 - f, f
    d = np.diff(np.eye(len(knots)), 2, axis=0) * smooth
    x = np.full(len(knots), np.median(v))
    for _ in range(rounds):
        e = np.abs(a @ x - v)
        k = w * np.where(e <= delta, 1.0, delta / np.maximum(e, 1e-12))
        new = np.linalg.solve(a.T @ (a * k[:, None]) + d.T @ d + 1e-9 * np.eye(len(knots)), a.T @ (k * v))
        if np.abs(new - x).max() < 1e-9:
            break
        x = new
    return x
