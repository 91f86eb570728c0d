"""Gaps in trajectories filled by interpolating B-splines of degree 1, 2, 3 or 5. A gap is a unit of work: no call holds a trajectory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEGREES = (1, 2, 3, 5)
#: A window has at least so many positions, or has been widened WIDENINGS times by STEP on both sides.
ENOUGH, STEP, WIDENINGS = 10, 10, 11
#: Frames in a range in which gaps and positions meet.
SPAN = 512


def knots(x: np.ndarray, k: int) -> np.ndarray:
    """Knots of an interpolating spline that has none near its ends: at positions for odd degrees, halfway between them for even ones."""
    inner = x if k % 2 else (x[1:] + x[:-1]) / 2
    cut = (k + 1) // 2 if k % 2 else k // 2
    return np.concatenate([np.full(k + 1, x[0]), inner[cut : len(inner) - cut], np.full(k + 1, x[-1])])


def basis(t: np.ndarray, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point: the number of its first B-spline, and the values of its k + 1. Points outside go on with the first or last polynomial."""
    n = len(t) - k - 1
    span = np.clip(np.searchsorted(t, at, "right") - 1, k, n - 1)
    out = np.zeros((len(at), k + 1))
    out[:, 0] = 1.0
    for d in range(1, k + 1):
        saved = np.zeros(len(at))
        for r in range(d):
            right, left = t[span + r + 1], t[span + 1 - d + r]
            part = out[:, r] / (right - left)
            out[:, r] = saved + (right - at) * part
            saved = (at - left) * part
        out[:, d] = saved
    return span - k, out


def coefficients(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Knots, and the splines' coefficients through (x, y), by elimination in the band. The matrix is totally positive, so no rows change places."""
    t = knots(x, k)
    first, values = basis(t, k, x)
    n, y = len(x), y.astype(float).copy()
    a = np.zeros((n, 2 * k + 1))  # row i holds columns i - k .. i + k
    for i in range(n):
        a[i, first[i] - i + k : first[i] - i + 2 * k + 1] = values[i]
    for i in range(n):
        for j in range(i + 1, min(n, i + k + 1)):
            if f := a[j, i - j + k] / a[i, k]:
                a[j, i - j + k : i - j + 2 * k + 1] -= f * a[i, k : 2 * k + 1]
                y[j] -= f * y[i]
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, min(n, i + k + 1)):
            y[i] -= a[i, j - i + k] * y[j]
        y[i] /= a[i, k]
    return t, y


def spline(x: np.ndarray, y: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """The interpolating spline's values; y has a column for each coordinate."""
    t, c = coefficients(x.astype(float), y, k)
    first, values = basis(t, k, at.astype(float))
    return np.einsum("pd,pdc->pc", values, c[first[:, None] + np.arange(k + 1)])


def gaps(tracks: DataFrame) -> DataFrame:
    """individual, start, end (exclusive): frames between two positions of an individual that have none."""
    ahead = F.lead("frame").over(Window.partitionBy("individual").orderBy("frame"))
    return tracks.select("individual", (F.col("frame") + 1).alias("start"), ahead.alias("end")).where(F.col("end") > F.col("start"))


def filled(tracks: DataFrame, degree: int, around: int = 10) -> DataFrame:
    """individual, frame, x, y of the missing frames alone. tracks: individual, frame, x, y, a row a frame at most.

    A gap's spline goes through the positions of the `around` frames before and after it; while these are fewer than ENOUGH, by STEP
    frames more on both sides, WIDENINGS times at most. Where there are not degree + 1 positions then, the gap stays. A position
    that lacks a coordinate, or is not finite, is none.
    """
    if degree not in DEGREES:
        raise ValueError(f"degree {degree} is none of {DEGREES}")
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    there = tracks.where(known("x") & known("y")).select("individual", F.col("frame").cast("long").alias("frame"), F.col("x").cast("double"), F.col("y").cast("double"))
    reach = around + STEP * WIDENINGS
    span = lambda a, b: F.sequence(F.floor(a / SPAN), F.floor(b / SPAN))
    start, end = F.col("start"), F.col("end")
    both = gaps(there).withColumn("_range", F.explode(F.array_distinct(F.concat(span(start - reach, start - 1), span(end, end + reach)))))  # not the ranges inside
    points = there.withColumn("_range", F.floor(F.col("frame") / SPAN))
    met = both.join(points, ["individual", "_range"]).where((F.col("frame") >= F.col("start") - reach) & (F.col("frame") < F.col("end") + reach))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"individual": [], "frame": [], "x": [], "y": []})]
        for (who, start, end), rows in group.groupby(["individual", "start", "end"]):
            rows = rows.sort_values("frame")
            frame, xy = rows["frame"].to_numpy(), rows[["x", "y"]].to_numpy()
            for wide in range(WIDENINGS + 1):
                use = (frame >= start - around - STEP * wide) & (frame < end + around + STEP * wide)
                if use.sum() >= ENOUGH:
                    break
            if use.sum() > degree:
                for some in pieces(start, end):
                    values = spline(frame[use], xy[use], degree, some)
                    out.append(pd.DataFrame({"individual": who, "frame": some, "x": values[:, 0], "y": values[:, 1]}))
        return pd.concat(out)

    kind = tracks.schema["individual"].dataType.simpleString()
    few = F.floor(F.col("start") / SPAN)  # gaps that begin close together share a call
    return met.groupBy("individual", few.alias("_few")).applyInPandas(lambda _, group: run(group), f"individual {kind}, frame long, x double, y double")


def pieces(start: int, end: int, size: int = 1 << 16) -> Iterator[np.ndarray]:
    for a in range(start, end, size):
        yield np.arange(a, min(end, a + size))
