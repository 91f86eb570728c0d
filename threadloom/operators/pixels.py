"""Blobs in images: runs of foreground pixels, joined to components; exact distances to the background; how far blobs can be eroded.

Images are rows (frame, y, x, v) for labelling, where a run of pixels is one row from the start, and rows (frame, width, v), an image
each, for distances, as an image is what a task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.links import connected_components
from threadloom.sources.tables import settled


def foreground(v: Column, least: float, most: float | None = None, background: Column | None = None) -> Column:
    """Whether a pixel counts: between two intensities, or further than `least` from the background."""
    return F.abs(background - v) > least if background is not None else v.between(least, most)


def runs(pixels: DataFrame) -> DataFrame:
    """frame, y, x1, x2: maximal runs of a line's pixels. pixels: frame, y, x of the foreground alone."""
    line = Window.partitionBy("frame", "y").orderBy("x")
    return pixels.withColumn("_k", F.col("x") - F.row_number().over(line)).groupBy("frame", "y", "_k").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("_k")


def labelled(pixels: DataFrame) -> DataFrame:
    """frame, y, x1, x2, blob: runs and the component they belong to, named by its first run (frame, y, x1). Pixels that touch at a corner are together."""
    r = settled(runs(pixels).withColumn("run", F.struct("frame", "y", "x1")).withColumn("id", F.xxhash64("frame", "y", "x1")), "pixel-runs")
    if r.count() != r.select("id").distinct().count():
        raise ValueError("two runs share a hash")
    above = r.select("frame", (F.col("y") + 1).alias("y"), F.col("x1").alias("_x1"), F.col("x2").alias("_x2"), F.col("id").alias("a"))
    edges = r.join(above, ["frame", "y"]).where((F.col("x1") <= F.col("_x2") + 1) & (F.col("_x1") <= F.col("x2") + 1)).select("a", F.col("id").alias("b"))
    found = connected_components(edges).withColumnsRenamed({"node": "id"})
    r = r.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = r.groupBy("component").agg(F.min("run").alias("blob"))
    return r.join(names, "component").select("frame", "y", "x1", "x2", "blob")


def blobs(pixels: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """frame, blob, n_pixels, left, top, right, bottom, cx, cy of each component with a number of pixels from least to most.

    The size is the number of pixels, holes not counted; that of a contour's polygon is less by about half its corners.
    """
    n = F.col("x2") - F.col("x1") + 1
    out = labelled(pixels).groupBy("frame", "blob").agg(
        F.sum(n).alias("n_pixels"), F.min("x1").alias("left"), F.min("y").alias("top"), F.max("x2").alias("right"), F.max("y").alias("bottom"),
        (F.sum((F.col("x1") + F.col("x2")) * n / 2) / F.sum(n)).alias("cx"), (F.sum(F.col("y") * n) / F.sum(n)).alias("cy"),
    )
    return out.where((F.col("n_pixels") >= least) & (F.lit(most is None) | (F.col("n_pixels") <= (most or 0))))


def squared_distances(mask: np.ndarray) -> np.ndarray:
    """For each pixel the square of the distance to the nearest pixel that is not of the mask; a pixel outside the image is none.

    Two exact passes: down and up the columns, then along each line the lower envelope of the parabolas over its pixels.
    """
    h, w = mask.shape
    far = h + w
    g = np.where(mask, far, 0)
    for y in range(1, h):
        g[y] = np.minimum(g[y], g[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        g[y] = np.minimum(g[y], g[y + 1] + 1)
    g = g.astype(np.int64)
    out = np.empty((h, w), np.int64)
    for y in range(h):
        f, site, edge = g[y] ** 2, [0], [-np.inf]
        for q in range(1, w):
            while True:
                p = site[-1]
                s = (f[q] + q * q - f[p] - p * p) / (2 * (q - p))
                if s > edge[-1]:
                    break
                site.pop()
                edge.pop()
            site.append(q)
            edge.append(s)
        edge.append(np.inf)
        k = 0
        for x in range(w):
            while edge[k + 1] < x:
                k += 1
            out[y, x] = (x - site[k]) ** 2 + f[site[k]]
    return out


def distances(images: DataFrame) -> DataFrame:
    """frame, squared: an array of the squared distances to the background, line by line. images: frame, width, mask (array of booleans). Where an image has no background at all, all are far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [squared_distances(np.array(m, bool).reshape(-1, w)).ravel() if m else np.zeros(0, np.int64) for w, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["frame", "squared"])

    return images.select("frame", "width", "mask").mapInArrow(run, "frame long, squared array<long>")


def depths(images: DataFrame, found: DataFrame) -> DataFrame:
    """frame, blob, distance: how far the deepest pixel of each blob is from the background. found: labelled."""
    each = distances(images).join(images.select("frame", "width"), "frame").select("frame", "width", F.posexplode("squared").alias("k", "s")).where("s > 0")
    each = each.select("frame", F.floor(F.col("k") / F.col("width")).alias("y"), (F.col("k") % F.col("width")).alias("x"), "s")
    lines = each.groupBy("frame", "y").agg(F.collect_list(F.struct("x", "s")).alias("line"))  # no more than an image is wide
    deep = found.join(lines, ["frame", "y"]).select("frame", "blob", F.array_max(F.transform(F.filter("line", lambda p: p["x"].between(F.col("x1"), F.col("x2"))), lambda p: p["s"])).alias("s"))
    return deep.groupBy("frame", "blob").agg(F.sqrt(F.max("s").cast("double")).alias("distance"))


def eroded(images: DataFrame, disk: float) -> DataFrame:
    """frame, y, x of the pixels that are further than disk from the background: what is left of the foreground."""
    each = distances(images).join(images.select("frame", "width"), "frame").select("frame", "width", F.posexplode("squared").alias("k", "s")).where(F.col("s") > disk * disk)
    return each.select("frame", F.floor(F.col("k") / F.col("width")).alias("y"), (F.col("k") % F.col("width")).alias("x"))
