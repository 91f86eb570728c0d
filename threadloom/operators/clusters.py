"""Embeddings and their clusters. There are few clusters, so a row meets their centres as one broadcast array; only mean distances make rows meet, block by block."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadloom.operators.sampling import lot, sample
from threadloom.sources.tables import settled

#: Centres are broadcast up to this number.
MOST_CENTRES = 4096
#: Rows in a block whose distances to another block's are found together, rows of either of them at a time, and rows in a block that is not cut for more tasks.
BLOCK, STRIP, TILE, FEW = 16384, 128, 1024, 256
#: A squared distance below this share of both rows' squares is found from differences.
CANCELS = 1e-6


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def label_centres(vectors: DataFrame, least: int = 1) -> DataFrame:
    """label, n, centre: mean vector of each label; null where it has fewer than `least` rows."""
    found = vectors.select("label", array_to_vector("v").alias("_v")).groupBy("label").agg(F.count("*").alias("n"), Summarizer.mean(F.col("_v")).alias("_mean"))
    return found.select("label", "n", F.when(F.col("n") >= least, vector_to_array("_mean")).alias("centre"))


def _broadcast(centres: DataFrame, *columns: str) -> DataFrame:
    """One row with the array _centres of structs of columns, sorted; broadcast after a check of how many there are."""
    if centres.limit(MOST_CENTRES + 1).count() > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    return F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_centres")))


def nearest_centres(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds nearest (label of the nearest centre; the smaller of equally near ones) and its distance."""
    known = _broadcast(centres.where("centre is not null"), "label", "centre")
    best = F.array_min(F.transform("_centres", lambda c: F.struct(F.sqrt(squared(c["centre"], F.col("v"))).alias("d"), c["label"].alias("label"))))
    return vectors.crossJoin(known).withColumn("_best", best).select(*vectors.columns, F.col("_best.label").alias("nearest"), F.col("_best.d").alias("distance"))


def lloyd(vectors: DataFrame, centres: DataFrame, steps: int) -> DataFrame:
    """Centres after `steps` rounds of assigning rows to the nearest and averaging; a centre without rows goes."""
    for _ in range(steps):
        centres = label_centres(nearest_centres(vectors, centres).select(F.col("nearest").alias("label"), "v"))
    return centres


def seed_centres(vectors: DataFrame, least: int = 30, most: int = 500, seed: int = 1) -> DataFrame:
    """label, n, centre: the mean of at most `most` rows of each label, drawn by lot; null where a label has fewer than `least`."""
    return label_centres(sample(vectors.select("vec_id", "label", "v"), "vec_id", most, ["label"], seed), least)


def first_centres(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """label (from 0), centre, n (0): the k rows of the least lots."""
    some = vectors.select("vec_id", "v", lot(F.col("vec_id") + 1, seed).alias("_lot")).orderBy("_lot", "vec_id").limit(k)
    return some.select((F.row_number().over(Window.orderBy("_lot", "vec_id")) - 1).cast("long").alias("label"), F.col("v").alias("centre"), F.lit(0).cast("long").alias("n"))  # k rows


def mini_batches(vectors: DataFrame, centres: DataFrame, steps: int, share: int, seed: int = 1) -> DataFrame:
    """label, centre, n after `steps` batches, each of about one row in `share`, drawn by lot. centres: label, centre, n (rows that it has had).

    Each centre moves to the mean of all rows that it ever had, so at a rate of its own, one over their number. The state is a table of
    k rows a step; a centre without rows in a batch stays.
    """
    now = centres
    for step in range(steps):
        batch = vectors.where(lot(F.col("vec_id") + 1, seed + step) % share == 0)
        near = nearest_centres(batch, now).select(F.col("nearest").alias("label"), array_to_vector("v").alias("_v"))
        new = near.groupBy("label").agg(F.count("*").alias("_n"), Summarizer.sum(F.col("_v")).alias("_s")).select("label", "_n", vector_to_array("_s").alias("_s"))
        moved = F.zip_with("centre", "_s", lambda c, s: (c * F.col("n") + s) / (F.col("n") + F.col("_n")))
        now = settled(now.join(new, "label", "left").select("label", F.when(F.col("_n").isNull(), F.col("centre")).otherwise(moved).alias("centre"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), "centres")
    return now


def _widened(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a for the left and the right of a product of matrices that gives squared distances."""
    n, one = (a * a).sum(axis=1)[:, None], np.ones((len(a), 1))
    return np.hstack([-2.0 * a, n, one]), np.hstack([a, one, n])


def distance_sums(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a the sums of its Euclidean distances to the runs of b's rows that begin at in_b, and for each of b those to a's runs.

    A tile's squares come from one product of matrices; where that cancels, as of equal rows, from differences.
    """
    own, other = np.zeros((len(a), len(in_b))), np.zeros((len(b), len(in_a)))
    left, right = _widened(a)[0], _widened(b)[1]
    n, m, ones = left[:, -2], right[:, -1], np.ones(max(STRIP, TILE))
    tiles = lambda runs, end, size: [(r, slice(k, min(k + size, stop))) for r, (start, stop) in enumerate(zip(runs, [*runs[1:], end], strict=True)) for k in range(start, stop, size)]
    across = tiles(in_b, len(b), TILE)
    for r, s in tiles(in_a, len(a), STRIP):
        for q, t in across:
            d = left[s] @ right[t].T
            # what is no number is not above the limit either
            if not d.min() > CANCELS * (n[s].max() + m[t].max()):
                i, j = np.nonzero(~(d > CANCELS * (n[s, None] + m[None, t])))
                d[i, j] = ((a[s][i] - b[t][j]) ** 2).sum(axis=1)
            np.sqrt(d, out=d)
            own[s, q] += d @ ones[: d.shape[1]]
            other[t, r] += ones[: d.shape[0]] @ d
    return own, other


def mean_distances(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """vec_id, label, cluster, n (the cluster's rows), mean: each row's exact mean Euclidean distance to each cluster, without itself in its own; 0 where it is alone.

    Every two blocks of rows meet once, and pass on a list of sums for each row of either. A block has at most about `block` rows, and
    fewer where there would be fewer pairs of blocks than tasks. vec_id is a key, and vectors have one length.
    """
    rows, tasks = vectors.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-rows // block), min(math.isqrt(4 * tasks), rows // FEW))
    dealt = vectors.select("vec_id", "label", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("_block")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"))
    dealt = dealt.select("vec_id", "label", "v", (F.col("_block") <= F.col("_other")).alias("_left"), (F.col("_block") >= F.col("_other")).alias("_right"), (F.least("_block", "_other") * blocks + F.greatest("_block", "_other")).cast("long").alias("_pair"))
    keys = [T.StructField(c, vectors.schema[c].dataType) for c in ("vec_id", "label")]
    lists = [T.StructField(c, T.ArrayType(kind)) for c, kind in (("cluster", T.LongType()), ("n", T.LongType()), ("total", T.DoubleType()))]

    def run(both: pa.Table) -> pa.Table:
        sides = [both.filter(both[c]).sort_by("label") for c in ("_left", "_right")]
        names = [f.name for f in (*keys, *lists)]
        if not len(sides[0]) or not len(sides[1]):
            return pa.table([*(both[f.name].slice(0, 0) for f in keys), *(pa.array([], pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.float64()))], names=names)
        v = [pc.list_flatten(t["v"]).to_numpy().reshape(len(t), -1) for t in sides]
        found = [np.unique(t["label"].to_numpy(), return_index=True, return_counts=True) for t in sides]
        sums, made = distance_sums(v[0], v[1], found[0][1], found[1][1]), []
        # a block with itself says all of its rows on the left
        alone = pc.all(pc.and_(both["_left"], both["_right"])).as_py()
        for t, total, (name, _, n) in list(zip(sides, sums, found[::-1], strict=True))[: 1 if alone else 2]:
            at = pa.array(np.arange(len(t) + 1) * len(name), pa.int32())
            made.append(pa.table([*(t[f.name] for f in keys), *(pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (np.tile(name, (len(t), 1)), np.tile(n, (len(t), 1)), total))], names=names))
        return pa.concat_tables(made)

    # few rows and much work: adaptive execution does not merge these
    met = dealt.repartition(min(blocks * (blocks + 1) // 2, 8 * tasks), "_pair").groupBy("_pair").applyInArrow(run, T.StructType(keys + lists))
    # lists go to their row, and are taken apart there
    each = met.repartition("vec_id").select("vec_id", "label", F.explode(F.arrays_zip("cluster", "n", "total")).alias("s"))
    sums = each.groupBy("vec_id", "label", F.col("s.cluster").alias("cluster")).agg(F.sum("s.n").alias("n"), F.sum("s.total").alias("_total"))
    return sums.select("vec_id", "label", "cluster", "n", (F.col("_total") / F.greatest(F.col("n") - (F.col("cluster") == F.col("label")).cast("int"), F.lit(1))).alias("mean"))


def euclidean_silhouettes(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """vec_id, label, own, other, silhouette: of Euclidean distances. Rows alone in their cluster, or without another cluster, have silhouette 0."""
    mine = F.col("cluster") == F.col("label")
    rows = mean_distances(vectors, block).groupBy("vec_id", "label").agg(F.max(F.when(mine & (F.col("n") > 1), F.col("mean"))).alias("own"), F.min(F.when(~mine, F.col("mean"))).alias("other"))
    score = F.when(F.col("own").isNotNull() & F.col("other").isNotNull(), F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")))
    return rows.select("vec_id", "label", "own", "other", F.coalesce(score, F.lit(0.0)).alias("silhouette"))


def hypothesis_silhouettes(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """vec_id, label, cluster, silhouette: each row's under the hypothesis of every cluster, by mean Euclidean distances; 0 where there is one cluster."""
    rows = mean_distances(vectors, block).groupBy("vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("cluster", "mean"))).alias("_m"))

    def score(m: Column) -> Column:
        b = F.array_min(F.transform(F.filter("_m", lambda o: o["cluster"] != m["cluster"]), lambda o: o["mean"]))
        return F.coalesce((b - m["mean"]) / F.greatest(m["mean"], b, F.lit(1e-12)), F.lit(0.0))

    each = F.explode(F.transform("_m", lambda m: F.struct(m["cluster"].alias("cluster"), score(m).alias("silhouette"))))
    return rows.select("vec_id", "label", each.alias("_s")).select("vec_id", "label", "_s.cluster", "_s.silhouette")


def fragment_scores(scores: DataFrame, images: DataFrame) -> DataFrame:
    """fragment_id, n_images, p: means of hypothesis_silhouettes over a fragment's images, in the order of clusters. images: vec_id, fragment_id."""
    means = scores.join(images.select("vec_id", "fragment_id"), "vec_id").groupBy("fragment_id", "cluster").agg(F.avg("silhouette").alias("_s"), F.count("*").alias("n_images"))
    return means.groupBy("fragment_id").agg(F.max("n_images").alias("n_images"), F.transform(F.array_sort(F.collect_list(F.struct("cluster", "_s"))), lambda x: x["_s"]).alias("p"))


def silhouettes(vectors: DataFrame) -> DataFrame:
    """vec_id, label, own, other, silhouette: of squared Euclidean distances, exact, from sums per cluster. euclidean_silhouettes takes the distances themselves.

    The mean squared distance to a cluster of m rows is |v|^2 - 2 v.mean + mean of |u|^2, so clusters' sums replace the distances to all rows.
    Rows alone in their cluster have silhouette 0.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sums = label_centres(vectors).join(vectors.groupBy("label").agg(F.avg(norm).alias("_norm")), "label")
    known = _broadcast(sums, "label", "n", "centre", "_norm").withColumnRenamed("_centres", "_c")
    dot = lambda c: F.aggregate(F.zip_with(c["centre"], F.col("v"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    mean = lambda c: F.greatest(norm - 2 * dot(c) + c["_norm"], F.lit(0.0))
    rows = vectors.crossJoin(known).select("vec_id", "label", F.transform("_c", lambda c: F.struct(c["label"].alias("label"), c["n"].alias("n"), mean(c).alias("mean"))).alias("_m"))
    mine = F.element_at(F.filter("_m", lambda m: m["label"] == F.col("label")), 1)
    rows = rows.select("vec_id", "label", F.when(mine["n"] > 1, mine["mean"] * mine["n"] / (mine["n"] - 1)).alias("own"), F.array_min(F.transform(F.filter("_m", lambda m: m["label"] != F.col("label")), lambda m: m["mean"])).alias("other"))
    return rows.select("vec_id", "label", "own", "other", F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0)).alias("silhouette"))


def confusion(rows: DataFrame, truth: str, found: str, n: int) -> DataFrame:
    """truth, and a column for each found label 0..n-1: counts."""
    return rows.groupBy(truth).agg(*(F.count_if(F.col(found) == k).alias(f"found_{k}") for k in range(n)))


def soft_assignment(vectors: DataFrame, centres: DataFrame, weights) -> DataFrame:
    """vec_id, label, weight: for each centre, by weights(distances), an array expression."""
    known = _broadcast(centres.where("centre is not null"), "label", "centre").withColumnRenamed("_centres", "_c")
    d = vectors.crossJoin(known).select("vec_id", "_c", F.transform("_c", lambda c: F.sqrt(squared(c["centre"], F.col("v")))).alias("_d"))
    w = d.select("vec_id", F.arrays_zip(F.transform("_c", lambda c: c["label"]).alias("label"), weights(F.col("_d")).alias("weight")).alias("_w"))
    return w.select("vec_id", F.explode("_w").alias("_w")).select("vec_id", F.col("_w.label").alias("label"), F.col("_w.weight").alias("weight"))
