"""Segmented blobs: which look like one animal, how long bodies are, and how blobs hang together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.order import quantiles


def full_frame_values(blobs: DataFrame, n: int, value: str) -> DataFrame:
    """value: of blobs in frames of exactly n, or in all frames where there is none such."""
    counts = blobs.groupBy("frame").agg(F.count("*").alias("_n"))
    b = blobs.join(counts, "frame").select(F.col(value).alias("value"), (F.col("_n") == n).alias("_full"))
    any_full = b.agg(F.coalesce(F.max("_full"), F.lit(False)).alias("_any"))
    return b.crossJoin(F.broadcast(any_full)).where(F.col("_full") | ~F.col("_any")).select("value")


def individual_flags(blobs: DataFrame, n: int, tolerance: float = 4.0) -> DataFrame:
    """Adds seems_individual: the frame holds n blobs, or the area is under the median by full frames plus `tolerance` standard deviations."""
    values = full_frame_values(blobs, n, "area")
    model = quantiles(values, ["value"], [0.5]).select(F.col("value")[0].alias("_median")).crossJoin(F.broadcast(values.agg(F.stddev_pop("value").alias("_std"))))
    counts = blobs.groupBy("frame").agg(F.count("*").alias("_n"))
    b = blobs.join(counts, "frame").crossJoin(F.broadcast(model))
    return b.withColumn("seems_individual", (F.col("_n") == n) | (F.col("area") - F.col("_median") < tolerance * F.col("_std"))).drop("_n", "_median", "_std")


def body_length(blobs: DataFrame, n: int) -> DataFrame:
    """One row: median extension on full frames."""
    return quantiles(full_frame_values(blobs, n, "extension"), ["value"], [0.5]).select(F.col("value")[0].alias("body_length"))


def link_degrees(blobs: DataFrame, links: DataFrame) -> DataFrame:
    """Adds n_next and n_previous. links: source, target; blobs: blob_id."""
    out = links.groupBy(F.col("source").alias("blob_id")).agg(F.count("*").alias("n_next"))
    back = links.groupBy(F.col("target").alias("blob_id")).agg(F.count("*").alias("n_previous"))
    return blobs.join(out, "blob_id", "left").join(back, "blob_id", "left").na.fill(0, ["n_next", "n_previous"])


def one_to_one(degrees: DataFrame, links: DataFrame) -> DataFrame:
    """The links whose source has no other target, whose target no other source, and whose ends are of one class (class_id)."""
    a = degrees.where("n_next = 1").select(F.col("blob_id").alias("source"), F.col("class_id").alias("_a"))
    b = degrees.where("n_previous = 1").select(F.col("blob_id").alias("target"), F.col("class_id").alias("_b"))
    return links.join(a, "source").join(b, "target").where("_a = _b").select("source", "target")


def crossing_of_refused(identity: str, is_crossing: str) -> Column:
    """Whether a blob is a crossing once individuals without an identity (0) count as such."""
    return F.col(is_crossing) | (F.coalesce(F.col(identity), F.lit(-1)) == 0)


def image_size(median_length: float, reduction: float | None = None, most: int = 80) -> tuple[int, float]:
    """Side of square identification images and how much the resolution is reduced: an even number near length / sqrt 2, at most `most` if no reduction is given."""
    even = lambda x: int(x + 0.5) + int(x + 0.5) % 2
    size = even(median_length / math.sqrt(2))
    if reduction is not None:
        return even(size * reduction), reduction
    return (most, round(most / size, 2)) if size > most else (size, 1.0)


def length_unit(calibrations: DataFrame) -> DataFrame:
    """One row: pixels for a unit of length, the mean over calibrations (x1, y1, x2, y2, length) that have a length."""
    d = F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2))
    return calibrations.agg(F.avg(F.try_divide(d, "length")).alias("length_unit"))


def preflight(poses: DataFrame, n: int, least: int = 3) -> DataFrame:
    """One row: frames with more than n instances, and instances with at least `least` finite key points. poses: frame, pose."""
    there = F.size(F.filter("pose", lambda p: p["x"].isNotNull() & ~F.isnan(p["x"]) & p["y"].isNotNull() & ~F.isnan(p["y"])))
    crowded = poses.groupBy("frame").agg(F.count("*").alias("_n"), F.count_if(there >= least).alias("_good"))
    return crowded.agg(F.count_if(F.col("_n") > n).alias("crowded_frames"), F.coalesce(F.sum("_good"), F.lit(0)).alias("usable_instances"))


def instances_without_row(instances: DataFrame, rows: DataFrame) -> DataFrame:
    """Instances (frame, instance_idx) that no detection row stands for."""
    return instances.join(rows.select("frame", "instance_idx"), ["frame", "instance_idx"], "left_anti")


def missing_identities(rows: DataFrame, identities: list[int]) -> DataFrame:
    """frame, identity: what each frame lacks of a fixed list of identities."""
    present = rows.groupBy("frame").agg(F.collect_set("identity").alias("_there"))
    return present.select("frame", F.explode(F.array_except(F.array(*(F.lit(i).cast("long") for i in identities)), F.col("_there"))).alias("identity"))


def corrected(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """rows with a user's corrections (frame, identity, new_identity, x, y): of each frame's rows of the old identity the nearest to the point takes the new one; -1 removes it."""
    near = F.sqrt(F.pow(F.col("cx") - F.col("_x"), 2) + F.pow(F.col("cy") - F.col("_y"), 2))
    c = corrections.select("frame", "identity", "new_identity", F.col("x").alias("_x"), F.col("y").alias("_y"))
    hit = rows.join(c, ["frame", "identity"]).groupBy("frame", "identity", "new_identity").agg(F.min_by("instance_idx", F.struct(near, "instance_idx")).alias("instance_idx")).withColumnRenamed("identity", "_old").drop("_old")
    out = rows.join(hit, ["frame", "instance_idx"], "left").withColumn("identity", F.coalesce("new_identity", "identity")).drop("new_identity")
    return out.where("identity is null or identity <> -1")
