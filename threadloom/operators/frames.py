"""Frames: dense axes, cores and global fragments, episodes, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.order import WIDTH, ranked


def frame_table(states: DataFrame) -> DataFrame:
    """frame, ids (distinct fragments, sorted), n_individual (rows that don't overlap), is_empty: every frame from the first to the last."""
    per = states.groupBy("frame").agg(F.sort_array(F.collect_set("fragment_id")).alias("ids"), F.count_if(~F.col("is_overlapping")).alias("n_individual"))
    ends = per.agg(F.min("frame").alias("a"), F.max("frame").alias("b")).where("a is not null")
    dense = ends.select(F.explode(F.sequence("a", "b")).alias("frame"))
    out = dense.join(per, "frame", "left")
    return out.select("frame", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"), F.coalesce("n_individual", F.lit(0)).alias("n_individual"), F.col("ids").isNull().alias("is_empty"))


def core_flags(frames: DataFrame, n: int) -> DataFrame:
    """Adds clean and core. Clean: n fragments, all individual. Core: clean, and the frame before has the same fragments or isn't clean; the first frame is none.

    Frames are dense, so each meets the one before it by an equality.
    """
    f = frames.withColumn("clean", (F.size("ids") == n) & (F.col("n_individual") == n))
    before = f.select((F.col("frame") + 1).alias("frame"), F.col("ids").alias("_ids"), F.col("clean").alias("_clean"))
    core = F.col("clean") & ((F.col("ids") == F.col("_ids")) | ~F.col("_clean"))
    return f.join(before, "frame", "left").withColumn("core", F.coalesce(core, F.lit(False))).drop("_ids", "_clean")


def core_starts(flags: DataFrame) -> DataFrame:
    """frame, ids: where cores begin. Their order numbers the global fragments."""
    before = flags.where("core").select((F.col("frame") + 1).alias("frame"))
    return ranked(flags.where("core").join(before, "frame", "left_anti").select("frame", "ids"), "frame", "global_fragment")


def global_fragments(starts: DataFrame, fragments: DataFrame) -> DataFrame:
    """global_fragment, start_frame, n_fragments, min_n_images, min_distance, accumulable. fragments: fragment_id, n_images, distance."""
    rows = starts.select("global_fragment", F.col("frame").alias("start_frame"), F.explode("ids").alias("fragment_id")).join(fragments, "fragment_id")
    out = rows.groupBy("global_fragment", "start_frame").agg(F.count("*").alias("n_fragments"), F.min("n_images").alias("min_n_images"), F.min("distance").alias("min_distance"))
    return out.withColumn("accumulable", F.col("min_n_images") >= 4)


def fragment_summary(detections: DataFrame) -> DataFrame:
    """fragment_id, start_frame, end_frame (exclusive), n_images, is_individual, distance: the length of each fragment's path."""
    w = Window.partitionBy("fragment_id").orderBy("frame", "instance_idx")
    step = F.sqrt(F.pow(F.col("cx") - F.lag("cx").over(w), 2) + F.pow(F.col("cy") - F.lag("cy").over(w), 2))
    d = detections.withColumn("_step", step).withColumn("_first", F.row_number().over(w) == 1)
    return d.groupBy("fragment_id").agg(
        F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"), F.count("*").alias("n_images"),
        (~F.max(F.col("_first") & F.col("is_overlapping"))).alias("is_individual"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("distance"),
    )


def episodes(spark, n_frames: int, per_episode: int) -> DataFrame:
    """episode, start_frame, end_frame: [0, n_frames) in parts of about equal length, no longer than per_episode but for rounding."""
    n = int(n_frames / (per_episode + 1)) + 1
    k = F.col("id")
    return spark.range(n).select(k.alias("episode"), F.floor(k * n_frames / n).alias("start_frame"), F.floor((k + 1) * n_frames / n).alias("end_frame"))


def data_episodes(frames: DataFrame, per_episode: int) -> DataFrame:
    """Episodes of all frames that there are: from 0, or the first frame if that is earlier, to the last."""
    ends = frames.agg(F.coalesce(F.least(F.min("frame"), F.lit(0)), F.lit(0)).alias("a"), F.coalesce(F.max("frame") + 1, F.lit(0)).alias("b")).first()
    a, n = int(ends["a"]), max(0, int(ends["b"] - ends["a"]))
    return episodes(frames.sparkSession, n, per_episode).select("episode", (F.col("start_frame") + a).alias("start_frame"), (F.col("end_frame") + a).alias("end_frame"))


def frame_episodes(frames: DataFrame, eps: DataFrame) -> DataFrame:
    """Adds each frame's episode: the last that starts at or before it.

    Frames and episodes meet by ranges of WIDTH frames, an equality; the last episode goes on to the last frame. The window over episodes sees a row for hundreds of frames.
    """
    until = eps.select("episode", F.col("start_frame").alias("_a"), F.lead("start_frame").over(Window.orderBy("start_frame", "episode")).alias("_b"))
    last = frames.agg((F.max("frame") + 1).alias("_last"))
    until = until.crossJoin(F.broadcast(last)).withColumn("_b", F.coalesce("_b", F.greatest(F.col("_last"), F.col("_a") + 1))).where("_b > _a").drop("_last")
    until = until.withColumn("_range", F.explode(F.sequence(F.floor(F.col("_a") / WIDTH), F.floor((F.col("_b") - 1) / WIDTH))))
    met = frames.withColumn("_range", F.floor(F.col("frame") / WIDTH)).join(until, "_range")
    return met.where((F.col("frame") >= F.col("_a")) & (F.col("frame") < F.col("_b"))).drop("_range", "_a", "_b")


def global_index(rows: DataFrame, episode: str, order: list[str]) -> DataFrame:
    """Adds global_index, 0..N-1 in the order of episodes and then `order`: a number within the episode and the rows of the episodes before."""
    counts = rows.groupBy(episode).agg(F.count("*").alias("_n"))
    before = counts.select(episode, (F.sum("_n").over(Window.orderBy(episode)) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(episode).orderBy(*order)) - 1
    return rows.join(before, episode).withColumn("global_index", F.col("_before") + own).drop("_before")


def crowded_frames(detections: DataFrame, most: int) -> DataFrame:
    """frame, n: frames of more than `most` detections."""
    return detections.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") > most)


def with_individuals(detections: DataFrame, least: int = 2) -> DataFrame:
    """frame, n_individual, n: frames that show at least `least` individuals; tracking needs one with two."""
    return detections.groupBy("frame").agg(F.count_if(~F.col("is_overlapping")).alias("n_individual"), F.count("*").alias("n")).where(F.col("n_individual") >= least)


def bijection_faults(rows: DataFrame, column: str) -> DataFrame:
    """One row of zeros if column numbers the rows 0..N-1: null, repeated and out-of-range values."""
    n = rows.agg(F.count("*").alias("_rows"))
    per = rows.groupBy(column).agg(F.count("*").alias("_n"))
    return per.crossJoin(F.broadcast(n)).agg(
        F.coalesce(F.sum(F.when(F.col(column).isNull(), F.col("_n"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"),
        F.count_if((F.col(column) < 0) | (F.col(column) >= F.col("_rows"))).alias("outside"),
    )


def episode_faults(eps: DataFrame, n_frames: int) -> DataFrame:
    """One row: frames of [0, n_frames) in no episode, frames in several, and neighbours that do not touch. All 0 for a tiling."""
    w = Window.orderBy("start_frame", "end_frame")
    touch = eps.select((F.col("start_frame") != F.lag("end_frame").over(w)).alias("_apart")).agg(F.count_if("_apart").alias("gaps"))
    per = eps.select(F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame")).groupBy("frame").agg(F.count("*").alias("_n"))
    inside = per.where((F.col("frame") >= 0) & (F.col("frame") < n_frames))
    return inside.agg((F.lit(n_frames) - F.count("*")).alias("uncovered"), F.count_if(F.col("_n") > 1).alias("covered_twice")).crossJoin(F.broadcast(touch))
