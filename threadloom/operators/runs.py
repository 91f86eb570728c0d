"""Runs, gaps, speeds and errors of per-frame series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.order import quantiles

#: Frames in a range within which positions meet.
SPAN = 64


def islands(rows: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """keys, start, length: maximal runs of consecutive frames. Frames are distinct within keys."""
    island = F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame))
    return rows.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(frame).alias("start"), F.count("*").alias("length")).drop("_island")


def gaps(rows: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """keys, start, length: runs of frames that are absent between a key's first and last."""
    w = Window.partitionBy(*keys).orderBy(frame)
    return rows.select(*keys, (F.col(frame) + 1).alias("start"), (F.lead(frame).over(w) - F.col(frame) - 1).alias("length")).where("length > 0")


def event_groups(rows: DataFrame, keys: list[str], value: str, frame: str = "frame") -> DataFrame:
    """keys, start, end, n_frames, min_value, at_frame: consecutive flagged frames as events, with each event's least value and the first frame of it."""
    w = Window.partitionBy(*keys).orderBy(frame)
    new = F.coalesce((F.col(frame) - F.lag(frame).over(w) > 1).cast("int"), F.lit(0))
    rows = rows.withColumn("_new", new).withColumn("_event", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_event").agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("n_frames"), F.min(value).alias("min_value"), F.min_by(frame, F.struct(value, frame)).alias("at_frame")).drop("_event")


def speeds(tracks: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Adds step (frames since the key's position before) and speed (distance by step); null at a key's first."""
    w = Window.partitionBy(*keys).orderBy(frame)
    step = F.col(frame) - F.lag(frame).over(w)
    distance = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return tracks.withColumn("step", step).withColumn("speed", distance / F.col("step"))


def impossible_jumps(moved: DataFrame, tolerance: float, accepted: DataFrame | None = None) -> DataFrame:
    """The rows whose speed is above the mean by more than `tolerance` population standard deviations, without those that a user has accepted (individual, frame). The statistics are one row, so they are broadcast."""
    limit = moved.agg((F.avg("speed") + tolerance * F.stddev_pop("speed")).alias("_limit"))
    found = moved.join(F.broadcast(limit), F.col("speed") > F.col("_limit")).drop("_limit")
    return found if accepted is None else found.join(accepted, ["individual", "frame"], "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows share, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def error_report(missing: DataFrame, unidentified: DataFrame, duplicated: DataFrame, jumps: DataFrame) -> DataFrame:
    """kind, individual, start, length: the four kinds of errors in one table. Inputs: individual, start, length."""
    named = [df.select(F.lit(kind).alias("kind"), "individual", "start", "length") for kind, df in (("Miss id", missing), ("No id", unidentified), ("Dupl", duplicated), ("Jump", jumps))]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


def interpolated(tracks: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """keys, frame, x, y: the positions, and in the gaps between them points on straight lines. Runs of frames are made key by key from neighbours, so there is no grid to fill."""
    w = Window.partitionBy(*keys).orderBy(frame)
    ahead = lambda c: F.lead(c).over(w)
    t = tracks.select(*keys, frame, "x", "y", ahead(frame).alias("_f"), ahead("x").alias("_x"), ahead("y").alias("_y"))
    t = t.withColumn("_at", F.explode(F.sequence(F.col(frame), F.greatest(F.col(frame), F.coalesce(F.col("_f") - 1, F.col(frame))))))
    share = (F.col("_at") - F.col(frame)) / (F.col("_f") - F.col(frame))
    on = lambda a, b: F.when(F.col("_at") == F.col(frame), F.col(a)).otherwise(F.col(a) + share * (F.col(b) - F.col(a)))
    return t.select(*keys, F.col("_at").alias(frame), on("x", "_x").alias("x"), on("y", "_y").alias("y"))


def velocity_threshold(moved: DataFrame, percentile: float = 0.99) -> DataFrame:
    """One row: twice the percentile of all speeds, linearly interpolated."""
    return quantiles(moved, ["speed"], [percentile]).select((2 * F.col("speed")[0]).alias("velocity_threshold"))


def rising_edges(flags: DataFrame, flag: str, keys: list[str], frame: str = "frame") -> DataFrame:
    """The rows where flag turns true."""
    before: Column = F.lag(flag, 1, False).over(Window.partitionBy(*keys).orderBy(frame))
    return flags.withColumn("_before", before).where(F.col(flag) & ~F.col("_before")).drop("_before")


def swap_checks(tracks: DataFrame, frame: str = "frame") -> DataFrame:
    """individual, frame, nearest, distance, own_distance: positions nearer to where another individual was last seen than to where the own one was.

    Last positions are those of the row before, for each of the other individuals that were ever seen before the frame.
    A position is the last one up to its individual's next, in every range of SPAN frames on the way; positions meet by range.
    """
    w = Window.partitionBy("individual").orderBy(frame)
    end = tracks.agg(F.max(frame).alias("_end"))
    spans = tracks.select(F.col("individual").alias("other"), F.col(frame).alias("_from"), F.lead(frame).over(w).alias("_to"), F.col("x").alias("_x"), F.col("y").alias("_y")).crossJoin(F.broadcast(end))
    spans = spans.withColumn("_to", F.coalesce("_to", "_end")).drop("_end").where("_to > _from")
    spans = spans.withColumn("_range", F.explode(F.sequence(F.floor((F.col("_from") + 1) / SPAN), F.floor(F.col("_to") / SPAN))))
    met = tracks.withColumn("_range", F.floor(F.col(frame) / SPAN)).join(spans, "_range").where((F.col("_from") < F.col(frame)) & (F.col(frame) <= F.col("_to")))
    far = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    per = met.groupBy("individual", frame).agg(F.min_by("other", F.struct(far, "other")).alias("nearest"), F.min(far).alias("distance"), F.min(F.when(F.col("other") == F.col("individual"), far)).alias("own_distance"))
    return per.where("nearest <> individual and own_distance is not null")
