"""Reading and writing trajectories: long rows (frame, time, individual, x, y, probability), and tables that are wide or packed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIDY = "frame long, time double, individual int, x double, y double, probability double"
#: What may stand behind a folder's name, in the order in which a reader tries them.
FORMATS = ("parquet", "csv_tidy", "json")


def timed(tracks: DataFrame, fps: float | None) -> DataFrame:
    """tracks with time = frame / fps; no or zero frames per second count as one."""
    return tracks.select(F.col("frame").cast("long").alias("frame"), (F.col("frame") / F.lit(float(fps or 1))).alias("time"), F.col("individual").cast("int").alias("individual"), "x", "y", "probability")


def wide(tracks: DataFrame, individuals: int, fps: float | None = 1, axes: tuple[str, ...] = ("x", "y"), digits: int = 3, form: str = "f") -> DataFrame:
    """time, x1, y1, x2, ...: a row per frame, numbers as text with `digits` decimals, null where missing. Individuals are a fixed number, so one aggregation does it.

    form: "f" for plain decimals or "e" for powers of ten, as probabilities are written (axes ("probability",)).
    """
    at = lambda a, k: F.max(F.when(F.col("individual") == k, F.col(a)))
    names = [f"{a}{k + 1}" for k in range(individuals) for a in axes]
    rows = timed(tracks, fps).groupBy("frame").agg(F.first("time").alias("time"), F.array(*(at(a, k).cast("double") for k in range(individuals) for a in axes)).alias("_values"))
    rows = rows.select("frame", printed(digits, "f")(F.array("time"))[0].alias("time"), printed(digits, form)("_values").alias("_values"))
    return rows.select("frame", "time", *(F.col("_values")[k].alias(name) for k, name in enumerate(names)))


def printed(digits: int, form: str):
    """Arrays of numbers as text. Halves are decided by the number as it is stored: format_string goes by its shortest decimal, and writes 1.0625 or 1.2345 one up."""

    @F.pandas_udf("array<string>")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda row: [None if v is None or v != v else f"{v:.{digits}{form}}" for v in row])

    return of


def long(wide_rows: DataFrame, individuals: int) -> DataFrame:
    """frame, individual, x, y from a wide table with a column frame; positions that are missing give no row."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("individual"), F.col(f"x{k + 1}").cast("double").alias("x"), F.col(f"y{k + 1}").cast("double").alias("y")) for k in range(individuals))))
    return wide_rows.select("frame", each.alias("e")).select("frame", "e.*").where("x is not null or y is not null")


def save(tracks: DataFrame, path: str, formats: tuple[str, ...], fps: float | None = None, attributes: dict | None = None) -> list[str]:
    """Writes path.<format> for each known format and returns what it could not write. Attributes go beside as one row of JSON."""
    unknown, rows = [], timed(tracks, fps)
    for name in formats:
        if name == "parquet":
            rows.write.mode("overwrite").parquet(f"{path}.parquet")
        elif name == "csv_tidy":
            rows.write.mode("overwrite").option("header", True).csv(f"{path}.csv_tidy")
        elif name == "json":
            rows.write.mode("overwrite").json(f"{path}.json")
        else:
            unknown.append(name)
    if attributes is not None:
        rows.sparkSession.createDataFrame([(json.dumps(attributes),)], "value string").write.mode("overwrite").text(f"{path}.attributes")
    return unknown


def load(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The trajectories of a path in a format, or in the first format that is there."""
    readers = {"parquet": lambda p: spark.read.schema(TIDY).parquet(p), "csv_tidy": lambda p: spark.read.schema(TIDY).option("header", True).csv(p), "json": lambda p: spark.read.schema(TIDY).json(p)}
    jvm = spark.sparkContext._jvm
    for f in [name] if name else FORMATS:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}.{f}")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return readers[f](f"{path}.{f}")
    raise FileNotFoundError(path)


def convert(spark: SparkSession, path: str, formats: tuple[str, ...], fps: float | None = None) -> list[str]:
    return save(load(spark, path), path, formats, fps)


def run_lengths(values: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, runs: an array of (value, n) of equal neighbours, the compact form of a column of few values."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    r = values.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(key, "_run").agg(F.first(value).alias("value"), F.count("*").alias("n"))
    return r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_run", "value", "n"))).alias("_runs")).select(key, F.transform("_runs", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("runs"))


def from_run_lengths(packed: DataFrame, key: str) -> DataFrame:
    """key, position, value: run_lengths undone."""
    values = F.flatten(F.transform("runs", lambda x: F.array_repeat(x["value"], x["n"].cast("int"))))
    return packed.select(key, F.posexplode(values).alias("position", "value"))
