"""Global numbers and running sums without a task that sees all rows: by ranges of the key, whose totals alone are added up in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.sources.tables import settled

#: Values of the key in a range.
WIDTH = 1 << 12


def _ranged(rows: DataFrame, key: str, width: int) -> DataFrame:
    """rows with the range of their key, as a table, as they are read twice."""
    return settled(rows.withColumn("_range", F.floor(F.col(key) / width)), "ranges")


def ranked(rows: DataFrame, key: str, name: str, then: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """Adds name: the row's number from 0 in the order of key (a whole number) and `then`. What passes one task is a row for each range of keys."""
    r = _ranged(rows, key, width)
    totals = r.groupBy("_range").agg(F.count("*").alias("_n"))
    before = totals.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key, *then)) - 1
    return r.withColumn("_own", own).join(before, "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def running_sum(rows: DataFrame, key: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds name: the sum of value over the rows of no greater key."""
    r = _ranged(rows, key, width)
    totals = r.groupBy("_range").agg(F.sum(value).alias("_n"))
    before = totals.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(key))
    return r.withColumn("_own", own).join(before, "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """One row: for each column an array of its values at these shares of its order, linearly interpolated, exact; null where it has none.

    Each value is counted first; then ranges of values are tables of their own, of which totals alone are added up in one place, and
    those that hold a value asked for are read once more.
    """
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("e")).select("e.*")
    counts = each.where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = settled(counts.repartitionByRange(parts, "name", "value").withColumn("_range", F.spark_partition_id()), "ranges")
    totals = r.groupBy("name", "_range").agg(F.sum("n").alias("_n"))
    own = Window.partitionBy("name")
    upto = F.sum("_n").over(own.orderBy("_range"))
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)))).alias("_s")
    # a few rows: a share's place, and the ranges that hold the values below and above it
    places = totals.select("name", "_range", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.sum("_n").over(own).alias("_all")).select("*", asked)
    at = (F.col("_all") - 1) * F.col("_s.share")
    places = places.select("name", "_range", "_before", "_upto", F.col("_s.k").alias("k"), at.alias("_at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_rank")).where("_rank >= _before and _rank < _upto")
    held = r.join(F.broadcast(places.select("name", "_range").distinct()), ["name", "_range"], "left_semi").withColumn("_end", F.sum("n").over(Window.partitionBy("name", "_range").orderBy("value")))
    found = held.join(F.broadcast(places), ["name", "_range"]).where((F.col("_before") + F.col("_end") > F.col("_rank")) & (F.col("_before") + F.col("_end") - F.col("n") <= F.col("_rank")))
    ends = found.groupBy("name", "k").agg(F.min("value").alias("_a"), F.max("value").alias("_b"), F.first("_at").alias("_at"))
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.floor("_at")) * F.col("_b"))
    ends = ends.select("name", "k", value.alias("value"))
    lists = [F.array(*(F.max(F.when((F.col("name") == c) & (F.col("k") == k), F.col("value"))) for k in range(len(shares)))) for c in columns]
    return ends.agg(*(x.alias(c) for c, x in zip(columns, lists, strict=True)))
