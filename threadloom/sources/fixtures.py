"""Tracking frames as views over the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.sources.tables import table


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection for each event: hours are frames, users are fragments, errors overlap."""
    e = table(spark, sf_dir, "events")
    frame = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("long")
    over = F.col("event_type") == "error"
    return e.select(
        "event_id", frame.alias("frame"), F.col("value").alias("cx"), (F.col("event_id") % 997).cast("double").alias("cy"),
        (F.col("user_id") % 6).alias("identity"), F.col("user_id").alias("fragment_id"), over.alias("is_overlapping"),
        F.when(~over, F.round(F.col("value") / 500, 4)).alias("p1_max"),
    ).withColumn("instance_idx", F.row_number().over(Window.partitionBy("frame").orderBy("event_id")) - 1)


def frame_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, fragment_id, is_overlapping: one row where a fragment shows in a frame; it overlaps if all its events are errors."""
    e = detections(spark, sf_dir)
    return e.groupBy("frame", (F.col("fragment_id") % 3 * 1000 + F.floor(F.col("frame") / 50)).alias("fragment_id")).agg(F.min("is_overlapping").alias("is_overlapping"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open intervals of videos: an order's days are a fragment's frames."""
    o = table(spark, sf_dir, "orders")
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return o.select(F.col("o_orderkey").alias("fragment_id"), (F.col("o_custkey") % 50).alias("video_id"), start.alias("start_frame"), (start + 1 + F.col("o_orderkey") % 7).alias("end_frame"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fragment_id, identity (1..7), n_images: line numbers are votes of an order."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fragment_id"), F.col("l_linenumber").cast("long").alias("identity")).agg(F.count("*").alias("n_images"))


def supplier_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes that saturate: three identities by quantity for each supplier."""
    identity = F.when(F.col("l_quantity") < 20, 1).when(F.col("l_quantity") < 45, 2).otherwise(3).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("fragment_id"), identity.alias("identity")).agg(F.count("*").alias("n_images"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, next: a user's next event, if it has the same type; else null."""
    follow = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.lead("event_id").over(follow).alias("next"), F.lead("event_type").over(follow).alias("next_type"))
    return e.select(F.col("event_id").alias("node"), F.when(F.col("next_type") == F.col("event_type"), F.col("next")).alias("next"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").cast("long").alias("label"))


#: The same views for the oracle, each to stand in a WITH clause.
SQL = {
    "detections": """detections AS (SELECT event_id, date_diff('day', DATE '2024-01-01', ts::DATE) * 24 + hour(ts) AS frame, value AS cx, (event_id % 997)::DOUBLE AS cy, user_id % 6 AS identity,
  user_id AS fragment_id, event_type = 'error' AS is_overlapping, CASE WHEN event_type <> 'error' THEN round(value / 500, 4) END AS p1_max,
  row_number() OVER (PARTITION BY date_diff('day', DATE '2024-01-01', ts::DATE) * 24 + hour(ts) ORDER BY event_id) - 1 AS instance_idx FROM events)""",
    "states": "states AS (SELECT frame, fragment_id % 3 * 1000 + frame // 50 AS fragment_id, bool_and(is_overlapping) AS is_overlapping FROM detections GROUP BY ALL)",
    "fragments": """fragments AS (SELECT o_orderkey AS fragment_id, o_custkey % 50 AS video_id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS start_frame,
  date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 1 + o_orderkey % 7 AS end_frame FROM orders)""",
    "votes": "votes AS (SELECT l_orderkey AS fragment_id, l_linenumber AS identity, count(*) AS n_images FROM lineitem GROUP BY ALL)",
    "supplier_votes": "supplier_votes AS (SELECT l_suppkey AS fragment_id, CASE WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 45 THEN 2 ELSE 3 END AS identity, count(*) AS n_images FROM lineitem GROUP BY ALL)",
    "links": """links AS (SELECT event_id AS node, CASE WHEN lead(event_type) OVER w = event_type THEN lead(event_id) OVER w END AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "vectors": "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings)",
}
