"""Orders, quotas and samples. Samples go by a seeded arithmetic hash, so each run and each engine draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.order import ranked, running_sum
from threadloom.sources.tables import settled


def lot(key: Column, seed: int = 1) -> Column:
    """A number below 2^31 - 1 that looks random: two rounds of a multiplicative generator."""
    m = F.lit(2147483647)
    return ((key % m * 48271 + seed) % m * 16807 + 12345) % m


def sample(rows: DataFrame, key: str, n: int, by: list[str] | None = None, seed: int = 1) -> DataFrame:
    """n rows without replacement, or n of each group of `by`. A group is ranked by pieces first, so no task sees a whole large group."""
    if not by:
        return rows.withColumn("_lot", lot(F.col(key), seed)).orderBy("_lot", key).limit(n).drop("_lot")
    piece = F.pmod(F.hash(key), F.lit(64))
    first = Window.partitionBy(*by, "_piece").orderBy("_lot", key)
    r = rows.withColumn("_lot", lot(F.col(key), seed)).withColumn("_piece", piece).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    return r.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_lot", key))).where(F.col("_r") <= n).drop("_lot", "_piece", "_r")


def weighted_probabilities(pairs: DataFrame, size: str, score: str) -> DataFrame:
    """Adds probability: half by size and half by score, and cumulative, its running sum in the order of pair_id, for drawing by a range."""
    totals = pairs.agg(F.sum(size).alias("_size"), F.sum(score).alias("_score"))
    p = (F.coalesce(F.try_divide(F.col(size), F.col("_size")), F.lit(0.0)) + F.coalesce(F.try_divide(F.col(score), F.col("_score")), F.lit(0.0))) / 2
    out = pairs.crossJoin(F.broadcast(totals)).withColumn("probability", p).drop("_size", "_score")
    return running_sum(out, "pair_id", "probability", "cumulative")


def stratified_split(rows: DataFrame, key: str, by: str, share: float, seed: int = 1) -> DataFrame:
    """Adds is_train: of each class, the first int(share * n + 0.99) rows by lot."""
    n = rows.groupBy(by).agg(F.count("*").alias("_n"))
    r = rows.join(n, by).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(lot(F.col(key), seed), key)))
    return r.withColumn("is_train", F.col("_r") <= F.floor(share * F.col("_n") + 0.99)).drop("_n", "_r")


def class_weights(rows: DataFrame, by: str) -> DataFrame:
    """by, n, weight: 1 - share of the class."""
    n, total = rows.groupBy(by).agg(F.count("*").alias("n")), rows.agg(F.count("*").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select(by, "n", (1 - F.col("n") / F.col("_all")).alias("weight"))


def capped(rows: DataFrame, key: str, by: str, most: int, share: float, seed: int = 1) -> DataFrame:
    """by, key, is_train, weight: at most `most` rows of each class by lot, of which the first int(share * n + 0.99) train; a class weighs 1 - its share of those that do.

    Classes may be few and large: what is ranked together is the rows that are left of one.
    """
    some = settled(stratified_split(sample(rows.select(by, key), key, most, [by], seed), key, by, share, seed + 1), "capped")
    return some.join(class_weights(some.where("is_train"), by).select(by, "weight"), by).select(by, key, "is_train", "weight")


def old_and_new(images: DataFrame, most: int, share_new: float) -> DataFrame:
    """The images to train on: of each identity up to `most`, a share of new ones; what one kind lacks the other fills. images: image_id, identity, is_new."""
    counts = images.groupBy("identity").agg(F.count_if("is_new").alias("_new"), F.count_if(~F.col("is_new")).alias("_old"))
    want = F.least(F.floor(F.lit(most * share_new)), F.col("_new"))
    old = F.least(F.lit(most) - want, F.col("_old"))
    new = F.least(F.lit(most) - old, F.col("_new"))
    r = images.join(counts, "identity").withColumn("_r", F.row_number().over(Window.partitionBy("identity", "is_new").orderBy(lot(F.col("image_id")), "image_id")))
    return r.where(F.col("_r") <= F.when(F.col("is_new"), new).otherwise(old)).select(*images.columns)


def ordered_from(fragments: DataFrame, frame: int, scope: str) -> DataFrame:
    """Fragments before a frame, latest end first, or after it, earliest start first."""
    if scope == "past":
        return fragments.where(F.col("end_frame") <= frame).orderBy(F.desc("end_frame"), "fragment_id")
    if scope == "future":
        return fragments.where(F.col("start_frame") >= frame).orderBy("start_frame", "fragment_id")
    raise ValueError(f"unknown scope: {scope}")


def interleaved(frames: DataFrame, n: str = "_n") -> DataFrame:
    """frame, position: first, last, second, last but one, and so on."""
    f = ranked(frames, "frame", "_i").crossJoin(F.broadcast(frames.agg(F.count("*").alias(n))))
    front = F.col("_i") < F.ceil(F.col(n) / 2)
    return f.select("frame", F.when(front, 2 * F.col("_i")).otherwise(2 * (F.col(n) - 1 - F.col("_i")) + 1).alias("position"))
