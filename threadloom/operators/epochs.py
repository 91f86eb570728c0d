"""When training ends: a rule over tables of epochs, for any number of runs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Limits:
    """epochs: none goes on beyond so many. patience: epochs before anything else ends a run, and one more than those of a trend. worse: rises in a row. plateau: of the loss."""

    epochs: int
    patience: int = 10
    worse: int = 5
    plateau: float = 0.01


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with epoch, from 0 in each run."""
    return rows.withColumn("epoch", (F.row_number().over(Window.partitionBy("run").orderBy(order)) - 1).cast("long")).drop(order)


def stops(rows: DataFrame, limits: Limits) -> DataFrame:
    """run, epoch, reason of the first epoch of each run that ends it. rows: run, epoch (from 0, without gaps), train_loss, loss, accuracy.

    A run diverges where a loss is no number after the second epoch. The trend is the mean of the losses before; where all are no
    numbers it is infinite. A loss above it is a rise, and any other starts the count of rises anew.
    """
    run = Window.partitionBy("run").orderBy("epoch")
    number = F.when(~F.isnan("loss"), F.col("loss"))
    t = rows.withColumn("trend", F.coalesce(F.avg(number).over(run.rowsBetween(1 - limits.patience, -1)), F.lit(float("inf"))))
    judged = F.col("epoch") > limits.patience
    up = judged & F.coalesce(F.col("trend") < number, F.lit(False))
    t = t.withColumn("up", up).withColumn("since", F.sum((judged & ~F.col("up")).cast("int")).over(run))
    t = t.withColumn("rising", F.sum(F.col("up").cast("int")).over(Window.partitionBy("run", "since").orderBy("epoch")))
    reason = (
        F.when((F.col("epoch") > 1) & (F.isnan("train_loss") | F.isnan("loss")), "diverged")
        .when(F.col("epoch") >= limits.epochs, "epochs")
        .when(judged & F.col("up") & (F.col("rising") >= limits.worse), "overfitting")
        .when(judged & (F.abs(F.col("trend") - F.col("loss")) < limits.plateau * F.col("loss")), "plateau")
        .when(judged & (F.col("accuracy") == 1), "accuracy")
        .when(judged & ((F.col("trend") == 0) | (F.col("loss") == 0)), "zero loss")
    )
    ended = t.withColumn("reason", reason).where("reason is not null")
    return ended.groupBy("run").agg(F.min("epoch").alias("epoch"), F.min_by("reason", "epoch").alias("reason"))
