"""Identities matched between recordings: for every pair of sessions one optimal assignment, from what each one's model says of the other's images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.assignment import solve

SCHEMA = "session string, master string, identity long, assignment long, direct_score double, indirect_score double, agreement double"


def matrices(predictions: DataFrame) -> DataFrame:
    """session, master, identity, other, direct, indirect, joined: how often the two sides agree on a pair of identities, not 0.

    predictions: session (whose image it is), model (the session that judges it), identity (the image's), predicted. Direct counts are of
    the lesser session's images, indirect ones of the master's, turned about.
    """
    counts = predictions.where("session <> model").groupBy("session", "model", "identity", "predicted").agg(F.count("*").alias("n"))
    own = F.col("session") < F.col("model")
    turned = counts.select(
        F.least("session", "model").alias("session"), F.greatest("session", "model").alias("master"), F.when(own, F.col("identity")).otherwise(F.col("predicted")).alias("identity"),
        F.when(own, F.col("predicted")).otherwise(F.col("identity")).alias("other"), F.when(own, F.col("n")).otherwise(0).alias("direct"), F.when(own, 0).otherwise(F.col("n")).alias("indirect"),
    )
    out = turned.groupBy("session", "master", "identity", "other").agg(F.sum("direct").alias("direct"), F.sum("indirect").alias("indirect"))
    return out.withColumn("joined", F.col("direct") + F.col("indirect"))


def best_columns(counts: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of an assignment with the greatest sum; of unequal numbers only the lesser is assigned."""
    n, m = counts.shape
    square = np.zeros((max(n, m),) * 2)
    square[:n, :m] = counts
    return [(i, j) for i, j in enumerate(solve(square.max(initial=0) - square)) if i < n and j < m]


def score(row: np.ndarray, chosen: int) -> float:
    """How far the chosen one is ahead of the best other, over the greatest; 0 where nothing was counted."""
    most = row.max()
    return float((row[chosen] - np.delete(row, chosen).max(initial=0)) / most) if most else 0.0


def matched(found: DataFrame, sessions: DataFrame) -> DataFrame:
    """SCHEMA, for every pair of sessions of which matrices holds anything. sessions: session, n_animals; identities are 0 .. n_animals - 1.

    Of as many animals on both sides both counts decide, otherwise those of the side that has fewer, as each of its animals has to be
    on the other side too. A group is a table of two sessions' animals.
    """
    n = lambda c: sessions.select(F.col("session").alias(c), F.col("n_animals").alias(f"n_{c}"))
    rows = found.join(n("session"), "session").join(n("master"), "master")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shape = int(group["n_session"].iloc[0]), int(group["n_master"].iloc[0])
        direct, indirect = np.zeros(shape), np.zeros(shape)
        for table, column in ((direct, "direct"), (indirect, "indirect")):
            table[group["identity"], group["other"]] = group[column]
        joined = direct + indirect
        pairs = best_columns(joined if shape[0] == shape[1] else indirect if shape[0] > shape[1] else direct)
        total = joined[[i for i, _ in pairs]].sum()
        agreement = float(sum(joined[i, j] for i, j in pairs) / total) if total else 0.0
        out = [(key[0], key[1], i, j, score(direct[i], j), score(indirect[:, j], i), agreement) for i, j in pairs]
        return pd.DataFrame(out, columns=["session", "master", "identity", "assignment", "direct_score", "indirect_score", "agreement"])

    return rows.groupBy("session", "master").applyInPandas(run, SCHEMA)


def write(found: DataFrame, path: str) -> None:
    """A folder for each pair of sessions with its assignments as csv."""
    found.repartition("session", "master").write.mode("overwrite").partitionBy("session", "master").option("header", True).csv(path)
