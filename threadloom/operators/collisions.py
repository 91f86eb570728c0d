"""Who keeps an identity that several detections of a frame claim, and what became of every detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_collisions(detections: DataFrame) -> DataFrame:
    """Adds outcome: one of kept, unassigned, all_overlapping, by_length, by_p1, unresolved; only `kept` keeps its identity.

    A cell is a frame and an identity above 0. A lone claimant keeps it. If all claimants overlap, none does. Claimants of
    one-image fragments (overlapping ones count as such) yield to longer ones, and a single longer one keeps it.
    Otherwise the greatest finite p1_max keeps it, unless it is shared or there is none. Fragment sizes count all rows.
    Losers say what decided the cell.
    """
    sizes = detections.groupBy("fragment_id").agg(F.count("*").alias("_size"))
    d = detections.join(sizes, "fragment_id", "left")
    p1 = F.when(~F.isnan("p1_max") & (F.abs("p1_max") < float("inf")), F.col("p1_max"))
    d = d.select(*detections.columns, F.when(F.col("is_overlapping"), F.lit(1)).otherwise(F.coalesce("_size", F.lit(1))).alias("_long"), p1.alias("_p1"), (F.coalesce("identity", F.lit(0)) > 0).alias("_in"))
    cell = Window.partitionBy("frame", "identity", "_in")
    d = d.select("*", F.count("*").over(cell).alias("_n"), F.min("is_overlapping").over(cell).alias("_all_over"), F.max("_long").over(cell).alias("_longest"))
    runs = (F.col("_longest") == 1) | (F.col("_long") > 1)
    d = d.withColumn("_runs", runs)
    d = d.select("*", F.count_if("_runs").over(cell).alias("_runners"), F.max(F.when(F.col("_runs"), F.col("_p1"))).over(cell).alias("_best"))
    best = F.col("_runs") & (F.col("_p1") == F.col("_best"))
    d = d.withColumn("_is_best", F.coalesce(best, F.lit(False)))
    d = d.withColumn("_bests", F.count_if("_is_best").over(cell))
    outcome = (
        F.when(~F.col("_in"), "unassigned").when(F.col("_n") == 1, "kept").when(F.col("_all_over"), "all_overlapping")
        .when(F.col("_runners") == 1, F.when(F.col("_runs"), "kept").otherwise("by_length"))
        .when(F.col("_bests") == 1, F.when(F.col("_is_best"), "kept").otherwise("by_p1")).otherwise("unresolved")
    )
    return d.select(*detections.columns, outcome.alias("outcome"))


def cell_outcomes(resolved: DataFrame) -> DataFrame:
    """How the contested cells were decided: counts of cells by rule."""
    loser = F.max(F.when(F.col("outcome") != "kept", F.col("outcome")))
    cells = resolved.where("identity > 0").groupBy("frame", "identity").agg(F.count("*").alias("n"), loser.alias("rule"))
    return cells.where("n > 1").groupBy("rule").agg(F.count("*").alias("cells"))


def reconciliation(resolved: DataFrame) -> DataFrame:
    """One row: instances = tracked + identity 0 + collided."""
    return resolved.agg(
        F.count("*").alias("instances"), F.count_if(F.col("outcome") == "kept").alias("tracked"), F.count_if(F.col("outcome") == "unassigned").alias("identity_0"),
        F.count_if(~F.col("outcome").isin("kept", "unassigned")).alias("collided"),
    )


def full_reconciliation(instances: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: instances = tracked + no_row + identity 0 + collided. instances: frame, instance_idx, with those that no row stands for."""
    none = instances.join(resolved.select("frame", "instance_idx"), ["frame", "instance_idx"], "left_anti").agg(F.count("*").alias("no_row"))
    n = instances.agg(F.count("*").alias("instances"))
    return n.crossJoin(F.broadcast(none)).crossJoin(F.broadcast(reconciliation(resolved).drop("instances"))).select("instances", "tracked", "no_row", "identity_0", "collided")


def trajectories(resolved: DataFrame) -> DataFrame:
    """frame, individual (0-based), x, y, probability: of the detections that keep their identity."""
    return resolved.where("outcome = 'kept'").select("frame", (F.col("identity") - 1).alias("individual"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.coalesce("p1_max", F.lit(0.0)).alias("probability"))


def compare_assignments(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Full outer comparison by (frame, instance_idx): counts of missing, extra, mismatched and equal rows."""
    both = expected.alias("e").join(got.alias("g"), ["frame", "instance_idx"], "full_outer")
    kind = F.when(F.col("g.identity").isNull(), "missing").when(F.col("e.identity").isNull(), "extra").when(F.col("e.identity") != F.col("g.identity"), "mismatch").otherwise("equal")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
