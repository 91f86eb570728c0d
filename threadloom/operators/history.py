"""The graph of blobs that overlap from frame to frame: degrees, what lies along each blob's single links, and fragments of blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.blobs import link_degrees, one_to_one
from threadloom.operators.links import chains
from threadloom.sources.tables import settled, spread


def _walks(blobs: DataFrame, links: DataFrame, ahead: str, behind: str) -> DataFrame:
    """blob_id, multiple, crossing: along the way from a blob over its only links until a blob that has none or several.

    multiple: the way has a step and ends where there are several links. crossing: some blob from the second step on is entered by
    several and no individual. blobs: blob_id, seems_individual, and the degrees named `ahead` and `behind`; links: source, target.
    Ways are followed by doubled steps: each table knows where 2^k steps lead and what they pass, for the ways that have not ended.
    """
    first = links.groupBy(F.col("source").alias("blob_id")).agg(F.min("target").alias("to"))
    b = blobs.select("blob_id", F.col(ahead).alias("n"), (F.col(behind) > 1).alias("_entered"), "seems_individual")
    met = b.select(F.col("blob_id").alias("to"), (F.col("_entered") & ~F.col("seems_individual")).alias("met"))
    # a blob of one link goes to it; every other stays where it is
    now = b.join(first, "blob_id", "left").withColumn("to", F.when(F.col("n") == 1, F.col("to")).otherwise(F.col("blob_id")))
    now = settled(now.join(met, "to", "left").select("blob_id", "to", (F.coalesce("met", F.lit(False)) & (F.col("to") != F.col("blob_id"))).alias("met"), (F.col("to") != F.col("blob_id")).alias("on")), "walks")
    # ways that ended are tables that stay as they are; only those that go on are joined and written again
    ended, going = now.where("not on").drop("on"), now.where("on").drop("on")
    # no way is longer than there are blobs, unless it goes round
    for _ in range(now.count().bit_length() + 1):
        step = ended.unionByName(going).select(F.col("blob_id").alias("to"), F.col("to").alias("_to"), F.col("met").alias("_met"))
        now = settled(going.join(step, "to").select("blob_id", F.col("_to").alias("to"), (F.col("met") | F.col("_met")).alias("met"), (F.col("_to") != F.col("to")).alias("on")), "walks")
        ended, going = ended.unionByName(now.where("not on").drop("on")), now.where("on").drop("on")
        if going.isEmpty():
            break
    now = ended.unionByName(going)
    end = b.select(F.col("blob_id").alias("to"), F.col("n").alias("_n"))
    multiple = now.join(end, "to").select("blob_id", ((F.col("to") != F.col("blob_id")) & (F.col("_n") > 1)).alias("multiple"))
    crossing = first.join(now.select(F.col("blob_id").alias("to"), "met"), "to").select("blob_id", F.col("met").alias("crossing"))
    return multiple.join(crossing, "blob_id", "left").select("blob_id", "multiple", F.coalesce("crossing", F.lit(False)).alias("crossing"))


def link_history(blobs: DataFrame, links: DataFrame) -> DataFrame:
    """blob_id, n_next, n_previous, multiple_next, next_crossing, multiple_previous, previous_crossing, sure_individual, sure_crossing. blobs: blob_id, seems_individual; links: source, target.

    A sure individual seems one, is linked one to one on both sides, and comes from a crossing and goes to one. A sure
    crossing does not seem one and has several links on a side, or ways on both sides that end in several.
    """
    b = settled(link_degrees(blobs.select("blob_id", "seems_individual"), links), "history-blobs")
    ahead = _walks(b, links, "n_next", "n_previous").select("blob_id", F.col("multiple").alias("multiple_next"), F.col("crossing").alias("next_crossing"))
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"))
    behind = _walks(b, back, "n_previous", "n_next").select("blob_id", F.col("multiple").alias("multiple_previous"), F.col("crossing").alias("previous_crossing"))
    degree = b.select("blob_id", "n_next", "n_previous")
    ends = links.join(degree.select(F.col("blob_id").alias("target"), F.col("n_previous").alias("_in")), "target").groupBy(F.col("source").alias("blob_id")).agg(F.max("_in").alias("_in"))
    starts = links.join(degree.select(F.col("blob_id").alias("source"), F.col("n_next").alias("_out")), "source").groupBy(F.col("target").alias("blob_id")).agg(F.max("_out").alias("_out"))
    h = b.join(ahead, "blob_id").join(behind, "blob_id").join(ends, "blob_id", "left").join(starts, "blob_id", "left")
    alone = (F.col("n_next") == 1) & (F.col("n_previous") == 1) & (F.coalesce("_in", F.lit(0)) == 1) & (F.coalesce("_out", F.lit(0)) == 1)
    sure = F.col("seems_individual") & alone & F.col("previous_crossing") & F.col("next_crossing")
    crossing = ~F.col("seems_individual") & ((F.col("n_previous") > 1) | (F.col("n_next") > 1) | (F.col("multiple_previous") & F.col("multiple_next")))
    return h.select("blob_id", "n_next", "n_previous", "multiple_next", "next_crossing", "multiple_previous", "previous_crossing", sure.alias("sure_individual"), crossing.alias("sure_crossing"))


def blob_fragments(blobs: DataFrame, links: DataFrame) -> DataFrame:
    """blob_id, fragment (its first blob), position: maximal runs of blobs linked one to one, of one class and one region. blobs: blob_id, class_id, region; links: source, target."""
    classes = blobs.select("blob_id", F.struct("class_id", "region").alias("class_id"))
    kept = one_to_one(link_degrees(classes, links), links)
    nodes = blobs.select(F.col("blob_id").alias("node")).join(kept.select(F.col("source").alias("node"), F.col("target").alias("next")), "node", "left")
    return chains(nodes, check=False).select(F.col("node").alias("blob_id"), F.col("chain").alias("fragment"), "position")


def overlapping_boxes(boxes: DataFrame, cell: float) -> DataFrame:
    """source, target: blobs of a frame and the next whose boxes share a pixel. boxes: blob_id, frame, x1, y1, x2, y2. They meet by frame and cell, and count in the first cell that both have."""
    at = lambda c: F.floor(F.col(c) / cell)
    dealt = boxes.withColumn("_i", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("_j", F.explode(F.sequence(at("y1"), at("y2"))))
    a = dealt.select(F.col("blob_id").alias("source"), (F.col("frame") + 1).alias("frame"), "_i", "_j", *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")))
    b = dealt.select(F.col("blob_id").alias("target"), "frame", "_i", "_j", "x1", "y1", "x2", "y2")
    key = ["frame", "_i", "_j"]
    met = spread(a, *key).join(spread(b, *key).hint("merge"), key)
    touch = (F.col("a_x1") <= F.col("x2")) & (F.col("x1") <= F.col("a_x2")) & (F.col("a_y1") <= F.col("y2")) & (F.col("y1") <= F.col("a_y2"))
    here = (F.col("_i") == F.floor(F.greatest("a_x1", "x1") / cell)) & (F.col("_j") == F.floor(F.greatest("a_y1", "y1") / cell))
    return met.where(touch & here).select("source", "target")


def linked_rows(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """row_id, next_row_id: matches (frame, i, next_frame, j) as links between rows (row_id, frame, instance_idx, is_overlapping); null where the partner is no row, or one of them overlaps and the other does not.

    (frame, instance_idx) has to be a key of rows.
    """
    if rows.groupBy("frame", "instance_idx").count().where("count > 1").limit(1).count():
        raise ValueError("several rows share a frame and instance")
    a = rows.select("row_id", "frame", F.col("instance_idx").alias("i"), F.col("is_overlapping").alias("_a"))
    b = rows.select(F.col("row_id").alias("_next"), F.col("frame").alias("next_frame"), F.col("instance_idx").alias("j"), F.col("is_overlapping").alias("_b"))
    out = a.join(matches.select("frame", "i", "next_frame", "j"), ["frame", "i"], "left").join(b, ["next_frame", "j"], "left")
    return out.select("row_id", F.when(F.col("_a") == F.col("_b"), F.col("_next")).alias("next_row_id"))


def propagated(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """rows with a correction (fragment_id, identity, new_identity) pushed to all rows of its fragment that hold the old identity, and how far: first_frame, last_frame. null where nothing changed."""
    c = corrections.select("fragment_id", "identity", "new_identity").distinct()
    hit = rows.join(c, ["fragment_id", "identity"]).groupBy("fragment_id", "identity", "new_identity").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    return rows.join(hit, ["fragment_id", "identity"], "left").withColumn("identity", F.coalesce("new_identity", "identity")).drop("new_identity")
