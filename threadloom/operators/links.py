"""Pairs of detections in consecutive frames, their similarities and margins; chains of links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.geometry import centroid_similarity, distance, in_reach
from threadloom.functions.meet import touching
from threadloom.operators.order import quantiles, ranked
from threadloom.sources.tables import settled, spread


def frame_pairs(frames: DataFrame, max_gap: int = 1) -> DataFrame:
    """frame, next_frame: consecutive frames that are no more than max_gap apart."""
    f = frames.select("frame").distinct()
    ahead = f.select(F.col("frame").alias("next_frame"), F.explode(F.sequence(F.col("frame") - max_gap, F.col("frame") - 1)).alias("frame"))
    return f.join(ahead, "frame").groupBy("frame").agg(F.min("next_frame").alias("next_frame"))


def pair_similarities(detections: DataFrame, pairs: DataFrame, scale: float, radius: float) -> DataFrame:
    """frame, i, j, d, similarity: detections i of a frame and j of the next within the radius.

    Detections meet by frame, an equality, in tasks that are not merged: they are few bytes, but many pairs.
    """
    a = detections.select("frame", F.col("instance_idx").alias("i"), F.col("cx").alias("_ax"), F.col("cy").alias("_ay"))
    b = detections.select(F.col("frame").alias("next_frame"), F.col("instance_idx").alias("j"), F.col("cx").alias("_bx"), F.col("cy").alias("_by"))
    met = spread(a.join(pairs, "frame"), "next_frame").join(spread(b, "next_frame").hint("merge"), "next_frame").withColumn("d", distance(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by")))
    return met.where(in_reach(F.col("d"), radius)).select("frame", "i", "j", "d", centroid_similarity(F.col("d"), scale).alias("similarity"))


def best_matches(similar: DataFrame) -> DataFrame:
    """frame, i, j, similarity, margin: each i's best j, and how far it is ahead of the second; ties go to the lower j."""
    w = Window.partitionBy("frame", "i").orderBy(F.desc("similarity"), "j")
    ranked = similar.withColumn("_rank", F.row_number().over(w)).withColumn("_second", F.lead("similarity").over(w))
    return ranked.where("_rank = 1").select("frame", "i", "j", "similarity", (F.col("similarity") - F.coalesce("_second", F.lit(0.0))).alias("margin"))


#: Pairs of detections that a task holds at once, and how many it would meet in all.
HELD, WORK = 1_000_000, 1e9
MARGINS = "frame long, i long, j long, similarity double, margin double, swap double"


def _alike(u: np.ndarray, v: np.ndarray, scale: float, radius: float) -> np.ndarray:
    """Similarities of places, 0 beyond the radius and where one is unknown."""
    d = np.sqrt((u[..., 0] - v[..., 0]) ** 2 + (u[..., 1] - v[..., 1]) ** 2)
    return np.where(d <= radius, np.exp(-d / scale), 0.0)


def _apart(q: np.ndarray) -> float:
    """A distance within which a place has a few of q, if they lie evenly."""
    known = q[np.isfinite(q).all(axis=1)]
    if not len(known):
        return 1.0
    side = known.max(axis=0) - known.min(axis=0)
    return max(2 * np.sqrt(side[0] * side[1] / len(known)), side.sum() / len(known), 1e-6)


def _met(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of rows of p and of q that are no further than r (one for each of p) along both axes."""
    found = list(touching(np.hstack([p - r[:, None], p + r[:, None]]), np.hstack([q, q]), float(2 * np.median(r)) if len(r) else 1.0))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))


def _nearest(p: np.ndarray, q: np.ndarray, scale: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of p the row of q in reach that is most similar (-1: none, the first of equal ones), and the two greatest similarities (0: none).

    What lies within a distance is asked for, twice as far where that is fewer than two. Unknown distances are in reach, behind all others, with similarity 0.
    """
    j, first, second = np.full(len(p), -1), np.zeros(len(p)), np.zeros(len(p))
    unknown = np.flatnonzero(~np.isfinite(q).all(axis=1))
    known = np.isfinite(p).all(axis=1)
    if len(q):
        j[~known] = 0
    left, r = np.flatnonzero(known), _apart(q)
    while len(left):
        last = r >= radius
        if last and not np.isfinite(r):
            r = np.abs(np.vstack([p[left], q[np.isfinite(q).all(axis=1)]])).max() * 4 + 1
        after = []
        for some in np.array_split(left, len(left) // HELD + 1):
            i, k = _met(p[some], q, np.full(len(some), r * (1 + 1e-9)))
            d = np.sqrt((p[some[i], 0] - q[k, 0]) ** 2 + (p[some[i], 1] - q[k, 1]) ** 2)
            near = d <= min(r, radius)
            i, k, s = i[near], k[near], np.exp(-d[near] / scale)
            order = np.lexsort((k, -s, i))
            i, k, s = i[order], k[order], s[order]
            at, n = np.unique(i, return_index=True, return_counts=True)[1:] if len(i) else (np.zeros(0, int), np.zeros(0, int))
            row = some[i[at]]
            j[row], first[row] = k[at], s[at]
            two = n > 1
            second[row[two]] = s[at[two] + 1]
            # what is further away is less similar by more than a rounding
            sure = row[two][second[row[two]] > np.exp(-r / scale) * (1 + 1e-12)]
            after.append(np.setdiff1d(some, sure, assume_unique=True))
        left, r = np.concatenate(after), r * 2
        if last:
            break
    if len(unknown):
        j[(j < 0) & known] = unknown[0]
    return j, first, second


def _least_swaps(u: np.ndarray, v: np.ndarray, own: np.ndarray, scale: float, radius: float) -> np.ndarray:
    """For each row, at u and matched with its best at v, the least loss from exchanging partners with another row (infinite: there is none).

    The other row loses nothing by less than its best, so a loss is at least what the row itself loses; partners so far that this is no less
    than the least loss found are not looked at. Rows that lose more than they have are compared with all others, a block at a time.
    """
    swap = np.full(len(u), np.inf)
    if len(u) < 2:
        return swap
    loss = lambda i, k: own[i] + own[k] - _alike(u[i], v[k], scale, radius) - _alike(u[k], v[i], scale, radius)
    known = np.isfinite(u).all(axis=1) & np.isfinite(v).all(axis=1)
    left, r = np.flatnonzero(known), np.where(known, np.sqrt(((u - v) ** 2).sum(axis=1)), 0.0) + _apart(v)
    rest = [np.flatnonzero(~known)]
    while len(left):
        after = []
        for some in np.array_split(left, len(left) // HELD + 1):
            i, k = _met(u[some], v, r[some] * (1 + 1e-9))
            i = some[i]
            i, k = i[i != k], k[i != k]
            np.minimum.at(swap, i, loss(i, k))
            after.append(some[swap[some] > own[some] - np.exp(-r[some] / scale) - 1e-12])
        left = np.concatenate(after)
        rest.append(left[r[left] >= radius])
        left = left[r[left] < radius]
        r[left] *= 2
    rest = np.concatenate(rest)
    for at in range(0, len(rest), rows := max(1, HELD // len(u))):
        i = rest[at : at + rows]
        all_ = loss(i[:, None], np.arange(len(u))[None, :])
        all_[np.arange(len(i)), i] = np.inf
        swap[i] = np.minimum(swap[i], all_.min(axis=1))
    return swap


def frame_margins(detections: DataFrame, pairs: DataFrame, scale: float, radius: float, swaps: bool = True) -> DataFrame:
    """frame, i, j, similarity, margin, swap: best_matches of pair_similarities and their two_swap_margins (null: no other row to exchange with), without a row for a pair of detections.

    Two frames' detections are a group. A row looks as far around it as what it has found leaves room for something better.
    """
    place = [F.col("instance_idx").cast("long").alias("k"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y")]
    a = detections.join(pairs, "frame").select("frame", F.lit(0).alias("side"), *place)
    b = detections.select(F.col("frame").alias("next_frame"), "instance_idx", "cx", "cy").join(pairs, "next_frame").select("frame", F.lit(1).alias("side"), *place)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "k"])
        one, two = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        p, q = one[["x", "y"]].to_numpy(float), two[["x", "y"]].to_numpy(float)
        j, first, second = _nearest(p, q, scale, radius)
        held = np.flatnonzero(j >= 0)
        own = first[held]
        swap = _least_swaps(p[held], q[j[held]], own, scale, radius) if swaps else np.full(len(held), np.inf)
        names = [one["frame"].to_numpy()[held], one["k"].to_numpy()[held], two["k"].to_numpy()[j[held]], own, own - second[held], pd.array(swap).astype("Float64")]
        out = pd.DataFrame(dict(zip(("frame", "i", "j", "similarity", "margin", "swap"), names, strict=True)))
        out["swap"] = out["swap"].where(np.isfinite(swap), None)
        return out

    n = detections.groupBy("frame").agg(F.count("*").cast("double").alias("n"))
    work = pairs.join(n, "frame").join(n.select(F.col("frame").alias("next_frame"), F.col("n").alias("m")), "next_frame").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(work // WORK))
    return a.unionByName(b).withColumn("_deal", F.xxhash64("frame")).repartition(tasks, "_deal").groupBy("_deal", "frame").applyInPandas(run, MARGINS)


def two_swap_margins(similar: DataFrame, matched: DataFrame) -> DataFrame:
    """frame, i, margin: the least loss from exchanging i's partner with another row's. matched: frame, i, j."""
    m = matched.select("frame", "i", "j")
    own = m.join(similar.select("frame", "i", "j", "similarity"), ["frame", "i", "j"], "left").select("frame", "i", "j", F.coalesce("similarity", F.lit(0.0)).alias("s"))
    a, b = own.alias("a"), own.alias("b")
    both = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.i") != F.col("b.i"))).select("a.frame", F.col("a.i").alias("i"), F.col("b.i").alias("o"), F.col("a.j").alias("j"), F.col("b.j").alias("oj"), (F.col("a.s") + F.col("b.s")).alias("now"))
    s1 = similar.select("frame", "i", F.col("j").alias("oj"), F.col("similarity").alias("_s1"))
    s2 = similar.select("frame", F.col("i").alias("o"), "j", F.col("similarity").alias("_s2"))
    swapped = both.join(s1, ["frame", "i", "oj"], "left").join(s2, ["frame", "o", "j"], "left")
    return swapped.groupBy("frame", "i").agg(F.min(F.col("now") - F.coalesce("_s1", F.lit(0.0)) - F.coalesce("_s2", F.lit(0.0))).alias("margin"))


def assigned_swap_margins(similar: DataFrame, assigned: DataFrame) -> DataFrame:
    """frame, i, margin: two_swap_margins of an optimal one-to-one assignment, a row for each of its rows. assigned: assignment.ambiguous_links.

    Rows exchange partners among those that have one; a row without a partner, or with no other row to exchange with, has an infinite margin.
    """
    rows = settled(assigned.where("side = 'row'").select("frame", F.col("instance_idx").alias("i"), F.col("partner").alias("j")), "assigned")
    return rows.select("frame", "i").join(two_swap_margins(similar, rows.where("j is not null")), ["frame", "i"], "left").select("frame", "i", F.coalesce("margin", F.lit(float("inf"))).alias("margin"))


def windowed_margins(tracked: DataFrame, window: int, scale: float, threshold: float) -> DataFrame:
    """frame, individual, competitor, own, other, gap, n_within: detections whose mean similarity to their own track over the last `window` frames is at most `threshold` above a competitor's.

    tracked: frame, individual, x, y. Frames are the labelled ones, numbered without gaps; each meets those of its window by number.
    """
    order = ranked(tracked.select("frame").distinct(), "frame", "_n")
    t = tracked.join(order, "frame")
    now = t.select("frame", "individual", "x", "y", F.explode(F.sequence(F.col("_n") - window, F.col("_n") - 1)).alias("_n"))
    past = t.select("_n", F.col("individual").alias("track"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    scored = now.join(past, "_n").groupBy("frame", "individual", "track").agg(F.avg(centroid_similarity(distance(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")), scale)).alias("s"))
    own = scored.where("track = individual").select("frame", "individual", F.col("s").alias("own"))
    met = scored.join(own, ["frame", "individual"])
    rivals = F.col("track") != F.col("individual")
    out = met.groupBy("frame", "individual").agg(
        F.max(F.when(rivals, F.col("s"))).alias("other"), F.max_by("track", F.when(rivals, F.struct("s", -F.col("track")))).alias("competitor"), F.first("own").alias("own"),
        (F.count_if(F.col("s") >= F.col("own") - threshold) - 1).alias("n_within"),
    )
    gap = F.col("own") - F.col("other")
    return out.where(gap <= threshold).select("frame", "individual", "competitor", F.round("own", 4).alias("own"), F.round("other", 4).alias("other"), F.round(gap, 4).alias("gap"), "n_within")


def margin_sweep(margins: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, n, percent: how many margins are at most each threshold. One pass; a row per threshold."""
    counts = margins.agg(F.count("*").alias("_all"), *(F.count_if(F.col("margin") <= t).alias(f"_{k}") for k, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"_{k}").alias("n")) for k, t in enumerate(thresholds))))
    return counts.select("_all", rows.alias("r")).select("r.threshold", "r.n", F.try_divide(100.0 * F.col("r.n"), F.col("_all")).alias("percent"))


def margin_percentiles(margins: DataFrame, percentiles: list[int]) -> DataFrame:
    """percentile, margin: linearly interpolated, of all finite margins by ranges of values."""
    known = margins.where(F.abs("margin") < float("inf"))
    found = quantiles(known, ["margin"], [p / 100 for p in percentiles]).select(F.col("margin").alias("_m"))
    return found.select(F.posexplode("_m").alias("_k", "margin")).select(F.get(F.array(*(F.lit(p) for p in percentiles)), F.col("_k")).alias("percentile"), "margin")


def combined_flags(forward: DataFrame, backward: DataFrame, direction: str) -> DataFrame:
    """frame, instance_idx, flagged: forward, backward or both directions' flags, joined by or."""
    if direction not in ("both", "forward", "backward"):
        raise ValueError(f"unknown direction: {direction}")
    key = ["frame", "instance_idx"]
    both = forward.select(*key, F.col("flagged").alias("_f")).join(backward.select(*key, F.col("flagged").alias("_b")), key, "full_outer")
    f, b = F.coalesce("_f", F.lit(False)), F.coalesce("_b", F.lit(False))
    flag: Column = f | b if direction == "both" else f if direction == "forward" else b
    return both.select(*key, flag.alias("flagged"))


def link_faults(links: DataFrame) -> DataFrame:
    """One row: links whose target no row is, and nodes that several links point at."""
    into = links.where("next is not null").groupBy(F.col("next").alias("node")).agg(F.count("*").alias("_n"))
    return into.join(links.select("node", F.lit(True).alias("_there")), "node", "left").agg(F.count_if(F.col("_there").isNull()).alias("missing"), F.count_if(F.col("_n") > 1).alias("shared"))


def chains(links: DataFrame, check: bool = True) -> DataFrame:
    """node, chain (its first node), position: maximal chains of links, by pointer jumping.

    Every step doubles how far back a node looks, so a chain of L nodes takes about log2 L joins; each step is a table of its own.
    Raises ValueError where links share a target, point at nothing, or go round.
    """
    if check:
        bad = link_faults(links).first()
        if bad["missing"] or bad["shared"]:
            raise ValueError(f"links are no partial permutation: {bad.asDict()}")
    back = links.where("next is not null").select(F.col("next").alias("node"), F.col("node").alias("to"))
    now = settled(links.select("node").join(back, "node", "left").select("node", F.coalesce("to", "node").alias("to"), F.col("to").isNotNull().cast("long").alias("steps")), "chains")
    nodes, done = now.count(), -1
    for _ in range(2 + max(1, nodes).bit_length()):
        jump = now.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        now = settled(now.join(jump, "to").select("node", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps")), "chains")
        ended = now.agg(F.sum("steps")).first()[0]
        if ended == done:
            return now.select("node", F.col("to").alias("chain"), F.col("steps").alias("position"))
        done = ended
    raise ValueError("links go round")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node): of undirected edges a, b, by hooking whole components to the least one that any of their nodes touches, and jumping twice."""
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        ends = both.join(label.select(F.col("node").alias("a"), F.col("component").alias("_a")), "a").join(label.select(F.col("node").alias("b"), F.col("component").alias("_b")), "b")
        hook = settled(ends.where("_b < _a").groupBy(F.col("_a").alias("component")).agg(F.min("_b").alias("_to")), "hooks")
        if hook.isEmpty():
            return label
        jump = hook.select(F.col("component").alias("_to"), F.col("_to").alias("_then"))
        hook = hook.join(jump, "_to", "left").select("component", F.coalesce("_then", "_to").alias("_to"))
        label = settled(label.join(hook, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "labels")
