"""More of the operators' queries over whole tables: similarities, histories, fragments, training and exports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators import blobs, clusters, collisions, fragments, frames, history, identities, intervals, links, poses, runs, training, votes
from threadloom.operators.order import running_sum
from threadloom.plans.queries import CENTRES, COEXIST, NEAREST, PROB, TRACKED, matches, moved, p2, query, resolved, six, tracks
from threadloom.sources import fixtures as fx
from threadloom.sources.tables import settled

fx.SQL["blobs"] = """blobs AS (SELECT event_id AS blob_id, frame, fragment_id AS u, cx, cy, cx < 120 AS seems_individual, floor(cx)::BIGINT % 2 AS class_id, CASE WHEN cy < 500 THEN 0 ELSE 1 END AS region, instance_idx, is_overlapping FROM detections),
followed AS (SELECT event_id AS source, lead(event_id) OVER w AS one, lead(event_id, 2) OVER w AS two FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
edges AS (SELECT source, one AS target FROM followed WHERE one IS NOT NULL AND source % 17 > 0 UNION ALL SELECT source, two FROM followed WHERE two IS NOT NULL AND source % 13 = 0)"""
fx.SQL["lengths"] = "lengths AS (SELECT *, end_frame - start_frame AS n_images FROM fragments)"


def blob_rows(spark: SparkSession, d: str) -> DataFrame:
    det = fx.detections(spark, d)
    return det.select(F.col("event_id").alias("blob_id"), "frame", "cx", "cy", (F.col("cx") < 120).alias("seems_individual"), (F.floor("cx") % 2).alias("class_id"), F.when(F.col("cy") < 500, 0).otherwise(1).alias("region"), "instance_idx", "is_overlapping")


def blob_links(spark: SparkSession, d: str) -> DataFrame:
    """Each event to the user's next, but for some, and from some also to the one after."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("source"), F.lead("event_id").over(w).alias("one"), F.lead("event_id", 2).over(w).alias("two"))
    return e.where("one is not null and source % 17 > 0").select("source", F.col("one").alias("target")).unionByName(e.where("two is not null and source % 13 = 0").select("source", F.col("two").alias("target")))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return fx.fragments(spark, d).withColumn("n_images", F.col("end_frame") - F.col("start_frame"))


def posed(spark: SparkSession, d: str) -> DataFrame:
    """Poses of three nodes; every fourth lacks the last."""
    node = lambda dx, dy, there=True: F.struct(F.when(F.lit(there) if there is True else there, F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    return fx.detections(spark, d).withColumn("pose", F.array(node(0, 0), node(40, 20), F.when(F.col("event_id") % 4 > 0, node(20, 30))))


NEAR = """near AS (SELECT a.frame, a.event_id AS a, b.event_id AS b, a.event_id % 4 > 0 AS pa, b.event_id % 4 > 0 AS pb, b.cx - a.cx AS dx, b.cy - a.cy AS dy FROM detections a JOIN detections b ON b.frame = a.frame + 1 WHERE sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) <= 45)"""


def near_pairs(spark: SparkSession, d: str, asked: dict[str, tuple[str, float, int]] = {}, pose: Column | None = None) -> DataFrame:  # noqa: B006
    """Poses of a frame and the next that are within 45 of each other, and similarities that are asked for."""
    rows = posed(spark, d)
    return poses.near_similarities(rows.select(F.col("event_id").alias("row_id"), "frame", F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("pose") if pose is None else pose).alias("pose")), 45.0, asked)


@query(f"""+ {NEAR}, h AS (SELECT *, CASE WHEN pa THEN 30 ELSE 20 END AS ha, CASE WHEN pb THEN 30 ELSE 20 END AS hb FROM near),
o AS (SELECT *, greatest(least(40, dx + 40) - greatest(0, dx) + 1, 0) * greatest(least(ha, dy + hb) - greatest(0, dy) + 1, 0) AS both_, 41 * (ha + 1) + 41 * (hb + 1) AS areas FROM h)
SELECT a, b, round(both_ / (areas - both_), 7) AS bounding_box,
  round((2 + (pa AND pb)::INT) / (2 + pa::INT) * exp(-(dx * dx + dy * dy) / (2 * 40 * ha * 0.0025)), 6) AS keypoint, round(exp(-sqrt(dx * dx + pow(dy + (CASE WHEN pb THEN 20 ELSE 10 END) - (CASE WHEN pa THEN 20 ELSE 10 END), 2)) / 50), 6) AS centroid FROM o""", ("detections",))
def pose_similarities(spark, d):
    return near_pairs(spark, d, {m: (m, 50.0, digits) for m, digits in (("bounding_box", 7), ("keypoint", 6), ("centroid", 6))})


@query(f"""+ {NEAR}, o AS (SELECT *, greatest(least(40, dx + 40) - greatest(0, dx), 0) * greatest(least(20, dy + 20) - greatest(0, dy), 0) AS both_ FROM near) SELECT a, b, round(both_ / (1600 - both_), 6) AS hull FROM o""", ("detections",))
def hull_similarities(spark, d):
    box = F.array(*(F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y")) for dx, dy in ((0, 0), (40, 0), (40, 20), (0, 20), (20, 10))))
    return near_pairs(spark, d, {"hull": ("hull", 1.0, 6)}, box)


@query("""SELECT event_id, CASE WHEN identity IS NOT NULL THEN identity END AS identity, p1_max FROM (SELECT event_id, coalesce(CASE WHEN is_overlapping THEN event_id % 6 END, CASE WHEN fragment_id % 7 > 0 THEN fragment_id % 5 + 1 END, 0) AS identity,
  CASE WHEN NOT is_overlapping AND fragment_id % 7 > 0 THEN (fragment_id % 10) / 10 END AS p1_max FROM detections)""", ("detections",))
def identity_fan_out(spark, d):
    det = fx.detections(spark, d)
    frag = det.select("fragment_id").distinct().where("fragment_id % 7 > 0").select("fragment_id", (F.col("fragment_id") % 5 + 1).alias("identity"), (F.col("fragment_id") % 10 / 10).alias("p1_max"))
    rows = det.where("is_overlapping").select("event_id", (F.col("event_id") % 6).alias("identity"))
    return identities.fan_out(det.select("event_id", "fragment_id"), frag, rows).select("event_id", "identity", "p1_max")


@query("""+ t AS (SELECT frame, CASE WHEN event_id % 97 = 0 THEN instance_idx + 1000 ELSE instance_idx END AS instance_idx, CASE WHEN event_id % 41 = 0 THEN identity + 2 ELSE identity - 1 END AS track FROM detections WHERE identity > 0 AND event_id % 29 > 0 OR event_id % 53 = 0),
m AS (SELECT i.identity, t.track FROM detections i FULL JOIN t ON i.frame = t.frame AND i.instance_idx = t.instance_idx)
SELECT count(*) FILTER (track < 0 OR track >= 5) AS outside, count(*) FILTER (track IS NOT NULL AND identity IS NULL) AS unknown, count(*) FILTER (identity > 0 AND track IS NULL) AS lost, count(*) FILTER (track IS NOT NULL AND identity = 0) AS unasked,
  count(*) FILTER (identity > 0 AND track IS NOT NULL AND identity <> track + 1) AS different, (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY frame, track HAVING count(*) > 1)) AS shared, (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY frame, instance_idx HAVING count(*) > 1)) AS doubled FROM m""", ("detections",))
def track_checks(spark, d):
    det = fx.detections(spark, d)
    t = det.where("identity > 0 and event_id % 29 > 0 or event_id % 53 = 0").select("frame", F.expr("case when event_id % 97 = 0 then instance_idx + 1000 else instance_idx end").alias("instance_idx"), F.expr("case when event_id % 41 = 0 then identity + 2 else identity - 1 end").alias("track"))
    return poses.track_faults(det.select("frame", "instance_idx", "identity"), t, 5)


STATS = ("fragments", "lengths")


@query("""+ f AS (SELECT n_images, fragment_id % 5 = 0 AS c, fragment_id % 3 > 0 AS g, CASE WHEN fragment_id % 4 > 0 THEN fragment_id % 4 = 1 END AS a, fragment_id % 7 = 1 AS gl, fragment_id % 7 = 2 AS pa FROM lengths)
SELECT count(*) AS fragments, count(*) FILTER (c) AS crossing_fragments, count(*) FILTER (NOT c) AS individual_fragments, count(*) FILTER (NOT c AND NOT g) AS individual_fragments_not_in_a_global_fragment, count(*) FILTER (NOT c AND a) AS accumulable_individual_fragments,
  count(*) FILTER (NOT c AND NOT a) AS not_accumulable_individual_fragments, count(*) FILTER (NOT c AND gl) AS globally_accumulated_individual_fragments, count(*) FILTER (NOT c AND pa) AS partially_accumulated_individual_fragments, sum(n_images)::BIGINT AS blobs,
  sum(n_images) FILTER (c)::BIGINT AS crossing_blobs, sum(n_images) FILTER (NOT c)::BIGINT AS individual_blobs, count(*) FILTER (NOT c AND NOT g) AS individual_blobs_not_in_a_global_fragment, sum(n_images) FILTER (a)::BIGINT AS accumulable_individual_blobs,
  sum(n_images) FILTER (NOT a)::BIGINT AS not_accumulable_individual_blobs, sum(n_images) FILTER (NOT c AND gl)::BIGINT AS globally_accumulated_individual_blobs, sum(n_images) FILTER (NOT c AND pa)::BIGINT AS partially_accumulated_individual_blobs FROM f""", STATS)
def fragment_statistics(spark, d):
    i = F.col("fragment_id")
    return fragments.statistics(lengths(spark, d).select("n_images", (i % 5 == 0).alias("is_crossing"), (i % 3 > 0).alias("in_global"), F.when(i % 4 > 0, i % 4 == 1).alias("accumulable"), (i % 7 == 1).alias("globally"), (i % 7 == 2).alias("partially")))


@query("""+ r AS (SELECT round_even(median(l_quantity * 4), 0)::BIGINT AS w, round_even(median(l_extendedprice / 200), 0)::BIGINT AS h, median(CASE WHEN l_linenumber > 1 THEN l_discount * 400 END) AS b FROM lineitem),
s AS (SELECT *, round_even(h - b, 0)::BIGINT AS cy, CASE WHEN w * h > 6400 THEN sqrt(6400 / (w * h)) ELSE 1 END AS scale FROM r), n AS (SELECT *, round_even(w * scale, 0)::BIGINT AS nw, round_even(h * scale, 0)::BIGINT AS nh FROM s)
SELECT CASE WHEN nw * nh > 6400 THEN floor(w * scale)::BIGINT ELSE nw END AS width, CASE WHEN nw * nh > 6400 THEN floor(h * scale)::BIGINT ELSE nh END AS height, round_even(cy * scale, 0)::BIGINT AS centre_y, round(scale, 6) AS scale FROM n""", ("fragments",))
def crop_geometry(spark, d):
    rows = fx.table(spark, d, "lineitem").select((F.col("l_quantity") * 4).alias("x_spread"), (F.col("l_extendedprice") / 200).alias("y_extent"), F.when(F.col("l_linenumber") > 1, F.col("l_discount") * 400).alias("d_bottom"))
    return fragments.crop_geometry(rows).withColumn("scale", F.round("scale", 6))


@query("SELECT coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END, p_size::DOUBLE) AS body_length FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 1")
def episode_body_length(spark, d):
    p = fx.table(spark, d, "part")
    return fragments.body_length_of(p.select(F.col("p_partkey").alias("episode"), F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_size") > 25), F.col("p_retailprice")).alias("body_length"), F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).alias("height")))


GLOBALS = ("detections", "states", "frame_table")
SUMMARY = "summary AS (SELECT fragment_id, count(*) AS n_images, (max(frame) - min(frame))::DOUBLE AS distance FROM states GROUP BY ALL), members AS (SELECT global_fragment, frame AS start_frame, unnest(ids) AS fragment_id FROM starts)"


def global_members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Members of the global fragments, and their summary."""
    states = fx.frame_states(spark, d)
    summary = states.groupBy("fragment_id").agg(F.count("*").alias("n_images"), (F.max("frame") - F.min("frame")).cast("double").alias("distance"))
    starts = frames.core_starts(frames.core_flags(frames.frame_table(states), 3))
    return starts.select("global_fragment", F.col("frame").alias("start_frame"), F.explode("ids").alias("fragment_id")), frames.global_fragments(starts, summary)


@query(f"+ {SUMMARY}, g AS (SELECT global_fragment, min(n_images) >= 45 AS ok FROM members JOIN summary USING (fragment_id) GROUP BY ALL) SELECT fragment_id, bool_or(ok) AS accumulable FROM members JOIN g USING (global_fragment) GROUP BY fragment_id", GLOBALS)
def accumulable_split(spark, d):
    members, found = global_members(spark, d)
    return fragments.accumulable_split(members.join(found.select("global_fragment", (F.col("min_n_images") >= 45).alias("accumulable")), "global_fragment"))


@query(f"""+ {SUMMARY}, g AS (SELECT global_fragment, start_frame, min(distance) AS dist FROM members JOIN summary USING (fragment_id) GROUP BY ALL)
SELECT global_fragment, row_number() OVER (ORDER BY dist DESC, global_fragment) AS by_distance, row_number() OVER (ORDER BY abs(start_frame - 300), global_fragment) AS by_frame FROM g""", GLOBALS)
def ranked_global_fragments(spark, d):
    return fragments.ranked_globals(global_members(spark, d)[1], 300)


@query(f"""+ members AS (SELECT global_fragment, unnest(ids) AS fragment_id FROM starts), m AS (SELECT global_fragment, CASE WHEN (fragment_id + global_fragment) % 11 > 0 THEN (fragment_id // 1000 + (global_fragment % 5 = 0)::INT * (fragment_id // 1000 = 1)::INT) END AS t, (fragment_id + global_fragment) % 4 > 0 AS ok FROM members)
SELECT global_fragment, count(DISTINCT t) = 3 AND count(*) FILTER (t IS NULL OR t >= 3) = 0 AS is_unique, count(*) FILTER (ok) = count(DISTINCT coalesce(t, -1)) FILTER (ok) AS is_partially_unique, bool_and(ok) AS all_acceptable, bool_or(ok) AS any_acceptable FROM m GROUP BY global_fragment""", GLOBALS)
def global_uniqueness(spark, d):
    f, g = F.col("fragment_id"), F.col("global_fragment")
    which = F.floor(f / 1000)
    t = F.when((f + g) % 11 > 0, which + ((g % 5 == 0) & (which == 1)).cast("int"))
    return training.uniqueness(global_members(spark, d)[0].select("global_fragment", t.alias("temporary_id"), ((f + g) % 4 > 0).alias("acceptable")), 3)


@query("""+ b AS (SELECT frag_a AS f, frag_b AS o FROM pairs UNION ALL SELECT frag_b, frag_a FROM pairs)
SELECT f.fragment_id, coalesce(avg((o % 3 > 0)::INT), 0) >= 0.5 AS enough_accumulated, coalesce(bool_or(o % 6 = f.fragment_id % 6), false) AS inconsistent FROM fragments f LEFT JOIN b ON b.f = f.fragment_id GROUP BY f.fragment_id""", COEXIST)
def coexistence_checks(spark, d):
    f = fx.fragments(spark, d).withColumns({"temporary_id": F.col("fragment_id") % 6, "used": F.col("fragment_id") % 3 > 0})
    return training.coexistence_over(f)


@query()
def accumulated_identities(spark, d):
    """Each video apart, with two animals: where a fragment begins and one other of its video runs, both are a global fragment; those of the longest shortest member come first."""
    f = fx.fragments(spark, d)
    running = intervals.around(f.withColumns({"_n": F.lit(1), "_o": F.col("fragment_id")}), ["_n", "_o"], at_start=True).where("_n = 1")
    met = f.select("video_id", "fragment_id").join(running.select("fragment_id", F.array("_o").alias("others")), "fragment_id")
    each = met.select("video_id", F.col("fragment_id").alias("g"), F.explode(F.concat("others", F.array("fragment_id"))).alias("fragment_id"))
    least = each.join(f.select("fragment_id", (F.col("end_frame") - F.col("start_frame")).alias("long")), "fragment_id").groupBy("video_id", "g").agg(F.min("long").alias("long"))
    order = least.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("long"), "g")))
    v = fx.votes(spark, d).select("fragment_id", (F.col("identity") % 2 + 1).alias("identity"), "n_images").groupBy("fragment_id", "identity").agg(F.sum("n_images").alias("n_images"))
    p = votes.p1(v, 2).groupBy("fragment_id").agg(F.sum("n_images").alias("n_images"), F.transform(F.array_sort(F.collect_list(F.struct("identity", "p1"))), lambda s: s["p1"]).alias("p1"))
    known = f.select("video_id", "fragment_id").join(p, "fragment_id").withColumn("certainty", F.lit(1.0))
    members = settled(each.join(order, ["video_id", "g"]).select("video_id", "place", "fragment_id"), "members")
    both = intervals.coexisting(f.join(members.select("fragment_id").distinct(), "fragment_id", "left_semi"))
    return training.accumulated(members, known, both, 2)


@query("""+ moves AS (SELECT * FROM (SELECT individual, frame, probability, lag(frame) OVER (PARTITION BY individual ORDER BY frame) AS was FROM tracks WHERE probability < 0.5)),
g AS (SELECT *, sum(coalesce((frame - was > 1)::INT, 0)) OVER (PARTITION BY individual ORDER BY frame) AS g FROM moves), e AS (SELECT individual, min(frame) AS start, round(min(probability), 6) AS min_value FROM g GROUP BY individual, g)
SELECT * FROM e ORDER BY min_value, individual, start LIMIT 25""", TRACKED)
def tightest_events(spark, d):
    e = runs.event_groups(tracks(spark, d).where("probability < 0.5"), ["individual"], "probability").select("individual", "start", F.round("min_value", 6).alias("min_value"))
    return e.orderBy("min_value", "individual", "start").limit(25)


CHAINED = """s AS (SELECT event_id AS node, user_id, ts, coalesce(event_type <> lag(event_type) OVER w, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT node, first_value(node) OVER (PARTITION BY user_id, g ORDER BY ts, node) AS chain FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, node) AS g FROM s))"""


@query(f"""+ {CHAINED}, r AS (SELECT chain, frame, instance_idx, node FROM c JOIN detections ON event_id = node),
f AS (SELECT chain, row_number() OVER (ORDER BY min(frame), first(instance_idx ORDER BY frame, instance_idx), chain) - 1 AS fragment FROM r GROUP BY chain) SELECT node, fragment FROM r JOIN f USING (chain)""", ("detections", "links"))
def stamped_fragments(spark, d):
    rows = fx.detections(spark, d).select(F.col("event_id").alias("node"), "frame", "instance_idx")
    return fragments.stamped(rows, links.chains(fx.links(spark, d))).select("node", "fragment")


HISTORY = ("detections", "blobs")


@query("""+ dn AS (SELECT source AS b, count(*) AS n, min(target) AS t FROM edges GROUP BY source), dp AS (SELECT target AS b, count(*) AS n, min(source) AS t FROM edges GROUP BY target),
k AS (SELECT blob_id, seems_individual, coalesce(dn.n, 0) AS nn, coalesce(dp.n, 0) AS np, dn.t AS nx, dp.t AS pv FROM blobs LEFT JOIN dn ON dn.b = blob_id LEFT JOIN dp ON dp.b = blob_id),
ahead AS (SELECT s.blob_id, s.blob_id AS at, 0 AS far, false AS hit FROM k s UNION ALL SELECT a.blob_id, n.blob_id, far + 1, hit OR (far > 0 AND n.np > 1 AND NOT n.seems_individual) FROM ahead a JOIN k c ON c.blob_id = a.at JOIN k n ON n.blob_id = c.nx WHERE c.nn = 1 OR a.far = 0),
back AS (SELECT s.blob_id, s.blob_id AS at, 0 AS far, false AS hit FROM k s UNION ALL SELECT a.blob_id, n.blob_id, far + 1, hit OR (far > 0 AND n.nn > 1 AND NOT n.seems_individual) FROM back a JOIN k c ON c.blob_id = a.at JOIN k n ON n.blob_id = c.pv WHERE c.np = 1 OR a.far = 0),
x AS (SELECT a.blob_id, max_by(k2.nn, far) > 1 AND max(far) > 0 AS m, bool_or(hit) AS c FROM ahead a JOIN k k2 ON k2.blob_id = a.at GROUP BY a.blob_id), y AS (SELECT a.blob_id, max_by(k2.np, far) > 1 AND max(far) > 0 AS m, bool_or(hit) AS c FROM back a JOIN k k2 ON k2.blob_id = a.at GROUP BY a.blob_id),
z AS (SELECT k.*, k.nn = 1 AND x.m AS mn, x.c AS nc, k.np = 1 AND y.m AS mp, y.c AS pc, (SELECT max(q.np) FROM edges e JOIN k q ON q.blob_id = e.target WHERE e.source = k.blob_id) AS tin, (SELECT max(q.nn) FROM edges e JOIN k q ON q.blob_id = e.source WHERE e.target = k.blob_id) AS sout FROM k JOIN x USING (blob_id) JOIN y USING (blob_id))
SELECT blob_id, nn AS n_next, np AS n_previous, mn AS multiple_next, nc AS next_crossing, mp AS multiple_previous, pc AS previous_crossing, seems_individual AND nn = 1 AND np = 1 AND coalesce(tin, 0) = 1 AND coalesce(sout, 0) = 1 AND nc AND pc AS sure_individual, NOT seems_individual AND (np > 1 OR nn > 1 OR (mn AND mp)) AS sure_crossing FROM z""".replace("+ dn", "+ RECURSIVE_ dn"), HISTORY)
def link_history(spark, d):
    return history.link_history(blob_rows(spark, d), blob_links(spark, d))


@query("""+ dn AS (SELECT source, count(*) AS n FROM edges GROUP BY source), dp AS (SELECT target, count(*) AS n FROM edges GROUP BY target),
ok AS (SELECT e.source, e.target FROM edges e JOIN dn ON dn.source = e.source AND dn.n = 1 JOIN dp ON dp.target = e.target AND dp.n = 1 JOIN blobs a ON a.blob_id = e.source JOIN blobs b ON b.blob_id = e.target WHERE a.class_id = b.class_id AND a.region = b.region),
go AS (SELECT blob_id, blob_id AS fragment, 0::BIGINT AS position FROM blobs WHERE blob_id NOT IN (SELECT target FROM ok) UNION ALL SELECT ok.target, fragment, position + 1 FROM go JOIN ok ON ok.source = go.blob_id)
SELECT blob_id, fragment, position FROM go""".replace("+ dn", "+ RECURSIVE_ dn"), HISTORY)
def blob_fragments(spark, d):
    return history.blob_fragments(blob_rows(spark, d), blob_links(spark, d))


@query("SELECT a.blob_id AS source, b.blob_id AS target FROM blobs a JOIN blobs b ON b.frame = a.frame + 1 WHERE a.cx <= b.cx + 10 AND b.cx <= a.cx + 10 AND a.cy <= b.cy + 25 AND b.cy <= a.cy + 25", HISTORY)
def overlapping_blobs(spark, d):
    return history.overlapping_boxes(blob_rows(spark, d).select("blob_id", "frame", F.col("cx").alias("x1"), F.col("cy").alias("y1"), (F.col("cx") + 10).alias("x2"), (F.col("cy") + 25).alias("y2")), 64.0)


@query("""SELECT a.event_id AS row_id, CASE WHEN a.is_overlapping = b.is_overlapping THEN b.event_id END AS next_row_id FROM detections a LEFT JOIN detections b ON a.event_id % 3 > 0 AND b.frame = a.frame + 1 AND b.instance_idx = (a.instance_idx * 7 + a.event_id) % 20""", ("detections",))
def linked_rows(spark, d):
    det = fx.detections(spark, d)
    m = det.where("event_id % 3 > 0").select("frame", F.col("instance_idx").alias("i"), (F.col("frame") + 1).alias("next_frame"), ((F.col("instance_idx") * 7 + F.col("event_id")) % 20).alias("j"))
    return history.linked_rows(m, det.select(F.col("event_id").alias("row_id"), "frame", "instance_idx", "is_overlapping"))


@query("""+ c AS (SELECT DISTINCT fragment_id, fragment_id % 6 AS identity, 9 AS new_identity FROM detections WHERE fragment_id % 4 = 0)
SELECT event_id, coalesce(new_identity, identity) AS identity, CASE WHEN new_identity IS NOT NULL THEN min(frame) OVER (PARTITION BY fragment_id) END AS first_frame, CASE WHEN new_identity IS NOT NULL THEN max(frame) OVER (PARTITION BY fragment_id) END AS last_frame FROM (SELECT d.*, new_identity FROM detections d LEFT JOIN c ON c.fragment_id = d.fragment_id AND c.identity = d.identity)""", ("detections",))
def identity_propagation(spark, d):
    det = fx.detections(spark, d)
    c = det.where("fragment_id % 4 = 0").select("fragment_id", "identity", F.lit(9).cast("long").alias("new_identity"))
    return history.propagated(det, c).select("event_id", "identity", "first_frame", "last_frame")


@query("""SELECT event_id, first(individual ORDER BY d, individual) AS nearest, round(min(d), 6) AS distance FROM (SELECT e.event_id, t.individual, sqrt(pow(e.cx - t.x, 2) + pow(e.cy - t.y, 2)) AS d FROM detections e JOIN tracks t USING (frame)) GROUP BY event_id""", TRACKED)
def nearest_truth(spark, d):
    rows = fx.detections(spark, d).select(F.col("event_id").alias("row_id"), "frame", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return poses.nearest_in_frame(rows, tracks(spark, d)).select(F.col("row_id").alias("event_id"), "nearest", *six("distance"))


@query("""SELECT individual, frame + 1 AS start, f - frame - 1 AS length, round(x + (nx - x) / (f - frame), 6) AS first_x, round(y + (ny - y) / (f - frame), 6) AS first_y, round(nx - (nx - x) / (f - frame), 6) AS last_x, round(ny - (ny - y) / (f - frame), 6) AS last_y
FROM (SELECT *, lead(frame) OVER w AS f, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM tracks WINDOW w AS (PARTITION BY individual ORDER BY frame)) WHERE f - frame > 1""", TRACKED)
def gap_candidates(spark, d):
    return poses.gap_candidates(tracks(spark, d)).select("individual", "start", "length", *six("first_x", "first_y", "last_x", "last_y"))


@query("""+ per AS (SELECT frame, count(DISTINCT individual) AS n FROM tracks GROUP BY frame), lacking AS (SELECT f.frame FROM (SELECT unnest(range((SELECT min(frame) FROM per), (SELECT max(frame) + 1 FROM per))) AS frame) f LEFT JOIN per USING (frame) WHERE coalesce(n, 0) <> 5)
SELECT min(frame) AS start, count(*) AS length FROM (SELECT frame, frame - row_number() OVER (ORDER BY frame) AS g FROM lacking) GROUP BY g""", TRACKED)
def gaps_of_any(spark, d):
    return poses.all_gaps(tracks(spark, d), 5)


@query("SELECT frame, identity, last(cx ORDER BY instance_idx) AS x, last(cy ORDER BY instance_idx) AS y, count(*) AS n, count(*) > 1 AS duplicated FROM detections WHERE identity > 0 GROUP BY frame, identity", ("detections",))
def last_positions(spark, d):
    return poses.last_positions(fx.detections(spark, d).select("frame", "identity", "instance_idx", F.col("cx").alias("x"), F.col("cy").alias("y")))


@query("SELECT count(*) + (SELECT count(*) FROM events WHERE event_id % 50 = 0) AS instances, count(*) FILTER (outcome = 'kept') AS tracked, (SELECT count(*) FROM events WHERE event_id % 50 = 0) AS no_row, count(*) FILTER (outcome = 'unassigned') AS identity_0, count(*) FILTER (outcome NOT IN ('kept', 'unassigned')) AS collided FROM resolved", ("detections", "resolved"))
def full_reconciliation(spark, d):
    r = resolved(spark, d)
    all_ = r.select("frame", "instance_idx").unionByName(fx.table(spark, d, "events").where("event_id % 50 = 0").select((F.col("event_id") * 0 - 1).alias("frame"), F.col("event_id").cast("int").alias("instance_idx")))
    return collisions.full_reconciliation(all_, r)


@query("""SELECT event_id, CASE WHEN identity = 0 AND NOT is_overlapping THEN true ELSE is_overlapping END AS is_crossing,
  ['blue #0072BD', 'orange-red #D95319', 'amber #EDB120', 'purple #7E2F8E', 'olive-green #77AC30', 'light-blue #4DBEEE', 'dark-red #A2142F'][(fragment_id % 7 + 1)::INT] AS colour,
  CASE WHEN cx <= 200 AND cy <= 400 THEN 0 WHEN cx >= 100 AND cx <= 300 AND cy >= 300 AND cy <= 800 THEN 1 END AS region FROM detections""", ("detections",))
def detection_labels(spark, d):
    det = fx.detections(spark, d)
    return det.select("event_id", blobs.crossing_of_refused("identity", "is_overlapping").alias("is_crossing"), poses.colour(F.col("fragment_id")).alias("colour"), fragments.region_index(F.col("cx"), F.col("cy"), [(-1e9, -1e9, 200, 400), (100, 300, 300, 800)]).alias("region"))


@query("SELECT fragment_id, video_id, CASE WHEN video_id % 3 = 0 THEN 1 ELSE fragment_id % 5 END AS identity FROM fragments", ("fragments",))
def single_animals(spark, d):
    """Videos have one, two or three animals by their number, but for the last, of which none says how many."""
    f = fx.fragments(spark, d).withColumn("identity", F.col("fragment_id") % 5)
    videos = f.select("video_id").distinct().where("video_id <> 49").withColumn("n_animals", F.col("video_id") % 3 + 1)
    return identities.alone(f, videos).select("fragment_id", "video_id", "identity")


@query("SELECT r AS region, array_to_string(list_sort(list(DISTINCT i)), ',') AS identities FROM (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey ELSE -1 END AS r FROM supplier) WHERE r >= 0 GROUP BY r")
def region_identities(spark, d):
    s = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("identity"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey")).otherwise(-1).alias("region"))
    return fragments.region_groups(s).select("region", F.concat_ws(",", F.col("identities").cast("array<string>")).alias("identities"))


@query("""+ f AS (SELECT *, event_id % 31 = 0 AS si, event_id % 401 = 1 AS sc, cx < 120 AS seems FROM detections), n AS (SELECT least(count(*) FILTER (si), count(*) FILTER (sc)) < 10 AS few FROM f)
SELECT event_id, CASE WHEN si THEN true WHEN sc THEN false WHEN few THEN seems END AS is_individual FROM f, n""", ("detections",))
def crossing_fallback(spark, d):
    i = F.col("event_id")
    return fragments.crossing_rule(fx.detections(spark, d).select("event_id", (i % 31 == 0).alias("sure_individual"), (i % 401 == 1).alias("sure_crossing"), (F.col("cx") < 120).alias("seems_individual"))).select("event_id", "is_individual")


@query("""+ l AS (SELECT fragment_id, n_images FROM lengths WHERE n_images >= 4), e AS (SELECT count(*) AS e FROM pairs WHERE frag_a IN (SELECT fragment_id FROM l) AND frag_b IN (SELECT fragment_id FROM l))
SELECT count(*) AS n_long, sum(n_images)::BIGINT AS n_images, max(e) AS n_negative, round(2 * max(e) / (count(*) * 7), 6) AS connectivity, sum(n_images) >= 8 AS enough_images, max(e) > 0 AS some_coexist FROM l, e""", ("fragments", "pairs", "lengths"))
def long_connectivity(spark, d):
    return fragments.connectivity(lengths(spark, d), 8, 4).withColumn("connectivity", F.round("connectivity", 6))


@query("SELECT l_partkey AS pair_id, round((min(l_partkey) % 10 + count(*) FILTER (l_discount > 0.05)) * 0.98, 6) AS score FROM lineitem GROUP BY l_partkey")
def decayed_scores(spark, d):
    rows = fx.table(spark, d, "lineitem")
    return training.decayed(rows.select(F.col("l_partkey").alias("pair_id")).distinct().withColumn("score", (F.col("pair_id") % 10).cast("double")), rows.select(F.col("l_partkey").alias("pair_id"), (F.col("l_discount") - 0.05).alias("loss"))).select("pair_id", *six("score"))


@query("""+ c AS (SELECT o_orderkey AS pair_id, sum(o_custkey) OVER (ORDER BY o_orderkey) AS upto, o_custkey AS own FROM orders), u AS (SELECT draw, (((draw + 1) % 2147483647 * 48271 + 1) % 2147483647 * 16807 + 12345) % 2147483647 / 2147483647 * (SELECT max(upto) FROM c) AS u FROM (SELECT unnest(range(2000)) AS draw))
SELECT draw, pair_id FROM u JOIN c ON upto > u AND upto - own <= u""", ("links",))
def weighted_draws(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").cast("double").alias("probability"))
    return training.draws(running_sum(o, "pair_id", "probability", "cumulative"), 2000)


@query("SELECT vec_id // 4 AS fragment_id, identity, count(*) AS n_images, round(median(p), 6) AS median FROM (SELECT vec_id, list_position(v, list_max(v)) AS identity, list_max(v) AS p FROM vectors) GROUP BY ALL", ("vectors",))
def fragment_predictions(spark, d):
    v = training.predictions(fx.embeddings(spark, d), "v").withColumn("fragment_id", F.floor(F.col("vec_id") / 4))
    return training.by_fragment(v).select("fragment_id", "identity", "n_images", *six("median"))


@query("SELECT vec_id, round(v[label + 1], 6) AS probability FROM vectors", ("vectors",))
def assigned_probability(spark, d):
    return fx.embeddings(spark, d).select("vec_id", F.round(F.get("v", F.col("label").cast("int")), 6).alias("probability"))


@query(NEAREST + """, one AS (SELECT label, list(x ORDER BY k) AS centre, max(n) AS n FROM (SELECT label, k, avg(x) AS x, count(*) AS n FROM (SELECT f.nearest AS label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM near f JOIN vectors USING (vec_id)) GROUP BY ALL) GROUP BY label)
SELECT label, n, round(list_sum(centre), 6) AS total FROM one""", ("vectors",))
def lloyd_step(spark, d):
    v = fx.embeddings(spark, d)
    return clusters.lloyd(v, clusters.label_centres(v), 1).select("label", "n", F.round(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""SELECT fragment_id, start_frame, end_frame, round(((fragment_id * 7) % 997) / 7, 2) AS x, round(((fragment_id * 11) % 997) / 7, 2) AS y, array_to_string(list_transform(range(start_frame, end_frame), lambda f: f // 100), ',') AS episodes FROM fragments""", ("fragments",))
def fragment_json(spark, d):
    """Fragments written as JSON and read again, with the episode of each image."""
    i, a, b = F.col("fragment_id"), F.col("start_frame"), F.col("end_frame")
    each = F.sequence(F.floor(a / 100), F.floor((b - 1) / 100))
    episodes = F.transform(each, lambda e: F.struct(e.alias("value"), (F.least(b, (e + 1) * 100) - F.greatest(a, e * 100)).alias("n")))
    values = fragments.as_json(fx.fragments(spark, d).select("fragment_id", "start_frame", "end_frame", (i * 7 % 997 / 7).alias("x"), (i * 11 % 997 / 7).alias("y"), episodes.alias("episodes")))
    return fragments.from_json(values).withColumn("episodes", F.concat_ws(",", F.col("episodes").cast("array<string>")))


@query("SELECT global_fragment, generate_subscripts(ids, 1) - 1 AS position, unnest(ids) AS fragment_id FROM starts", GLOBALS)
def global_fragment_json(spark, d):
    states = fx.frame_states(spark, d)
    values = frames.core_starts(frames.core_flags(frames.frame_table(states), 3)).select("global_fragment", F.to_json("ids").alias("value"))
    return fragments.globals_from_json(values, states.select("fragment_id").distinct())


BEST = """+ pairs AS (SELECT frame, lead(frame) OVER (ORDER BY frame) AS nxt FROM (SELECT DISTINCT frame FROM detections)), similar_ AS (SELECT a.frame, a.instance_idx AS i, b.instance_idx AS j, exp(-sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) / 200) AS s FROM detections a JOIN pairs p ON p.frame = a.frame AND p.nxt - p.frame <= 1 JOIN detections b ON b.frame = p.nxt WHERE sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) <= 400),
best AS (SELECT s - coalesce(second, 0) AS margin FROM (SELECT *, row_number() OVER w AS r, lead(s) OVER w AS second FROM similar_ WINDOW w AS (PARTITION BY frame, i ORDER BY s DESC, j)) WHERE r = 1)"""


@query(BEST + " SELECT p AS percentile, round(CASE p WHEN 5 THEN quantile_cont(margin, 0.05) WHEN 50 THEN quantile_cont(margin, 0.5) ELSE quantile_cont(margin, 0.95) END, 6) AS margin FROM best, (SELECT unnest([5, 50, 95]) AS p) GROUP BY p", ("detections",))
def margin_percentiles(spark, d):
    return links.margin_percentiles(matches(spark, d), [5, 50, 95]).select("percentile", *six("margin"))


@query("""+ m AS (SELECT max(vec_id) AS n FROM vectors), f AS (SELECT DISTINCT floor(k * n / 19)::BIGINT AS frame FROM m, range(20) r(k)), x AS (SELECT generate_subscripts(v, 1) - 1 AS k, unnest(v) AS x FROM vectors WHERE vec_id IN (SELECT frame FROM f))
SELECT k, round(median(x), 6) AS median, round(max(x), 6) AS most FROM x GROUP BY k""", ("vectors",))
def pixel_background(spark, d):
    v = fx.embeddings(spark, d).select(F.col("vec_id").alias("frame"), "v")
    some = poses.sampled_frames(v.agg(F.max("frame") + 1).first()[0], 20)
    median, most = (poses.background(v, some, how) for how in ("median", "max"))
    return median.withColumnRenamed("value", "median").join(most.withColumnRenamed("value", "most"), "k").select("k", *six("median", "most"))


@query("SELECT ceil(median(d))::BIGINT AS disk FROM (SELECT min(cx / 3 + 1) AS d FROM detections GROUP BY frame)", ("detections",))
def erosion_disk(spark, d):
    return poses.erosion_disk(fx.detections(spark, d).select("frame", (F.col("cx") / 3 + 1).alias("distance")))


@query("""+ p AS (SELECT event_id, cx + 20 AS mx, cy + 25 AS my, CASE WHEN event_id % 3 > 0 THEN cx END AS tx, CASE WHEN event_id % 3 > 0 THEN cy WHEN event_id % 2 = 0 THEN cy + 25 END AS ty, CASE WHEN event_id % 2 = 0 THEN cx + 60 END AS fx FROM detections),
a AS (SELECT *, atan2(coalesce(tx, fx) - mx, my - ty) AS r FROM p WHERE ty IS NOT NULL AND coalesce(tx, fx) IS NOT NULL) SELECT event_id, round(cos(r) * 10 + sin(r) * 5 + mx, 6) AS x, round(-sin(r) * 10 + cos(r) * 5 + my, 6) AS y FROM a""", ("detections",))
def turned_poses(spark, d):
    i, point = F.col("event_id"), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    mx, my = F.col("cx") + 20, F.col("cy") + 25
    top, fall = point(F.when(i % 3 > 0, F.col("cx")), F.when(i % 3 > 0, F.col("cy"))), point(F.when(i % 2 == 0, F.col("cx") + 60), F.when(i % 2 == 0, F.col("cy") + 25))
    out = poses.turned(F.array(point(mx + 10, my + 5)), top, fall, point(mx, my))
    return fx.detections(spark, d).select("event_id", out[0].alias("p")).where("p is not null").select("event_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""+ q AS (SELECT event_id, cx AS x1, cy AS y1, cx + 30 AS x2, cy + 5 AS y2, cx + 25 + event_id % 7 AS x3, cy + 40 AS y3, cx - 5 AS x4, cy + 20 AS y4 FROM detections),
c AS (SELECT *, x1 * y2 - x2 * y1 AS a, x2 * y3 - x3 * y2 AS b, x3 * y4 - x4 * y3 AS c, x4 * y1 - x1 * y4 AS d FROM q)
SELECT event_id, round(abs(a + b + c + d) / 2, 4) AS area, round(((x1 + x2) * a + (x2 + x3) * b + (x3 + x4) * c + (x4 + x1) * d) / (3 * (a + b + c + d)), 4) AS x, round(((y1 + y2) * a + (y2 + y3) * b + (y3 + y4) * c + (y4 + y1) * d) / (3 * (a + b + c + d)), 4) AS y,
  round(sqrt(pow(greatest(x2, x3) - x4, 2) + 1600), 4) AS extension FROM c""", ("detections",))
def contour_geometry(spark, d):
    point = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    rows = fx.detections(spark, d).select("event_id", F.array(point(0, 0), point(30, 5), point(25 + F.col("event_id") % 7, 40), point(-5, 20)).alias("contour"))
    return rows.select("event_id", *(F.round(c, 4).alias(k) for k, c in poses.contour_geometry(F.col("contour")).items()))


@query("SELECT round(sum(p2 * s) / sum(s), 6) AS estimated_accuracy, count(*) AS n_fragments FROM p2 JOIN (SELECT fragment_id, sum(n_images) AS s FROM p2 GROUP BY fragment_id) USING (fragment_id) WHERE identity = fragment_id % 8", PROB)
def identity_accuracy(spark, d):
    given = fx.fragments(spark, d).select("fragment_id", (F.col("fragment_id") % 8).alias("identity"))
    return votes.identity_accuracy(p2(spark, d), given).select(*six("estimated_accuracy"), "n_fragments")


@query("""+ b AS (SELECT frag_a AS f, frag_b AS o FROM pairs UNION ALL SELECT frag_b, frag_a FROM pairs), h AS (SELECT f, list(DISTINCT o % 8) AS held FROM b GROUP BY f)
SELECT fragment_id, array_to_string(list_sort(list_filter(range(1, 8), lambda i: NOT list_contains(coalesce(held, []), i))), ',') AS available FROM fragments LEFT JOIN h ON f = fragment_id""", COEXIST)
def available_identities(spark, d):
    return votes.available_over(fx.fragments(spark, d).withColumn("identity", F.col("fragment_id") % 8), 7).select("fragment_id", F.concat_ws(",", F.col("available").cast("array<string>")).alias("available"))


@query("SELECT frame, count(*) FILTER (NOT is_overlapping) AS n_individual, count(*) AS n FROM detections GROUP BY frame HAVING count(*) FILTER (NOT is_overlapping) >= 12", ("detections",))
def frames_with_individuals(spark, d):
    return frames.with_individuals(fx.detections(spark, d), 12)


@query("SELECT individual, frame, round(speed, 6) AS speed FROM moved WHERE speed > (SELECT avg(speed) + 2 * stddev_pop(speed) FROM moved) AND NOT (individual = 1 AND frame % 3 = 0)", (*TRACKED, "moved"))
def unaccepted_jumps(spark, d):
    m = moved(spark, d)
    return runs.impossible_jumps(m, 2, m.where("individual = 1 and frame % 3 = 0").select("individual", "frame")).select("individual", "frame", *six("speed"))
