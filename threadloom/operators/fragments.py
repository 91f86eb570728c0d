"""Fragments as a whole: numbers, statistics, splits, orders of global fragments, regions, and their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.intervals import n_coexisting
from threadloom.operators.order import quantiles, ranked


def numbered(fragments: DataFrame) -> DataFrame:
    """Adds number, from 0: by start_frame, then first_instance, then fragment_id."""
    return ranked(fragments, "start_frame", "number", ("first_instance", "fragment_id"))


def stamped(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """rows (node, frame, instance_idx) with the number of their chain as fragment. Raises where a row is in no chain."""
    r = rows.join(chains.select("node", "chain"), "node", "left")
    if r.where("chain is null").limit(1).count():
        raise ValueError("rows without a chain")
    first = r.groupBy(F.col("chain").alias("fragment_id")).agg(F.min("frame").alias("start_frame"), F.min_by("instance_idx", F.struct("frame", "instance_idx")).alias("first_instance"))
    return r.join(numbered(first).select(F.col("fragment_id").alias("chain"), F.col("number").alias("fragment")), "chain").drop("chain")


def statistics(fragments: DataFrame) -> DataFrame:
    """One row of 16 counters. fragments: n_images, is_crossing, in_global, accumulable (may be null), globally, partially.

    As in what this follows, individual_blobs_not_in_a_global_fragment counts fragments, not images.
    """
    n, one = F.col("n_images"), F.lit(1)
    single, crossing = ~F.col("is_crossing"), F.col("is_crossing")
    total = lambda what, when: F.coalesce(F.sum(F.when(when, what)), F.lit(0))
    of = {
        "fragments": (one, F.lit(True)), "crossing_fragments": (one, crossing), "individual_fragments": (one, single), "individual_fragments_not_in_a_global_fragment": (one, single & ~F.col("in_global")),
        "accumulable_individual_fragments": (one, single & F.col("accumulable")), "not_accumulable_individual_fragments": (one, single & ~F.col("accumulable")),
        "globally_accumulated_individual_fragments": (one, single & F.col("globally")), "partially_accumulated_individual_fragments": (one, single & F.col("partially")),
        "blobs": (n, F.lit(True)), "crossing_blobs": (n, crossing), "individual_blobs": (n, single), "individual_blobs_not_in_a_global_fragment": (one, single & (~F.col("in_global") | (n == 0))),
        "accumulable_individual_blobs": (n, F.col("accumulable")), "not_accumulable_individual_blobs": (n, ~F.col("accumulable")),
        "globally_accumulated_individual_blobs": (n, single & F.col("globally")), "partially_accumulated_individual_blobs": (n, single & F.col("partially")),
    }
    return fragments.agg(*(total(what, when).alias(name) for name, (what, when) in of.items()))


def accumulable_split(members: DataFrame) -> DataFrame:
    """fragment_id, accumulable: of the fragments of global fragments (fragment_id, accumulable), those in any accumulable one, and the others."""
    return members.groupBy("fragment_id").agg(F.max("accumulable").alias("accumulable"))


def ranked_globals(globals_: DataFrame, frame: int) -> DataFrame:
    """global_fragment, by_distance, by_frame: places from 1 by greatest min_distance, and by how near start_frame is to a frame; ties to the lesser number. The first by distance seeds accumulation. A row a global fragment."""
    place = lambda *o: F.row_number().over(Window.orderBy(*o, "global_fragment"))
    return globals_.select("global_fragment", place(F.desc("min_distance")).alias("by_distance"), place(F.abs(F.col("start_frame") - frame)).alias("by_frame"))


def connectivity(fragments: DataFrame, n_animals: int, least: int) -> DataFrame:
    """One row: n_long, n_images, n_negative, connectivity of the individual fragments of at least `least` images, and whether clusters of n_animals can be learnt from them: enough_images, some_coexist. Fragments coexist as their intervals overlap, which is counted without their pairs. fragments: video_id, fragment_id, start_frame, end_frame, n_images."""
    long = fragments.where(F.col("n_images") >= least)
    both = long.agg(F.count("*").alias("n_long"), F.coalesce(F.sum("n_images"), F.lit(0)).alias("n_images")).crossJoin(F.broadcast(n_coexisting(long).withColumnRenamed("n_pairs", "n_negative")))
    share = F.try_divide(2 * F.col("n_negative"), F.col("n_long") * (n_animals - 1))
    return both.select("n_long", "n_images", "n_negative", share.alias("connectivity"), (F.col("n_images") >= n_animals).alias("enough_images"), (F.col("n_negative") > 0).alias("some_coexist"))


def crop_geometry(instances: DataFrame, most: int | None = 6400) -> DataFrame:
    """One row: width, height, centre_y, scale of crops that hold a typical animal. instances: x_spread, y_extent, d_bottom (below the centre; may be null).

    Medians are rounded half to even. Where the area is above `most`, sides shrink by the root of the ratio, down where rounding goes above it again.
    """
    whole = lambda c: F.bround(c).cast("long")
    medians = quantiles(instances, ("x_spread", "y_extent", "d_bottom"), [0.5])
    raw = medians.select(whole(F.col("x_spread")[0]).alias("w"), whole(F.col("y_extent")[0]).alias("h"), F.col("d_bottom")[0].alias("bottom")).where("w is not null")
    raw = raw.withColumn("cy", whole(F.col("h") - F.col("bottom")))
    large = F.lit(False) if most is None else F.col("w") * F.col("h") > most
    raw = raw.withColumn("scale", F.when(large, F.sqrt(F.lit(float(most or 1)) / (F.col("w") * F.col("h")))).otherwise(1.0))
    near = [whole(F.col(c) * F.col("scale")) for c in ("w", "h")]
    over = F.lit(False) if most is None else near[0] * near[1] > most
    side = lambda k, c: F.when(large, F.greatest(F.when(over, F.floor(F.col(c) * F.col("scale"))).otherwise(near[k]), F.lit(1))).otherwise(F.col(c))
    return raw.select(side(0, "w").alias("width"), side(1, "h").alias("height"), whole(F.col("cy") * F.col("scale")).alias("centre_y"), "scale")


def body_length_of(attributes: DataFrame) -> DataFrame:
    """One row: body_length as the first episode says that has it, else the older attribute height."""
    value = F.coalesce("body_length", "height")
    return attributes.agg(F.min_by(value, F.when(value.isNotNull(), F.col("episode"))).alias("body_length"))


def region_index(x: Column, y: Column, regions: list[tuple[float, float, float, float]]) -> Column:
    """Number of the first rectangle (x1, y1, x2, y2) that holds a point, ends included; null where none does."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(regions))):
        x1, y1, x2, y2 = regions[k]
        out = F.when((x >= x1) & (x <= x2) & (y >= y1) & (y <= y2), k).otherwise(out)
    return out


def region_groups(identities: DataFrame) -> DataFrame:
    """region, identities (sorted): which identities are bound to which region. identities: identity, region (null or -1: to none)."""
    return identities.where("region >= 0").groupBy("region").agg(F.sort_array(F.collect_set("identity")).alias("identities"))


def crossing_rule(blobs: DataFrame, least: int = 10) -> DataFrame:
    """Adds is_individual: what is sure (sure_individual, sure_crossing); of the rest, as seems_individual where fewer than `least` of either are sure, else null, for a classifier to say."""
    n = blobs.agg((F.least(F.count_if("sure_individual"), F.count_if("sure_crossing")) < least).alias("_few"))
    sure = F.when(F.col("sure_individual"), True).when(F.col("sure_crossing"), False).when(F.col("_few"), F.col("seems_individual"))
    return blobs.crossJoin(F.broadcast(n)).withColumn("is_individual", sure).drop("_few")


def as_json(fragments: DataFrame) -> DataFrame:
    """fragment_id, value: a fragment as JSON, positions rounded to 2 digits, episodes as runs. fragments: fragment_id, start_frame, end_frame, x, y, episodes (array of runs: value, n)."""
    rounded = [F.round(c, 2).alias(c) for c in ("x", "y")]
    return fragments.select("fragment_id", F.to_json(F.struct("fragment_id", "start_frame", "end_frame", *rounded, "episodes")).alias("value"))


FRAGMENT = "fragment_id long, start_frame long, end_frame long, x double, y double, episodes array<struct<value:long,n:long>>"


def from_json(values: DataFrame) -> DataFrame:
    """as_json undone, with episodes written out: an episode for each image."""
    f = values.select(F.from_json("value", FRAGMENT).alias("f")).select("f.*")
    return f.withColumn("episodes", F.flatten(F.transform("episodes", lambda r: F.array_repeat(r["value"], r["n"].cast("int")))))


def globals_from_json(values: DataFrame, fragments: DataFrame) -> DataFrame:
    """global_fragment, position, fragment_id and the fragments' columns, of values (a JSON list of ids a row: global_fragment, value). Fragments that are not there raise."""
    ids = values.select("global_fragment", F.posexplode(F.from_json("value", "array<long>")).alias("position", "fragment_id"))
    if ids.join(fragments, "fragment_id", "left_anti").limit(1).count():
        raise ValueError("global fragments of unknown fragments")
    return ids.join(fragments, "fragment_id")
