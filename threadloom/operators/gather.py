"""Images asked for by number: draws of one from each fragment of a pair, and lists that keep their order and may ask twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.sampling import lot


def drawn_images(draws: DataFrame, pairs: DataFrame, fragments: DataFrame, seed: int = 1) -> DataFrame:
    """draw, pair_id, image_a, image_b: for each draw of a pair a number from 0 below each fragment's n_images, by a lot of the draw. pairs: pair_id, frag_a, frag_b.

    A fragment's images are numbered in it, so the one that is drawn is found by an equality and none are ranked.
    """
    out = draws.select("draw", "pair_id").join(pairs.select("pair_id", "frag_a", "frag_b"), "pair_id")
    for k, side in enumerate("ab"):
        n = fragments.select(F.col("fragment_id").alias(f"frag_{side}"), F.col("n_images").alias(f"_n{side}"))
        out = out.join(n, f"frag_{side}").withColumn(f"image_{side}", F.pmod(lot(F.col("draw") * 2 + k + 1, seed), F.col(f"_n{side}")))
    return out.select("draw", "pair_id", "image_a", "image_b")


def gathered(requests: DataFrame, images: DataFrame) -> DataFrame:
    """requests (ordinal, episode, image) with what images (episode, image, ...) hold of them, in the order of ordinals over the partitions and within each.

    An image that is asked for often is one row of its side, whichever way Spark joins; one that is not there has nulls.
    """
    return requests.select("ordinal", "episode", "image").join(images, ["episode", "image"], "left").repartitionByRange("ordinal").sortWithinPartitions("ordinal")
