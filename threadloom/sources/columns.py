"""Columns that are derived from others: appending one drops what has been derived from an older one of its name, and leaves everything else as it was.

A manifest says from which columns each derived one comes. Content is compared by digests that do not depend on the order of rows: sums of
60-bit hashes of key and value, so that each is one aggregation with partial sums, whatever the number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Manifest = dict[str, tuple[str, ...]]


def stale(manifest: Manifest, name: str) -> list[str]:
    """Columns derived from name, directly or not, in the order of the manifest."""
    gone = {name}
    while True:
        more = {c for c, parents in manifest.items() if gone & set(parents)} - gone
        if not more:
            return [c for c in manifest if c in gone - {name}]
        gone |= more


def digests(rows: DataFrame, key: str) -> DataFrame:
    """column, n (not null), digest (decimal) of each column but the key. A value counts as its text, and null as none."""
    names = [c for c in rows.columns if c != key]
    said = lambda c: F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")))
    number = lambda c: F.conv(F.substring(F.md5(said(c)), 1, 15), 16, 10).cast("decimal(38,0)")
    one = rows.agg(*(F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("n"), F.coalesce(F.sum(number(c)), F.lit(0).cast("decimal(38,0)")).alias("digest")).alias(f"_{k}") for k, c in enumerate(names)))
    return one.select(F.explode(F.array(*(F.col(f"_{k}") for k in range(len(names))))).alias("d")).select("d.*")


def appended(rows: DataFrame, manifest: Manifest, name: str, value: Column, parents: tuple[str, ...]) -> tuple[DataFrame, Manifest]:
    """rows with the column, without those that an older one of this name was the source of, and the new manifest."""
    missing = [c for c in parents if c not in rows.columns]
    if missing:
        raise ValueError(f"{name} is to come from columns that are not there: {missing}")
    gone = stale(manifest, name)
    if set(gone) & set(parents):
        raise ValueError(f"{name} would come from itself, through {sorted(set(gone) & set(parents))}")
    out = rows.withColumn(name, value).drop(*gone)
    return out, {c: p for c, p in manifest.items() if c not in gone and c != name} | {name: tuple(parents)}


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, change: added, dropped, changed or same, by the digests of two versions."""
    a, b = before.select("column", F.col("digest").alias("_a")), after.select("column", F.col("digest").alias("_b"))
    how = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "dropped").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, "column", "full_outer").select("column", how.alias("change"))
