r"""Merkle manifest of a dataset: a tree of digests over each source's rows, one over the sources, and a proof for each row.

1. A row's leaf is the digest of its fields, each with its length, so no two rows run together. This is native and reads the texts once;
   from here on a row is its id and some 40 bytes.
2. Rows are dealt by ranges of (source, id, leaf, row), sorted and numbered where they lie; totals by range and source give each
   its place in its source. A source that holds a third of all rows is many ranges, and so is a row that is repeated.
3. A bucket is a place divided by fanout^k. applyInPandas collapses the k levels of a bucket at once and returns its root, so a
   source of a billion rows takes three rounds; sources that fit one bucket share groups. The sources' roots go the same way.
4. From the root down each bucket receives its upper proof and puts the lower proofs of its own nodes before it.

A proof is an array of (before, after), level by level: the digests of the run's other nodes, as text, on both sides of one's own.
`folded` recomputes the root from a leaf and a proof in the JVM.

Defined results: a null field is "-", and an empty one "0:". Rows without a source are a source of their own, before all others.
Within a source a null id comes first; equal ids go by leaf; repeated rows have equal leaves and neighbouring places. A null id is
never tampered with by the query. Empty tables have no rows and no root. Columns that are no fields take no part, whatever their names.
Texts of any length only pass the digest.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import settled

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, LEVELS = 16, 3


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest, as 32 bytes, of fields with their lengths in UTF-8 bytes; "-" stands for null."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*said), 256))


def folded(own: Column, proof: Column) -> Column:
    """The root, as text, that a leaf (text) has with this proof."""
    return F.aggregate(proof, own, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))


def levels_of(nodes: list[str], fanout: int, levels: int, whole: bool) -> list[list[str]]:
    """The nodes and the levels above them: all up to one node if these are the whole tree, else just `levels`."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        last = out[-1]
        out.append([digest("".join(last[k : k + fanout])) for k in range(0, len(last), fanout)])
    return out


def siblings(row: list[str], fanout: int) -> list[tuple[str, str]]:
    """For each node of a level, the digests before and after it in its run."""
    out = []
    for k in range(0, len(row), fanout):
        run = row[k : k + fanout]
        out += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
    return out


def placed(nodes: DataFrame, order: tuple[str, ...], size: int) -> DataFrame:
    """nodes (with tree) and place from 0 in the tree by `order`, n nodes of the tree, key of the group that its bucket belongs to. nodes must be a table."""
    spark = nodes.sparkSession
    dealt = nodes.withColumn("row", F.monotonically_increasing_id())
    by = ["tree", *order, "row"]
    dealt = settled(dealt.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).drop("row"), "merkle-ranges")
    part = F.shiftright("at", 33)  # the number of the partition is above the 33rd bit
    totals = dealt.groupBy("tree", part.alias("part")).agg(F.count("*").alias("here"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    totals = totals.select("tree", "part", "first", (F.sum("here").over(tree.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(tree).alias("n"))
    rows = dealt.withColumn("part", part).join(totals, ["tree", "part"]).withColumn("place", F.col("before") + F.col("at") - F.col("first")).drop("part", "before", "at", "first")
    total = dealt.count()
    return keyed(rows, size, max(-(-total // size), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def keyed(rows: DataFrame, size: int, groups: int) -> DataFrame:
    """key: a group for each bucket of a tree that has several, else one that trees share. That two keys fall together does no harm."""
    bucket = F.floor(F.col("place") / size)
    return rows.withColumn("key", F.when(F.col("n") > size, F.xxhash64("tree", bucket)).otherwise(F.pmod(F.xxhash64("tree"), F.lit(groups))))


def buckets(group: pd.DataFrame, size: int):
    """tree, bucket and its rows in order, for each bucket of a group."""
    group = group.assign(bucket=group["place"] // size).sort_values(["tree", "place"], kind="stable", ignore_index=True)
    for (tree, bucket), rows in group.groupby(["tree", "bucket"], sort=False):
        yield tree, bucket, rows


def collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The roots of nodes' buckets as nodes: tree, place, n, digest, and below, the key of the group that they come from."""
    size = fanout**levels

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, bucket, rows in buckets(group, size):
            n = int(rows["n"].iloc[0])
            top = levels_of([x.hex() for x in rows["digest"]], fanout, levels, n <= size)[-1]
            out.append((tree, bucket, -(-n // size), bytes.fromhex(top[0]), rows["key"].iloc[0]))
        return pd.DataFrame(out, columns=["tree", "place", "n", "digest", "below"])

    return nodes.select("tree", "place", "n", "digest", "key").groupBy("key").applyInPandas(run, "tree string, place long, n long, digest binary, below long")


def rounds_of(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """nodes, their buckets' roots, those of these, and so on until each tree is one node. At least two tables."""
    out, size = [nodes], fanout**levels
    while True:
        up = settled(collapsed(out[-1], fanout, levels), "merkle-nodes")
        found = up.agg(F.max("n").alias("most"), F.count("*").alias("all")).first()
        out.append(keyed(up, size, max(1, -(-found["all"] // size))))
        if (found["most"] or 0) <= 1:
            return out


def lowered(nodes: DataFrame, upper: DataFrame, fanout: int, levels: int, carried: tuple[str, ...], told: tuple[str, ...] = ("root",)) -> DataFrame:
    """`carried` columns of nodes, and before, after and the `told` columns (text) of what stands above them. upper: tree, place, below, before, after and told, a row a bucket."""
    size = fanout**levels
    kind = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def run(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        of = {(r.tree, r.place): r for r in above.itertuples()}
        out = []
        for tree, bucket, rows in buckets(group, size):
            levels_here = levels_of([x.hex() for x in rows["digest"]], fanout, levels, int(rows["n"].iloc[0]) <= size)
            up, sides = of[tree, bucket], [siblings(x, fanout) for x in levels_here[:-1]]
            upper_before, upper_after = list(up.before), list(up.after)
            before, after = [], []
            for i in range(len(rows)):
                own, at = [], i
                for side in sides:
                    own.append(side[at])
                    at //= fanout
                before.append([x for x, _ in own] + upper_before)
                after.append([x for _, x in own] + upper_after)
            out.append(rows[list(carried)].assign(before=before, after=after, **{c: getattr(up, c) for c in told}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in (*carried, "before", "after", *told)})

    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in carried), "before array<string>", "after array<string>", *(f"{c} string" for c in told)])
    nodes = nodes.select(*dict.fromkeys(["tree", "place", "n", "digest", "key", *carried]))
    return nodes.groupBy("key").cogroup(upper.select("tree", "place", "before", "after", *told, "below").groupBy("below")).applyInPandas(run, schema)


def descended(rounds: list[DataFrame], top: DataFrame, fanout: int, levels: int, carried: tuple[str, ...], told: tuple[str, ...]) -> DataFrame:
    """`carried` of the lowest nodes with their proofs. top: tree, before, after and told of each tree's one node."""
    none = F.array().cast("array<string>")
    upper = rounds[-1].join(top, "tree") if top is not None else rounds[-1].select("*", none.alias("before"), none.alias("after"), F.lower(F.hex("digest")).alias("root"))
    for nodes in rounds[-2:0:-1]:
        upper = settled(lowered(nodes, upper, fanout, levels, ("tree", "place", "below"), told), "merkle-paths")
    return lowered(rounds[0], upper, fanout, levels, carried, told)


def proofs(leaves: DataFrame, order: tuple[str, ...], carried: tuple[str, ...], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """`carried`, leaf, subroot, root (text) and proof of each row of leaves: source (text or null), digest (32 bytes), and the columns of `order` and `carried`.

    A source's rows go by `order`, then by digest. leaves is written as a table first; names starting with `_` are not for its columns.
    """
    size = fanout**levels
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("tree")
    inside = {c: f"_{k}" for k, c in enumerate(dict.fromkeys((*order, *carried)))}
    taken = settled(leaves.select(tree, "digest", *(F.col(c).alias(x) for c, x in inside.items())), "merkle-leaves")
    nodes = settled(placed(taken, (*(inside[c] for c in order), "digest"), size), "merkle-nodes")
    rounds = rounds_of(nodes, fanout, levels)

    subroots = settled(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "merkle-subroots")
    above = rounds_of(settled(placed(subroots, ("name",), size), "merkle-sources"), fanout, levels)
    of_source = descended(above, None, fanout, levels, ("name", "digest"), ("root",))
    of_source = settled(of_source.select(F.col("name").alias("tree"), "before", "after", F.lower(F.hex("digest")).alias("subroot"), "root"), "merkle-roots")

    out = descended(rounds, of_source, fanout, levels, (*(inside[c] for c in carried), "digest"), ("subroot", "root"))
    return out.select(*(F.col(inside[c]).alias(c) for c in carried), F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", F.arrays_zip("before", "after").alias("proof"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof of every row: what a consumer needs to verify it alone."""
    leaves = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), leaf([F.col(c) for c in fields]).alias("digest"))
    return proofs(leaves, ("doc_id",), ("doc_id", "source"), fanout, levels)


def tampering(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest, and how it takes texts whose capitals were lowered where 5 divides crc32(doc_id)."""
    fields = [F.col(c) for c in FIELDS]
    changed = [F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if name == "text" else c for name, c in zip(FIELDS, fields, strict=True)]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf(fields).alias("digest"), F.when(hit, leaf(changed)).alias("tampered"))
    found = proofs(leaves, ("doc_id",), ("doc_id", "tampered"))
    own = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    said = F.concat_ws("", F.transform("proof", lambda p: F.concat(p["before"], p["after"])))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(said, 256).alias("proof_sha256"), folded(own, F.col("proof")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
