r"""A trie of conversations: each node is a distinct sequence of first turns, with the conversations that begin so.

1. A turn is the digest of its role and text and a number of words, 40 bytes from here on; a conversation is the list of its turns.
2. Equal conversations are one sequence with a count, summed before the shuffle, so that a conversation copied a billion times
   is one row. What the copies' ids are needed for, the digest of those that end at a node, is taken apart: ids are dealt by ranges of
   (sequence, id), each range joins its runs to strings, and the strings of a sequence are hashed in order as they stream by.
3. Sequences are dealt by the hash of their first turn, and many first turns share one call of applyInPandas, which builds tries of
   dictionaries and adds up subtrees in postorder, children having higher numbers than their parents.
4. Where more than `most` different sequences share a first turn, its node is summed by an aggregation and its sequences are dealt
   by their next turn, and so on. The root itself is the first node that is split so. From the deepest such nodes
   upwards, the sums of their children, one row for each, make theirs.

`most` is twice the fair share of a task, 64 at least and MOST at most, so no call holds a large part of the sequences. A
preamble of k turns that so many different conversations share takes k rounds. A conversation's list has to fit a task:
40 bytes a turn.

Defined results: rows without a conversation belong to none. Null roles and texts are empty. Equal turns of a conversation go by
the digest of role and text; repeated rows are repeated turns. Empty texts have no words. An empty table has no node, not even a
root. Other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import settled

MOST, LEAST = 8192, 64
#: How many ids are joined to one string.
RUN = 4096
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def lists(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: an array of (digest, words) in the order of turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.struct(F.col(turn_col).alias("turn"), said.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))))


def shared_starts(found: DataFrame, step: int = 20, kinds: int = 4) -> DataFrame:
    """Lists whose first h turns are those of the conversation at the start of its block of `step` ids; h = crc32(id) mod kinds."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int")
    start = F.col("conv_id") - F.pmod("conv_id", F.lit(step))
    heads = found.where(start == F.col("conv_id")).select(F.col("conv_id").alias("start"), F.slice("turns", 1, kinds).alias("head"))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return found.withColumn("start", start).join(heads, "start", "left").select("conv_id", F.concat(head, own).alias("turns"))


def ends_of(members: DataFrame) -> DataFrame:
    """seq, ends: the digest of a sequence's ids, ascending and joined by commas. Only strings of RUN ids meet, and they stream."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids = None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["seq", "first", "ids"])
        for b in batches:
            for s, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != seq or len(ids) == RUN:
                    if ids:
                        yield made()
                    seq, ids = s, []
                ids.append(i)
        if ids:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state, out = None, None, []
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["seq", "ends"])
        for b in batches:
            for s, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s != seq:
                    if state:
                        out.append((seq, state.hexdigest()))
                    seq, state = s, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if len(out) > RUN:
                yield flushed()
                out = []
        if state:
            out.append((seq, state.hexdigest()))
        yield flushed()

    runs = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(joined, "seq binary, first long, ids string")
    return runs.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed, "seq binary, ends string")


def tries(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of a group of (prefix, parent, parent_conv, depth, conv_id, n, digests, words, ends); digests begin with the prefix's last."""
    tops: dict[bytes, int] = {}
    kids: list[dict[bytes, int]] = []
    up, depth, least, count, words, ends, parent = [], [], [], [], [], [], {}

    def node(above: int, at: int, w: int) -> int:
        for column, value in ((kids, {}), (up, above), (depth, at), (least, None), (count, 0), (words, w), (ends, None)):
            column.append(value)
        return len(kids) - 1

    for prefix, above, above_conv, start, conv, n, digests, ws, end in group.itertuples(index=False, name=None):
        i = tops.get(prefix)
        if i is None:
            i = tops[prefix] = node(-1, start, int(ws[0]))
            parent[i] = (above, above_conv)
        for k in range(len(digests)):
            if k:
                j = kids[i].get(digests[k])
                if j is None:
                    j = kids[i][digests[k]] = node(i, start + k, int(ws[k]))
                i = j
            count[i] += n
            least[i] = conv if least[i] is None else min(least[i], conv)
        ends[i] = end

    leaves = [0] * len(kids)
    saved = [(c - 1) * w for c, w in zip(count, words, strict=True)]
    for i in range(len(kids) - 1, -1, -1):  # postorder
        leaves[i] = leaves[i] or 1
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    above = [parent[i] if u < 0 else (None, least[u]) for i, u in enumerate(up)]
    return pd.DataFrame({
        "conv_id": least, "depth": depth, "parent_conv_id": [c for _, c in above], "n_convs": count, "n_children": [len(k) for k in kids], "n_leaves": leaves,
        "saved_tokens": saved, "ends_sha256": ends, "parent": [p for p, _ in above],
    })


def prefix_trie(found: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node. found: conv_id (each once), turns.

    A node is named by its least conversation and its depth: its text is that conversation's turn of this number.
    """
    spark = found.sparkSession
    seq = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""), 256))
    found = settled(found.select("conv_id", "turns", seq.alias("seq")), "trie-lists")
    distinct = found.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
    open_ = settled(distinct.join(ends_of(found.select("seq", "conv_id")), "seq"), "trie-sequences")
    total, tasks = open_.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = most or max(LEAST, min(MOST, -(-2 * total // tasks)))
    groups = max(tasks, -(-total // most))

    open_ = open_.select(F.unhex(F.sha2(F.lit(""), 256)).alias("prefix"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("parent_conv"), "conv_id", "n", "turns", "ends")
    split, whole, depth = [], [], 0
    while True:
        own = F.element_at("turns", depth)["words"] if depth else F.lit(0)
        sizes = open_.groupBy("prefix").agg(
            F.count("*").alias("sequences"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("least"), F.first("parent").alias("above"), F.first("parent_conv").alias("above_conv"),
            F.first(own).alias("words"), F.max(F.when(F.size("turns") == depth, F.col("ends"))).alias("own_ends"),
        )
        hot = settled((sizes.where(F.col("sequences") > most) if depth else sizes), "trie-split")
        if depth and hot.isEmpty():
            whole.append((open_, depth))
            break
        if depth:
            whole.append((open_.join(hot.select("prefix"), "prefix", "left_anti"), depth))
        split.append(hot)
        on = open_.where(F.size("turns") > depth).join(hot.select("prefix", "least"), "prefix")
        step = F.unhex(F.sha2(F.concat(F.hex("prefix"), F.hex(F.element_at("turns", depth + 1)["digest"])), 256))
        open_ = settled(on.select(step.alias("next"), F.col("prefix").alias("parent"), F.col("least").alias("parent_conv"), "conv_id", "n", "turns", "ends").withColumnRenamed("next", "prefix"), "trie-open")
        depth += 1

    nodes = None
    for rows, at in whole:
        tail = F.slice("turns", F.lit(at), F.size("turns"))
        rows = rows.select("prefix", "parent", "parent_conv", F.lit(at).alias("depth"), "conv_id", "n", F.transform(tail, lambda t: t["digest"]).alias("digests"), F.transform(tail, lambda t: t["words"]).alias("words"), "ends")
        nodes = rows if nodes is None else nodes.union(rows)
    key = F.pmod(F.xxhash64("prefix"), F.lit(groups))
    nodes = settled(nodes.groupBy(key.alias("key")).applyInPandas(lambda _, group: tries(group), f"{NODE}, parent binary"), "trie-nodes")

    tops = nodes.where("parent is not null")
    out, above = nodes.drop("parent"), None
    for at in range(len(split) - 1, -1, -1):
        children = tops.where(F.col("depth") == at + 1).select("parent", "n_leaves", "saved_tokens")
        if above is not None:
            children = children.union(above.select("parent", "n_leaves", "saved_tokens"))
        sums = children.groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        above = settled(split[at].join(sums, "prefix", "left").select(
            F.col("least").alias("conv_id"), F.lit(at).alias("depth"), F.col("above_conv").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("below", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), F.col("own_ends").alias("ends_sha256"), F.col("above").alias("parent"),
        ), "trie-tops")
        out = out.union(above.drop("parent"))
    return out.withColumn("depth", F.col("depth").cast("long")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def rebuilt_trie(conversations: DataFrame, most: int | None = None) -> DataFrame:
    """prefix_trie of conversations that share their first turns with the start of their block."""
    return prefix_trie(shared_starts(settled(lists(conversations), "trie-turns")), most)
