r"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and union-find groups.

1. Each text's shingles give a SuperMinHash signature of SLOTS values. In round j every shingle draws a value between j and j + 1
   and the next slot of a random permutation of its own, so the slots' values are correlated and the signature varies less
   than one of independent hashes; after round j a text whose slots all hold values below j + 1 is finished, which for most texts is
   so after one or two rounds.
2. Texts with equal shingle sets are one class, of which one row goes on. Classes that share a band of ROWS slots meet in that
   band's bucket. With 24 bands of 3 slots, a pair of similarity 0.8 meets in none with probability 3e-8.
3. A bucket of so many members, or such long ones, that a task should not hold it, is first compared with its root alone, the
   least member: those whose signatures are close to the root's are verified on full sets, and components of these links
   name groups. Members of one group are connected and need not meet any more. So of a large bucket only the members
   outside its largest group meet, each other and that group, in sides of SIDE members, two in a task. A template with
   a hundred thousand near copies costs about as many comparisons, not their square.
4. In each bucket, or two sides of it, pairs of different groups are compared by their whole signatures, and in the first bucket
   that they share only. Members with a partner above CLOSE go on with their full shingle sets; similarities are then exact,
   and of the links found a spanning forest leaves the bucket, no more rows than it has members. There too, what is
   connected already is not compared again.
5. The links' components are found by alternating star contractions, table by table, until nothing changes.

Defined results: null text and text without words have an empty set and are linked with nothing. Texts of fewer words than a shingle
have one shingle, the whole sequence. Very long texts take part whole. A null id comes after all others, stays null and is kept only
where its component has no other id. Rows that share an id are one document: what either is linked with, both are. Repeated rows have one result
each. Empty tables give no rows. Columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import long_texts, settled
from threadloom.llm.substrings import BASES, LAST_ID, hashes, mixed, rolled
from threadloom.sources.tables import removed, written

SHINGLE, PERCENT = 4, 80
SLOTS, ROWS = 72, 3
#: Equal slots of 72 below which a pair is not verified: five standard deviations below 0.8.
CLOSE = 40
#: Members in a side of a large bucket, and shingles that they have together.
SIDE, SIDE_SHINGLES = 2048, 1 << 22
#: Shingles whose signatures are made together.
TOGETHER = 1 << 17
#: Ids of texts to read again are broadcast up to this number, and joined beyond it.
BROADCAST_IDS = 2_000_000
#: Roots of large buckets whose signatures are broadcast, and bytes of their full sets.
BROADCAST_ROOTS, BROADCAST_BYTES = 100_000, 32 << 20


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted; A-Z is lower-cased before."""
    h = hashes((text or "").encode("utf-8", "surrogatepass").lower().split())  # lower() of bytes is that of A-Z alone
    if len(h) >= size:
        return np.unique(rolled(h, size, BASES[0]))
    return rolled(h, len(h), BASES[1]) + np.uint64(len(h)) if len(h) else h


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set, vectorised over the shingles of all. Values are whole numbers, round << 32 | draw."""
    sizes = np.array([len(s) for s in sets], np.int64)
    low = np.full(len(sets) * slots, np.iinfo(np.int64).max, np.int64)
    item = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for j in range(slots):
        draw = mixed(item + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = np.int64(j << 32) | (draw >> np.uint64(32)).astype(np.int64)
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = k
        else:
            rows = np.arange(len(item))
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[rows, j]
            order[rows, j] = slot
        np.minimum.at(low, doc * slots + slot, value)
        open_docs = low.reshape(-1, slots).max(axis=1) >= np.int64((j + 1) << 32)
        going = open_docs[doc]
        if not going.any():
            break
        if order is None:
            item, doc, k = item[going], doc[going], k[going]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(item), 1))
            rows = np.arange(len(item))
            order[rows, k] = 0
            order[:, 0] = k
        elif not going.all():
            item, doc, order = item[going], doc[going], order[going]
    return (low.reshape(-1, slots) & 0xFFFF).astype(np.uint16)


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """id, text -> id, n, a, b (128 bits of the set), sig (empty where there are no shingles)."""
    names = ["id", "n", "a", "b", "sig"]

    def out(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sig = signatures(sets)
        key = [(int(mixed(s).sum(dtype=np.uint64).view(np.int64)), int(mixed(s ^ np.uint64(BASES[1])).sum(dtype=np.uint64).view(np.int64))) for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in key], pa.int64()), pa.array([b for _, b in key], pa.int64()), pa.array([g.tobytes() if len(s) else b"" for g, s in zip(sig, sets, strict=True)], pa.binary())], names)

    for b in batches:
        ids, sets, held = [], [], 0
        for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = shingles(x.as_py(), size)
            ids.append(i)
            sets.append(s)
            held += len(s)
            if held >= TOGETHER or len(ids) >= 4096:
                yield out(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield out(ids, sets)


def grouped(keys: list[str], f: Callable[[pa.Table], list[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by keys: f of each run of equal keys. Many small groups cost no more than their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema.names)

        def parts(table: pa.Table) -> list[int]:
            new = np.zeros(len(table), bool)
            for k in keys:
                x = np.array(table.column(k))
                new[1:] |= x[1:] != x[:-1]
            return [0, *np.flatnonzero(new).tolist()]

        def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
            return all(a.column(k)[len(a) - 1].as_py() == b.column(k)[0].as_py() for k in keys)

        for b in batches:
            if not len(b):
                continue
            if held and not same(held[-1], b):
                rows += f(pa.Table.from_batches(held))
                held = []
            cuts = parts(pa.Table.from_batches([b]))
            for i, at in enumerate(cuts):
                held.append(b.slice(at, (cuts[i + 1] if i + 1 < len(cuts) else len(b)) - at))
                if i + 1 < len(cuts):
                    rows += f(pa.Table.from_batches(held))
                    held = []
            if len(rows) >= 10_000:
                yield flush()
        if held:
            rows += f(pa.Table.from_batches(held))
        yield flush()

    return run


def close_members(t: pa.Table, close: int = CLOSE, slots: int = SLOTS, rows: int = ROWS) -> list[tuple]:
    """Of one bucket and pair of sides: members with a partner that looks close, where this band is the first that the pair shares."""
    band, sides = t.column("band")[0].as_py(), np.array(t.column("side"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(t), slots)
    group = np.array(t.column("g"))
    own = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    left, right = (np.arange(len(t)),) * 2 if own else (np.flatnonzero(sides == t.column("i")[0].as_py()), np.flatnonzero(sides != t.column("i")[0].as_py()))
    found = np.zeros(len(t), bool)
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        equal = np.zeros((len(some), len(right)), np.uint8)
        earlier = np.zeros(equal.shape, bool)
        run = np.ones(equal.shape, bool)
        for s in range(slots):
            e = sig[some, s][:, None] == sig[right, s][None, :]
            equal += e
            if s < band * rows:
                run = e if s % rows == 0 else run & e
                if s % rows == rows - 1:
                    earlier |= run
        hit = (equal >= close) & ~earlier & (group[some][:, None] != group[right][None, :])
        found[some[hit.any(axis=1)]] = True
        found[right[hit.any(axis=0)]] = True
    c = t.column("c")
    key = [t.column(k)[0].as_py() for k in KEY]
    return [(*key, c[int(i)].as_py()) for i in np.flatnonzero(found)]


def exact_links(t: pa.Table, percent: int = PERCENT) -> list[tuple]:
    """A spanning forest, as (root, member), of the links among a bucket's members, by their full sets."""
    c = np.array(t.column("c"))
    sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    all_ = every[order], owner[order]
    up = list(range(len(c)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    # the largest component so far, and the postings of what is outside: its members look for others there
    home, outside = -1, all_
    for x in range(len(c)):
        every, owner = outside if root(x) == home else all_
        lo = np.searchsorted(every, sets[x])
        n = np.searchsorted(every, sets[x], side="right") - lo
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        both = np.bincount(owner[at], minlength=len(c))
        grown = False
        for y in np.flatnonzero(100 * both >= percent * (sizes[x] + sizes - both)).tolist():
            a, b = root(x), root(y)
            if a != b:
                up[max(a, b)] = min(a, b)
                grown = True
        if grown:
            roots = np.array([root(i) for i in range(len(c))])
            found, size = np.unique(roots, return_counts=True)
            if len(found) == 1:
                break
            most = int(found[size.argmax()])
            every, owner = outside if most == home else all_
            keep = roots[owner] != most
            home, outside = most, (every[keep], owner[keep])
    out = []
    for x in range(len(c)):
        r = root(x)
        if r != x:
            out.append((int(c[r]), int(c[x])))
    return out


KEY = ("band", "bucket", "i", "j")


def near_root(batches: Iterator[pa.RecordBatch], close: int = CLOSE) -> Iterator[pa.RecordBatch]:
    """c, root, sig, root_sig -> the pairs (c, root) whose signatures are close."""
    for b in batches:
        own, other = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(len(b), -1) for k in (2, 3))
        near = pa.array((own == other).sum(axis=1) >= close) if len(b) else pa.array([], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], ["c", "root"])


def similar_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """u, v and their full sets -> the pairs (u, v) that are linked."""
    for b in batches:
        linked = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        linked = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(linked), b.column(1).filter(linked)], ["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root: for each node of edges (u, v) the least node that it is connected with.

    Each step lets every node point its greater neighbours at its least one (large star), then every node its lesser ones (small
    star), and writes the edges; these tables are the steps' only state, of which the last stays. Sums of hashes tell when nothing has changed.
    """
    with written() as paths:
        e = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
        return _contracted(e, name, paths)


def _contracted(e: DataFrame, name: str, paths: list[str]) -> DataFrame:
    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        mins = least(large)
        small = large.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.withColumnRenamed("m", "v"))
        e = settled(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        removed(e.sparkSession, paths[:-1])
        del paths[:-1]


def grouped_documents(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, component (null: LAST_ID's): a row for each row of docs."""
    long_texts(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text_col).alias("text"))
    rows = settled(texts.mapInArrow(lambda b: _signed(b, size), "id long, n long, a long, b long, sig binary"), "near-signatures")
    classes = settled(rows.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("first"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig")).withColumn("c", F.monotonically_increasing_id()), "near-classes")

    with written() as paths:
        roots = components(_links(texts, rows, classes, percent, size), "near-links")
    removed(docs.sparkSession, paths[:-1])  # all but the links
    named = classes.select("a", "b", "first").join(roots.select(F.col("node").alias("first"), "root"), "first", "left").select("a", "b", F.coalesce("root", "first").alias("component"))
    return rows.where("n > 0").join(named, ["a", "b"]).select("id", "n", "component").unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))


def few(some: DataFrame, sure: bool) -> DataFrame:
    """some, to be broadcast where its size has been found to be below a bound."""
    return F.broadcast(some) if sure else some


def _links(texts: DataFrame, rows: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame:
    """u, v: links between the first documents of classes, and from documents of several texts to the classes of these."""
    bands = classes.select("c", "n", F.posexplode(F.array(*(F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(SLOTS // ROWS)))).alias("band", "bucket"))
    sides = lambda k, n: F.greatest(F.ceil(k / SIDE), F.ceil(n / SIDE_SHINGLES)).cast("int")
    shared = settled(bands.groupBy("band", "bucket").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("c").alias("root")).where("k > 1").select("band", "bucket", "root", sides(F.col("k"), F.col("n")).alias("sides")), "near-buckets")
    signed = classes.select("c", "n", "sig")

    def full_sets(some: DataFrame) -> DataFrame:
        """c, shingles: the full sets of some classes (c), from the texts themselves."""
        wanted = settled(some.distinct().join(classes.select("c", "first", "a", "b"), "c"), "near-wanted")
        ids = wanted.select(F.col("first").alias("id")).distinct()
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, len(b), 1000):
                    found = [shingles(x.as_py(), size) for x in b.column(1).slice(at, 1000)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in found], pa.int64()), pa.array([int(mixed(s ^ np.uint64(BASES[1])).sum(dtype=np.uint64).view(np.int64)) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["a", "b", "shingles"])

        return settled(texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(sets, "a long, b long, shingles binary").join(wanted, ["a", "b"]).dropDuplicates(["c"]).select("c", "shingles"), "near-sets")

    # large buckets: links with their roots, and the groups that these make
    large = shared.where("sides > 1")
    if large.isEmpty():
        stars = None
        members = bands.join(shared, ["band", "bucket"]).select("band", "bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "c", F.col("c").alias("g"))
    else:
        n_large = large.count()
        rooted = bands.join(few(large, n_large <= BROADCAST_IDS), ["band", "bucket"]).where("c <> root").select("c", "root").distinct()
        # roots are as few as large buckets, but each is a key that a large part of the classes may share
        own = signed.join(few(large.select(F.col("root").alias("c")).distinct(), n_large <= BROADCAST_IDS), "c").select(F.col("c").alias("root"), F.col("sig").alias("root_sig"))
        rooted = rooted.join(signed.select("c", "sig"), "c").join(few(own, n_large <= BROADCAST_ROOTS), "root")
        rooted = settled(rooted.select("c", "root", "sig", "root_sig").mapInArrow(near_root, "c long, root long"), "near-rooted")
        with written() as sets_at:
            full = full_sets(rooted.select(F.explode(F.array("c", "root")).alias("c")))
        of_roots = full.join(rooted.select(F.col("root").alias("c")).distinct(), "c", "left_semi").select(F.col("c").alias("root"), F.col("shingles").alias("root_shingles"))
        weight = of_roots.agg(F.sum(F.octet_length("root_shingles"))).first()[0] or 0
        both = rooted.join(full, "c").join(few(of_roots, weight <= BROADCAST_BYTES), "root")
        stars = settled(both.select(F.col("c").alias("u"), F.col("root").alias("v"), "shingles", "root_shingles").mapInArrow(lambda b: similar_pairs(b, percent), "u long, v long"), "near-stars")
        removed(texts.sparkSession, sets_at)
        groups = components(stars, "near-groups").select(F.col("node").alias("c"), F.col("root").alias("g"))
        named = bands.join(shared, ["band", "bucket"]).join(groups, "c", "left").withColumn("g", F.coalesce("g", "c"))
        # the largest group of a large bucket is its home; all members of another bucket are outside
        homes = named.where("sides > 1").groupBy("band", "bucket", "g").agg(F.count("*").alias("k"), F.sum("n").alias("n")).groupBy("band", "bucket").agg(
            F.max_by("g", F.struct("k", "g")).alias("home"), F.max_by("k", F.struct("k", "g")).alias("_k"), F.max_by("n", F.struct("k", "g")).alias("_n"), F.sum("k").alias("k"), F.sum("n").alias("n")
        )
        homes = homes.select("band", "bucket", "home", sides(F.col("k") - F.col("_k"), F.col("n") - F.col("_n")).alias("out"), sides(F.col("_k"), F.col("_n")).alias("in"))
        named = named.join(homes, ["band", "bucket"], "left").withColumn("out", F.coalesce("out", F.lit(1))).withColumn("in", F.coalesce("in", F.lit(0)))
        at_home = F.coalesce(F.col("g") == F.col("home"), F.lit(False))
        named = named.withColumn("side", F.when(at_home, F.col("out") + F.pmod(F.xxhash64("c"), F.col("in"))).otherwise(F.pmod(F.xxhash64("c"), F.greatest("out", F.lit(1)))).cast("int"))
        # sides outside meet all sides, those at home the ones outside
        others = F.filter(F.sequence(F.lit(0), F.col("out") + F.col("in")), lambda o: (o < F.col("out") + F.col("in")) & (~at_home | (o < F.col("out"))))
        members = named.withColumn("meet", F.explode(F.transform(others, lambda o: F.struct(F.least("side", o).alias("i"), F.greatest("side", o).alias("j"))))).select("band", "bucket", "meet.i", "meet.j", "side", "c", "g")
    members = members.join(signed.select("c", "sig"), "c").select(*KEY, "side", "c", "g", "sig")
    kinds = [("band", pa.int32()), ("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("c", pa.int64())]
    close = settled(members.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(grouped(list(KEY), close_members, pa.schema(kinds)), "band int, bucket long, i int, j int, c long"), "near-close")
    compared = close.join(full_sets(close.select("c")), "c").select(*KEY, "c", "shingles").repartition(*KEY).sortWithinPartitions(*KEY)
    links = compared.mapInArrow(grouped(list(KEY), lambda t: exact_links(t, percent), pa.schema([("u", pa.int64()), ("v", pa.int64())])), "u long, v long")
    if stars is not None:
        links = links.unionByName(stars)
    # documents are the nodes; classes stand for their first document
    first = classes.select("c", "first")
    links = links.join(first.select(F.col("c").alias("u"), F.col("first").alias("x")), "u").join(first.select(F.col("c").alias("v"), F.col("first").alias("y")), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    several = rows.where("n > 0").select("id", "a", "b").distinct().groupBy("id").agg(F.count("*").alias("k")).where("k > 1 and id < 9223372036854775807")
    # an id with several texts ties their classes together
    tied = several.join(rows.where("n > 0").select("id", "a", "b").distinct(), "id").join(classes.select("a", "b", "first"), ["a", "b"]).select(F.col("id").alias("u"), F.col("first").alias("v"))
    return links.unionByName(tied)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    null = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
    return grouped_documents(docs, percent, size, id_col, text_col).select(null("id").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that a smaller id of their component stands for. Rows that share an id stay or go together."""
    gone = settled(grouped_documents(docs, percent, size, id_col, text_col).where("id <> component").select("id").distinct(), "near-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    key = F.coalesce(F.col(f"doc.`{id_col}`").cast("long"), F.lit(LAST_ID))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).join(gone, key == F.col("id"), "left_anti").select("doc.*")
