r"""Substring dedup: windows of consecutive words that also start earlier are removed, behind a count-min prefilter.

Documents are dealt into chunks of about CHUNK_BYTES by a hash of id and text; how many grows with the input. Then:

1. Each chunk makes a count-min sketch of its windows' hashes: DEPTH rows of counters that stop at 2. It is kept sparse, as the
   counters that are not 0, and in blocks of 2^24 counters; the number of blocks grows with the input, so about WINDOWS_PER_BLOCK
   windows fall into each at any size.
2. The chunks' sketches are merged block by block. Each chunk is told which of its own counters reached 2. A window's
   estimate is the least of its merged counters, one in each row; it is never below the true count, so every repeated window
   is estimated repeated. Of the others, with 16 counters to a window, a row mistakes 6 % and two rows 0.4 %.
3. Each chunk passes on the windows that are estimated repeated: for windows of equal words only the earliest of the chunk, as
   the others are repeated for sure; which are equal is decided by their words. The windows that are passed on are grouped block
   by block, by a cryptographic digest of their words (BLAKE2b, 160 bits), and all but the earliest of each group are marked. A
   window that many documents share costs one entry a chunk.
4. Each chunk removes the words that marked windows cover, in one pass over its texts.

No sketch is broadcast and none passes through the driver; all four steps read one shuffle of the texts, by chunk.

Defined results: null text has no words. A null id comes after all others. Where rows share an id, windows of equal start
are at the same place, and neither comes earlier; so copies of a whole row are treated alike. Texts shorter than a window keep
all words; very long ones take part whole. Empty tables give no rows. Columns of any name stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import Memo, kept, long_texts, words

WINDOW = 20
CHUNK_BYTES = 8 << 20
WINDOWS_PER_BLOCK = 1 << 20
#: About the bytes of a word and its space; only the number of blocks depends on it.
BYTES_PER_WORD = 6
CELL_BITS = 24
#: Rows of the sketch.
DEPTH = 2
#: Bytes of the words whose hashes a worker remembers.
WORD_BYTES = 32 << 20
#: Bytes of a window's digest, and the numbers that hold them; what is left of the last is 0, which compresses to nothing.
DIGEST, NUMBERS = 20, 3
LAST_ID = (1 << 63) - 1
#: Bits of a window's start; those above number the rows of one id.
START_BITS = 40


def hashes(tokens: list[bytes]) -> np.ndarray:
    known = kept(("hashes",), lambda: Memo(lambda w: xxhash.xxh3_64_intdigest(w) - (1 << 63), WORD_BYTES))
    return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)).view(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolled(h: np.ndarray, window: int, base: int) -> np.ndarray:
    """A polynomial hash of every window, from windows of doubled lengths."""
    if len(h) < window:
        return np.zeros(0, np.uint64)
    done, size, out, out_size, offset = h, 1, None, 0, 0
    rest = window
    while rest:
        if rest & 1:
            piece = done[offset:]
            if out is None:
                out, out_size = piece, size
            else:
                n = min(len(out), len(piece))
                out, out_size = out[:n] * np.uint64(pow(base, size, 1 << 64)) + piece[:n], out_size + size
            offset += size
        rest >>= 1
        if rest:
            done, size = done[:-size] * np.uint64(pow(base, size, 1 << 64)) + done[size:], size * 2
    return mixed(out[: len(h) - window + 1])


#: Of the rolling hash, and what tells the sketch's rows apart.
BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Chunk:
    """The windows of a chunk's texts, one text after the other."""

    def __init__(self, table: pa.Table, window: int):
        each = [rolled(hashes(words(x.as_py())), window, BASES[0]) for x in table.column("text")]
        self.counts = np.array([len(x) for x in each], np.int64)
        self.h1 = np.concatenate(each) if each else np.zeros(0, np.uint64)


def cells(h1: np.ndarray, blocks: int, row: int = 0) -> np.ndarray:
    """A window's counter in a row of the sketch, with its block in the bits above."""
    h = mixed(h1 + np.uint64(row * BASES[1] & (1 << 64) - 1)) if row else h1
    block = (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)) + np.uint64(row * blocks)
    return (block << np.uint64(CELL_BITS)) | (h & np.uint64((1 << CELL_BITS) - 1))


def packed(cell: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted counters of a block: the low two bytes of each, and the high bytes, which compress well."""
    cell = cell.astype(np.uint32)
    return cell.astype(np.uint16).tobytes(), (cell >> np.uint32(16)).astype(np.uint8).tobytes()


def unpacked(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(high, np.uint8).astype(np.uint32) << np.uint32(16) | np.frombuffer(low, np.uint16)


SKETCH = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType())])
#: Windows of one chunk and block, or marks of one chunk (block below 0), as arrays one after the other.
PLACES = T.StructType([T.StructField("block", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])


def _rows(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, kinds[f.dataType]) for c, f in zip(cols, schema.fields, strict=True)], names=schema.names)


def _by_block(sorted_cells: np.ndarray, chunk: int) -> pa.Table:
    block = (sorted_cells >> np.uint64(CELL_BITS)).astype(np.int64)
    ends = np.flatnonzero(np.diff(block)) + 1
    rows = [(int(b), chunk, *packed(part & np.uint64((1 << CELL_BITS) - 1))) for b, part in zip(block[np.r_[0, ends]], np.split(sorted_cells, ends), strict=True)] if len(block) else []
    return _rows(rows, SKETCH)


def sketch(key: tuple, table: pa.Table, window: int, blocks: int) -> pa.Table:
    """Step 1: a chunk's counters, each once if it is 1 and twice if it is more."""
    h1 = Chunk(table, window).h1
    c = np.sort(np.concatenate([cells(h1, blocks, r) for r in range(DEPTH)]))
    if len(c) > 2:
        c = c[np.r_[True, True, c[2:] != c[:-2]]]
    return _by_block(c, key[0].as_py())


def merge(key: tuple, table: pa.Table) -> pa.Table:
    """Step 2: for each chunk, those of its counters in this block that add up to 2 or more."""
    each = [unpacked(low.as_py(), high.as_py()) for low, high in zip(table.column("low"), table.column("high"), strict=True)]
    every = np.sort(np.concatenate(each))
    reached = np.zeros(1 << CELL_BITS, bool)
    reached[every[1:][every[1:] == every[:-1]]] = True
    rows = []
    for chunk, own in zip(table.column("chunk"), each, strict=True):
        own = own[reached[own]]
        if len(own):
            rows.append((key[0].as_py(), chunk.as_py(), *packed(np.unique(own))))
    return _rows(rows, SKETCH)


def planes(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte numbers, byte by byte: all lowest bytes first. High bytes are mostly 0 and so compress to nothing."""
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays)


def from_planes(data: bytes, n: int, count: int) -> list[np.ndarray]:
    each = np.frombuffer(data, np.uint8).reshape(count, 8, n)
    return [np.ascontiguousarray(x.T).reshape(-1).view(np.int64) for x in each]


def numbered(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each row its id and its number, which is 0 but where texts of one chunk share an id; equal rows share both."""
    ids, tags = np.array(docs.column("id"), np.int64), np.array(docs.column("tag"), np.int64)
    order = np.lexsort((tags, ids))
    i, t = ids[order], tags[order]
    fresh = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    step = np.cumsum(np.r_[True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])]) if len(i) else np.zeros(0, np.int64)
    nth = np.empty(len(i), np.int64)
    nth[order] = step - np.maximum.accumulate(np.where(fresh, step, 0))
    return ids, nth


def places(key: tuple, docs: pa.Table, replies: pa.Table, window: int, blocks: int) -> pa.Table:
    """Step 3: windows to group exactly, block by block, and runs of windows that are repeated for sure."""
    chunk = key[0].as_py()
    if not len(docs) or not len(replies):
        return _rows([], PLACES)
    told = np.sort(np.concatenate([np.uint64(b.as_py() << CELL_BITS) | unpacked(low.as_py(), high.as_py()).astype(np.uint64) for b, low, high in zip(replies.column("block"), replies.column("low"), replies.column("high"), strict=True)]))
    c = Chunk(docs, window)
    cell = cells(c.h1, blocks)
    # a table of bits first: most windows end there
    bits = np.zeros(1 << 24, bool)
    bits[(mixed(told) >> np.uint64(40)).astype(np.int64)] = True
    at = np.flatnonzero(bits[(mixed(cell) >> np.uint64(40)).astype(np.int64)])
    for r in range(DEPTH):
        cell = cells(c.h1[at], blocks, r)
        at = at[told[np.minimum(np.searchsorted(told, cell), len(told) - 1)] == cell]
    if not len(at):
        return _rows([], PLACES)
    row = np.repeat(np.arange(len(c.counts)), c.counts)[at]
    start = at - (np.cumsum(c.counts) - c.counts)[row]
    ids, nth = (x[row] for x in numbered(docs))
    h1 = c.h1[at]
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    offset, spelled, index = np.zeros(len(c.counts), np.int64), [], {}
    size = 0
    for r in row[begins].tolist():
        tokens = words(docs.column("text")[r].as_py())
        spelled.append(np.fromiter((index.setdefault(w, len(index)) for w in tokens), np.int32, len(tokens)))
        offset[r], size = size, size + len(tokens)
    order, head = alike(h1, ids, start, np.concatenate(spelled), offset[row] + start, window)
    h1, ids, start, nth, row = h1[order], ids[order], start[order], nth[order], row[order]
    later = (ids != ids[head]) | (start != start[head])
    ahead = ~later
    said = digests(docs, row[ahead], start[ahead], window)
    start = start | (nth << START_BITS)
    block = (cells(h1[ahead], blocks) >> np.uint64(CELL_BITS)).astype(np.int64)  # ascends, as h1 does
    ends = np.flatnonzero(np.diff(block)) + 1
    parts = [np.split(x, ends) for x in (*np.ascontiguousarray(said.T), ids[ahead], start[ahead])]
    rows = [(int(b), chunk, len(p[0]), planes(*p)) for b, *p in zip(block[np.r_[0, ends]], *parts, strict=True)]
    if later.any():
        sure = np.lexsort((start[later], row[later]))
        s_row, s_start, s_id = (x[later][sure] for x in (row, start, ids))
        begins = np.r_[0, np.flatnonzero((np.diff(s_row) != 0) | (np.diff(s_start) != 1)) + 1]
        rows.append((-1 - chunk, chunk, len(begins), planes(s_id[begins], s_start[begins], np.diff(np.r_[begins, len(sure)]))))
    return _rows(rows, PLACES)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Of rows sorted by keys: where the first of equal ones stands."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def digests(docs: pa.Table, row: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """The digests of windows' words, as rows of numbers, one text after the other."""
    size = 8 * NUMBERS
    out, order = bytearray(size * len(row)), np.argsort(row, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0]) if len(row) else []
    for a, b in zip(begins, [*begins[1:], len(row)], strict=True):
        tokens = words(docs.column("text")[int(row[order[a]])].as_py())
        for k, s in zip(order[a:b].tolist(), start[order[a:b]].tolist(), strict=True):
            out[k * size : k * size + DIGEST] = hashlib.blake2b(b" ".join(tokens[s : s + window]), digest_size=DIGEST).digest()
    return np.frombuffer(bytes(out), np.int64).reshape(-1, NUMBERS)


def alike(h1: np.ndarray, ids: np.ndarray, start: np.ndarray, spelled: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows in which those of equal words stand together, the earliest first, and for each place in it the first of its group.

    spelled: numbers of words, each word one; at: where in it a window begins. What shares a hash but not its words with the first goes on apart.
    """
    apart = np.zeros(len(h1), np.int64)
    while True:
        order = np.lexsort((start, ids, apart, h1))
        head = heads(h1[order], apart[order])
        own, first, same = at[order], at[order][head], np.ones(len(order), bool)
        for k in range(window):
            same &= spelled[own + k] == spelled[first + k]
        if same.all():
            return order, head
        apart[order[~same]] += 1


def resolve(key: tuple, table: pa.Table) -> pa.Table:
    """Step 3, for a block: marks for all windows but the earliest of each group. Marks pass through."""
    if key[0].as_py() < 0:
        return table.select(PLACES.names)
    chunks, sizes = (np.array(table.column(x), np.int64) for x in ("chunk", "n"))
    each = [from_planes(d.as_py(), int(n), NUMBERS + 2) for d, n in zip(table.column("data"), sizes, strict=True)]
    *said, ids, start = (np.concatenate(x) for x in zip(*each, strict=True))
    chunk = np.repeat(chunks, sizes)
    begin = start & ((1 << START_BITS) - 1)
    order = np.lexsort((begin, ids, *said))
    first = order[heads(*(x[order] for x in said))]
    late = order[(ids[order] != ids[first]) | (begin[order] != begin[first])]
    late = late[np.argsort(chunk[late], kind="stable")]
    ends = np.flatnonzero(np.diff(chunk[late])) + 1
    rows = [(-1, int(chunk[k[0]]), len(k), planes(ids[k], start[k], np.ones(len(k), np.int64))) for k in np.split(late, ends) if len(k)]
    return _rows(rows, PLACES)


def covered(n_words: int, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Which words marked runs of windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + lengths - 1 + window, n_words), -1)
    return np.cumsum(edges)[:-1] > 0


def kept_words(docs: pa.Table, marks: pa.Table, window: int):
    """Step 4: for each row of docs, its words and which of them are removed (None: none)."""
    by = {}
    if len(marks):
        each = [from_planes(d.as_py(), n.as_py(), 3) for d, n in zip(marks.column("data"), marks.column("n"), strict=True)]
        ids, at, n = (np.concatenate(x) for x in zip(*each, strict=True))
        order = np.lexsort((at, ids))
        ids, nth, at, n = ids[order], at[order] >> START_BITS, at[order] & ((1 << START_BITS) - 1), n[order]
        ends = np.flatnonzero((np.diff(ids) != 0) | (np.diff(nth) != 0)) + 1
        for a, b in zip(np.r_[0, ends], np.r_[ends, len(ids)], strict=True):
            by[int(ids[a]), int(nth[a])] = a, b
    for x, i, k in zip(docs.column("text"), *(z.tolist() for z in numbered(docs)), strict=True):
        tokens = words(x.as_py())
        span = by.get((i, k))
        yield x.as_py(), tokens, None if span is None else covered(len(tokens), at[span[0] : span[1]], n[span[0] : span[1]], window)


def _joined(tokens: list[bytes], gone: np.ndarray | None) -> bytes:
    return b" ".join(tokens if gone is None else [tokens[i] for i in np.flatnonzero(~gone)])


def marked(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs by chunk, and the marks of each chunk."""
    long_texts(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    blocks = max(1, -(-size // (BYTES_PER_WORD * WINDOWS_PER_BLOCK)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    dealt = docs.select(
        F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).alias("chunk"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.pmod(F.xxhash64(F.lit(1), text), F.lit(1 << 40)).alias("tag"), text.alias("text"), F.struct(F.col(text_col).isNull().alias("null"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col)).alias("doc"),
    )
    sketches = dealt.groupBy("chunk").applyInArrow(lambda k, t: sketch(k, t, window, blocks), SKETCH)
    replies = sketches.groupBy("block").applyInArrow(merge, SKETCH)
    found = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda k, a, b: places(k, a, b, window, blocks), PLACES)
    marks = found.groupBy("block").applyInArrow(resolve, PLACES).drop("block")
    return dealt, marks


def repeated_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each row of docs."""
    dealt, marks = marked(docs, window, id_col, text_col)
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    place = f"c{docs.columns.index(id_col)}"

    def digest(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        found = [(len(tokens), 0 if gone is None else int(gone.sum()), hashlib.sha256(_joined(tokens, gone)).hexdigest()) for _, tokens, gone in kept_words(rows, told, window)]
        cols = list(zip(*found, strict=True)) or [()] * 3
        ids = rows.column("doc").combine_chunks().field(place)
        return pa.table([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=out.names)

    return dealt.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(digest, out)


def remove_repeated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs without the covered words. A text that loses none stays as it is; the others' kept words are joined by one space, and a length column follows."""
    dealt, marks = marked(docs, window, id_col, text_col)
    names = docs.columns

    def rewrite(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        texts = [x if gone is None else _joined(tokens, gone).decode("utf-8", "surrogatepass") for x, tokens, gone in kept_words(rows, told, window)]
        doc = rows.column("doc").combine_chunks()
        null = doc.field("null")
        cols = []
        for k, name in enumerate(names):
            if name == text_col:
                cols.append(pa.array([None if n.as_py() else t for t, n in zip(texts, null, strict=True)], pa.string()))
            elif name == length_col:
                cols.append(pa.array([len(t) for t in texts], doc.field(f"c{k}").type))
            else:
                cols.append(doc.field(f"c{k}"))
        return pa.table(cols, names=names)

    return dealt.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(rewrite, docs.schema)
