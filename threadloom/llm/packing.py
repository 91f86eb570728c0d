r"""Packing documents into sequences by cost.

A document's cost is estimated as `linear * tokens + quadratic * tokens^2`, the work of its layers and of its attention.
Documents are taken in descending length and each goes to the sequence of the lowest cost so far that has room for it;
a sequence is opened only where none has. Documents longer than a sequence are cut into whole sequences and a rest.

Every text is tokenised once, where it lies, and only a row of numbers per piece is shuffled. Pieces are dealt into groups
of about GROUP pieces by a hash, and each group is packed on its own: the groups are so large that what the last sequence
of each is padded with does not matter, and so small that a task holds one easily. Their number grows with the input.

Defined results: null text counts as empty, and such a document is its end id alone. Equal lengths are taken in the order
of doc_id (null last), start, CRC. Repeated rows are packed one by one. doc_ids keep their type, and null ones stay null. A
very long text is tokenised whole and gives a piece for each `capacity` ids. Other columns take no part, whatever their names.
Empty tables give no pieces.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import ENTRY, kept, long_texts, parts, settled, words
from threadloom.llm.token_counts import tokenizer_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END = 4096, 2
#: Attention costs as much as the layers' linear work at this length.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
GROUP = 1 << 15
#: Bytes of the words that a worker remembers, and of pre-tokens for those that it doesn't.
WORD_BYTES, PART_BYTES = 144 << 20, 32 << 20


class WordTokens:
    """Ids of a text as little-endian bytes, word by word.

    The vocabulary's normaliser drops white space and no pre-token or added token spans it, so a text's ids are those of its
    words one after the other. Words that the worker has not seen lately are split as the vocabulary's pattern splits them, and
    pre-tokens that are new are encoded together; words and pre-tokens are remembered, and forgotten when they take too many bytes.
    """

    def __init__(self, path: str, limit: int = WORD_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.parts, self.limit = Tokenizer.from_file(path), {}, {}, limit
        self.known_bytes = self.part_bytes = 0
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.split = regex.compile(said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        suffix = said["model"]["end_of_word_suffix"]
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.ends[[i for t, i in said["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.added = "".join({x["content"][0] for x in said["added_tokens"]})
        # the same model for pre-tokens that are normalised and split already
        bare = said | {"normalizer": None, "added_tokens": [], "post_processor": None}
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *said["pre_tokenizer"]["pretokenizers"][1:]]}
        self.bare = Tokenizer.from_str(json.dumps(bare))

    def _encode(self, text: str, bare: bool = False) -> np.ndarray:
        return np.array((self.bare if bare else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, tokens: list[bytes]) -> None:
        if self.known_bytes > self.limit:
            self.known.clear()
            self.known_bytes = 0
        if self.part_bytes > PART_BYTES:
            self.parts.clear()
            self.part_bytes = 0
        new = list({t for t in tokens if t not in self.known})
        split = {}
        for t in new:
            word = t.decode()
            if word.isascii() and word.isalpha():
                split[t] = (word.lower(),)
            # of letters below U+0100, normalising leaves all but capitals as they are
            elif max(word) < "\u0100" and not any(map(word.__contains__, self.added)):
                split[t] = self.split(word.lower())
            else:
                self.known[t] = self._encode(word).tobytes()
        unseen = list({p for ps in split.values() for p in ps if p not in self.parts})
        if unseen:
            # one call for many pre-tokens; the last id of each says so
            ids = self._encode(" ".join(unseen), True)
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) == len(unseen):
                self.parts.update((p, raw[a:b]) for p, a, b in zip(unseen, [0, *cuts], cuts, strict=False))
            else:
                self.parts.update((p, self._encode(p).tobytes()) for p in unseen)
            self.part_bytes += sum(map(len, unseen)) + 4 * len(ids) + 2 * ENTRY * len(unseen)
        get = self.parts.__getitem__
        self.known.update((t, b"".join(map(get, ps))) for t, ps in split.items())
        self.known_bytes += sum(len(t) + len(self.known[t]) for t in new) + 2 * ENTRY * len(new)

    def ids(self, text: str | None) -> bytes:
        tokens = words(text)
        try:
            return b"".join(map(self.known.__getitem__, tokens))
        except KeyError:
            self.learn(tokens)
            return b"".join(map(self.known.__getitem__, tokens))


def word_tokens(path: str) -> WordTokens:
    return kept(("words", path), lambda: WordTokens(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document, cut after every `capacity` ids."""
    long_texts(docs.sparkSession)
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    last = np.array([end], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_tokens(path)
        for b in batches:
            rows = []
            for k, x in enumerate(b.column(1)):
                ids = memoryview(t.ids(x.as_py()) + last)
                n = len(ids) // 4
                rows += [(k, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    kind = taken.schema["doc_id"].dataType.simpleString()
    return taken.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[int], list[int]]:
    """The sequence and offset of each length; lengths descend.

    As many sequences as the tokens need are open from the start. One without room for the length at hand waits until
    lengths have come down to its room, so each length costs a logarithm of the number of sequences.
    """
    n = -(-sum(lengths) // capacity)
    used = [0] * n
    cost = [(0.0, k) for k in range(n)]
    waiting: list[tuple[int, int, float]] = []
    where, offset = [], []
    for length in lengths:
        while waiting and -waiting[0][0] >= length:
            _, k, c = heapq.heappop(waiting)
            heapq.heappush(cost, (c, k))
        while cost and capacity - used[cost[0][1]] < length:
            c, k = heapq.heappop(cost)
            if used[k] < capacity:
                heapq.heappush(waiting, (used[k] - capacity, k, c))
        if cost:
            c, k = heapq.heappop(cost)
        else:
            c, k = 0.0, len(used)
            used.append(0)
        where.append(k)
        offset.append(used[k])
        used[k] += length
        heapq.heappush(cost, (c + linear * length + quadratic * length * length, k))
    return where, offset


def cost_balanced_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    cut = settled(pieces(docs, path or tokenizer_path(VOCABULARY), capacity, end, id_col, text_col), "packing-pieces")
    # a row's place in the table takes part in the hash, or the copies of one row would all fall into one group
    dealt = cut.withColumn("part", F.pmod(F.xxhash64(*cut.columns, F.monotonically_increasing_id()), F.lit(parts(cut, group))))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")], null_placement="at_end")
        table = table.take(order)
        where, offset = assign(table.column("length").to_pylist(), capacity)
        sequence = (key[0].as_py() << 32) + np.array(where, np.int64)
        return table.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset, pa.int64()))

    out = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("part").applyInArrow(pack, out)
