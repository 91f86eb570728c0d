r"""Byte-level BPE encoding and decoding, with texts pre-tokenised in overlapping chunks.

A text is cut into chunks of CHUNK characters that overlap, and each chunk is pre-tokenised by itself; the parallel unit is the
task, which scans the chunks of its texts one after the other, as threads inside a worker wait for the interpreter's lock
(830 CPU seconds a GB with two, 195 in a plain loop). Pre-tokenising is a scan whose only state is its position, so from
the first boundary that two neighbouring chunks share they agree. A chunk's scan is trusted from that boundary to the
next stitch; its last pre-tokens, which may have ended only because the chunk did, are never used. Where an overlap holds no
common boundary, as in one word that is longer than it, the scan goes on over the text itself until it meets one.
Each pre-token is then encoded by the ranks of its bytes, and decoding concatenates the bytes of the ids.

Defined results: null text counts as empty: no ids, and the digests of nothing. A very long text has more chunks and nothing
else. Repeated rows are encoded one by one. Other columns take no part, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Memo, kept, long_texts
from threadloom.llm.token_counts import default_pattern, tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 1 << 11, 1 << 6
#: Bytes of the pre-tokens that a worker remembers.
PIECE_BYTES = 64 << 20
#: Characters before a chunk's end that its last trusted pre-token must leave, for what the pattern looks ahead at.
MARGIN = 2


def scan(pattern: regex.Pattern, text: str, start: int, end: int) -> tuple[list[int], list[str]]:
    """The boundaries and pre-tokens of text[start:end] by itself. The pattern must match every character, as byte-level patterns do."""
    found = pattern.findall(text[start:end])
    return list(accumulate(map(len, found), initial=start)), found


def stitched(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The whole text's pre-tokens, from scans of its chunks."""
    starts = range(0, max(1, len(text) - overlap), chunk)
    spans = [(s, min(len(text), s + chunk + overlap)) for s in starts]
    scans = (scan(pattern, text, *s) for s in spans)
    at, out = next(iter(scans)) if len(spans) == 1 else (None, None)
    for k, (here, found) in enumerate(scans if out is None else ()):
        if not k:
            at, out = here, found
            continue
        (_, trusted), (start, end) = spans[k - 1], spans[k]
        # what is there is right up to the end of its own chunk, but for what touches that end
        while len(at) > 1 and at[-1] > trusted - MARGIN and trusted < len(text):
            at.pop()
            out.pop()
        i = bisect_right(at, start)
        j = bisect_right(here, start)
        while i < len(at) and j < len(here) and at[i] != here[j]:
            if at[i] < here[j]:
                i += 1
            else:
                j += 1
        if i == len(at) or j == len(here):  # the overlap has no common boundary: go on by single matches
            i = len(at) - 1
            while at[i] < len(text):
                j = bisect_left(here, at[i])
                if at[i] > start and j < len(here) and here[j] == at[i]:
                    break
                m = pattern.match(text, at[i])
                at.append(m.end())
                out.append(m[0])
                i += 1
            else:
                continue
        if here[j] < end or end == len(text):
            del at[i:], out[i:]
            at += here[j:]
            out += found[j:]
    return out


class ByteBpe:
    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.chunk, self.overlap = regex.compile(pattern), chunk, overlap
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.name_of = {i: str(i) for i in ranks.values()}
        # all of what it is given is one match
        self.piece = Memo(tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary, PIECE_BYTES)

    def pre_tokens(self, text: str) -> list[str]:
        return stitched(self.pattern, text, self.chunk, self.overlap)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece.__getitem__, self.pre_tokens(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def byte_bpe(path: str, pattern: str, chunk: int, overlap: int) -> ByteBpe:
    return kept(("bytes", path, pattern, chunk, overlap), lambda: ByteBpe(path, pattern, chunk, overlap))


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids: the ids of every whole text."""
    path, pattern = path or tokenizer_path(VOCABULARY), pattern or default_pattern()
    long_texts(docs.sparkSession)
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern, chunk, overlap)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(x.as_py() or "") for x in b.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return taken.mapInArrow(run, f"doc_id {taken.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes: of doc_id, ids. Bytes, as ids need not end with a character."""
    path, pattern = path or tokenizer_path(VOCABULARY), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern, CHUNK, OVERLAP)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], ["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, so ids of a whole corpus need not be kept."""
    path, pattern = path or tokenizer_path(VOCABULARY), pattern or default_pattern()
    long_texts(docs.sparkSession)
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern, chunk, overlap)
        for b in batches:
            n, said, back = [], [], []
            for x in b.column(1):
                ids = bpe.encode(x.as_py() or "")
                n.append(len(ids))
                said.append(hashlib.sha256(",".join(map(bpe.name_of.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return taken.mapInArrow(run, f"doc_id {taken.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
