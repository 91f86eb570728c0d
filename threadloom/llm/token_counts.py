r"""Exact token counts of every prefix of a text, by dynamic programming.

A sequence of BPE tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs. So the
encoding of a prefix of a pre-token is the encoding of a shorter prefix and one token more, and one pass over the bytes
stores, for every prefix, its number of tokens and its last token (linear in the length, also for a pre-token of a
hundred thousand letters). These tables of pre-tokens are kept, and a text's total is the sum of their last entries. With the
sums at pre-token boundaries they answer how many tokens any prefix has and how long the longest prefix within a budget is,
without encoding again: where a cut moves boundaries (white space before a word, a cut "'re"), the last two pre-tokens before
it are split anew, and the tables of the new pieces answer.

Defined results: null text counts as empty, with no bytes and no tokens. Strings of added tokens inside a text count as
one token each, which is the library's default. Repeated rows are counted one by one. Very long texts are counted whole.
Other columns take no part, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Memo, kept, long_texts

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of the pre-tokens' tables that a worker remembers, and of what it knows of pairs of tokens.
TABLE_BYTES, PAIR_BYTES = 192 << 20, 48 << 20
#: Pairs of ids are kept as one number.
SHIFT, MASK, NEVER = 20, (1 << 20) - 1, 1 << 40
#: Where a node of the trie keeps the token that ends there; the other keys are bytes.
TOKEN = -1
LAST = itemgetter(-1)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts by the ranks of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, pattern: str, limit: int = TABLE_BYTES):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters = byte_letters()
        as_bytes = lambda x: bytes(letters[c] for c in x)
        self.id_of = {as_bytes(x): i for i, x in enumerate(said["model"]["vocab"])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        self.rank = {}
        parents: dict[int, tuple[int, int, int]] = {}
        for rank, (x, y) in enumerate(merges):
            left, right = self.id_of[as_bytes(x)], self.id_of[as_bytes(y)]
            self.rank[left << SHIFT | right] = rank
            parents.setdefault(self.id_of[as_bytes(x + y)], (left, right, rank))
        self.trie = {}
        for token, i in self.id_of.items():
            node = self.trie
            for byte in token:
                node = node.setdefault(byte, {})
            node[TOKEN] = i
        self.right_edge = {t: self._edge(parents, t, 1) for t in self.id_of.values()}
        self.left_edge = {t: self._edge(parents, t, 0) for t in self.id_of.values()}
        self.alone = {t for t in self.id_of.values() if t not in parents or self._apart(parents[t][0], parents[t][1], parents[t][2])}
        self.pattern = regex.compile(pattern)
        added = sorted((x["content"] for x in said["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.valid = Memo(lambda pair: self._apart(pair >> SHIFT, pair & MASK), PAIR_BYTES)
        self.tables = Memo(lambda piece: self.prefixes(piece.encode()), limit)

    @staticmethod
    def _edge(parents: dict[int, tuple[int, int, int]], token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of a token while it is being merged, each with the rank of the merge that takes it."""
        out = [(token, NEVER)]
        while token in parents:
            rank = parents[token][2]
            token = parents[token][side]
            out.append((token, rank))
        return out

    def _apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge of a rank below `before` joins a's end with b's beginning.

        A pair's rank is above those of both its tokens, so merges happen in the order of ranks. Two tokens at the border are
        merged if their pair comes before the merge that takes either; of equal ranks the left comes first.
        """
        get = self.rank.get
        for x, taken in self.right_edge[a]:
            for y, gone in self.left_edge[b]:
                rank = get(x << SHIFT | y, NEVER)
                if rank < taken and rank <= gone and rank < before:
                    return False
        return True

    def prefixes(self, piece: bytes) -> array:
        """counts[i]: the tokens of the encoding of piece[:i].

        From each prefix, every token that begins there is tried as the next; exactly one way into each prefix is valid.
        """
        n = len(piece)
        counts, last = [0] * (n + 1), [0] * (n + 1)
        trie, valid, alone = self.trie, self.valid, self.alone
        for k in range(n):
            more, before, node = counts[k] + 1, last[k] << SHIFT, trie
            for j in range(k, n):
                node = node.get(piece[j])
                if node is None:
                    break
                if TOKEN in node and not counts[j + 1]:
                    token = node[TOKEN]
                    if valid[before | token] if k else token in alone:
                        counts[j + 1] = more
                        last[j + 1] = token
        return array("I", counts)

    def totals(self, pieces: list[str]) -> list[int]:
        """The last entry of each pre-token's table."""
        return list(map(LAST, map(self.tables.__getitem__, pieces)))

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text, and whether each is an added token."""
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def total(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix table, from the last entries of its pre-tokens' tables."""
        return sum(1 if special else sum(self.totals(self.pattern.findall(part))) for part, special in self.segments(text))

    def table(self, text: str) -> PrefixTable:
        ends, counts, pieces, b, n = [0], [0], [b""], 0, 0
        for part, special in self.segments(text):
            for piece in [part] if special else self.pattern.findall(part):
                raw = piece.encode()
                b, n = b + len(raw), n + (1 if special else self.tables[piece][-1])
                ends.append(b)
                counts.append(n)
                pieces.append(None if special else raw)
        return PrefixTable(self, ends, counts, pieces)

    def total_and_cut(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the whole text, and bytes of its longest prefix within the budget: total() and table().longest() in one."""
        if self.added and self.added.search(text):
            n = self.total(text)
            return n, self.table(text).longest(budget) if n > budget else len(text.encode())
        found = self.pattern.findall(text)
        counts = self.totals(found)
        n = sum(counts)
        if n <= budget:
            return n, len(text.encode())
        # only the few pre-tokens about the budget's end are looked into
        k = next(i for i, total in enumerate(accumulate(counts)) if total > budget)
        start = max(0, k - 3)
        before, ends, at = sum(counts[:start]), [len("".join(found[:start]).encode())], [0]
        for piece, c in zip(found[start : k + 2], counts[start : k + 2], strict=True):
            ends.append(ends[-1] + len(piece.encode()))
            at.append(at[-1] + c)
        return n, PrefixTable(self, ends, at, [b"", *(x.encode() for x in found[start : k + 2])]).longest(budget - before)


    def every(self, text: str) -> array:
        """counts[i]: the tokens of the text's first i bytes, as its own pre-tokens split them."""
        out, n = array("I", [0]), 0
        for part, special in self.segments(text):
            if special:
                out.extend([n] * (len(part.encode()) - 1) + [n + 1])
                n += 1
                continue
            for t in map(self.tables.__getitem__, self.pattern.findall(part)):
                out.extend(n + x for x in t[1:])
                n += t[-1]
        return out


class PrefixTable:
    """Counts at pre-token boundaries; what is beyond them comes from the pre-tokens' own tables.

    A prefix can end so that its last pre-tokens differ from the text's (white space before a word, a cut "'re"). So the
    last two boundaries before its end are not trusted: from the third on, the few bytes left are pre-tokenised anew.
    """

    def __init__(self, counter: PrefixCounter, ends: list[int], counts: list[int], pieces: list[bytes | None]):
        self.counter, self.ends, self.counts, self.pieces = counter, ends, counts, pieces

    def tokens(self, n_bytes: int) -> int:
        """Tokens of the text's first n_bytes bytes. Within a character: as if the pre-token's bytes ended there."""
        k = bisect_right(self.ends, n_bytes) - 1
        if k + 1 == len(self.ends):
            return self.counts[k]
        if self.pieces[k] is None and n_bytes == self.ends[k] or self.pieces[k + 1] is None and n_bytes > self.ends[k]:
            return self.counts[k]
        start = k
        while start > max(0, k - 2) and self.pieces[start] is not None:
            start -= 1
        rest = self.pieces[k + 1][: n_bytes - self.ends[k]] if n_bytes > self.ends[k] else b""
        tail = b"".join(self.pieces[start + 1 : k + 1]) + rest
        try:
            found = self.counter.pattern.findall(tail.decode())
        except UnicodeDecodeError:
            return self.counts[k] + self.counter.tables[self.pieces[k + 1].decode()][len(rest)]
        return self.counts[start] + sum(self.counter.totals(found))

    def longest(self, budget: int) -> int:
        """Bytes of the longest prefix of whole characters, ending in the first pre-token that goes over the budget, with at most `budget` tokens."""
        k = bisect_right(self.counts, budget) - 1
        if k + 1 == len(self.ends) or self.pieces[k + 1] is None:
            return self.ends[k]
        piece = self.pieces[k + 1]
        inner = self.counter.tables[piece.decode()]
        for i in range(len(piece) - 1, 0, -1):
            if piece[i] & 0xC0 != 0x80 and self.counts[k] + inner[i] <= budget and self.tokens(self.ends[k] + i) <= budget:
                return self.ends[k] + i
        return self.ends[k]


def counter(path: str, pattern: str) -> PrefixCounter:
    """One for each Python worker."""
    return kept(("counts", path, pattern), lambda: PrefixCounter(path, pattern))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_bytes (the longest prefix within the limit): a row for each row of docs. No shuffle."""
    path, pattern = path or tokenizer_path(VOCABULARY), pattern or default_pattern()
    long_texts(docs.sparkSession)
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for b in batches:
            n_bytes, n_tokens, cut = [], [], []
            for x in b.column(1):
                text = x.as_py() or ""
                n, end = c.total_and_cut(text, limit)
                n_bytes.append(len(text.encode()))
                n_tokens.append(n)
                cut.append(end)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(np.array(n_tokens, np.int64) > limit), pa.array(cut, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"])

    kind = taken.schema["doc_id"].dataType.simpleString()
    return taken.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long")


def token_prefixes(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """doc_id, ends, counts: bytes and tokens before every pre-token boundary of each text; if `every` is set also prefixes, the tokens before each byte and before the end."""
    path, pattern = path or tokenizer_path(VOCABULARY), pattern or default_pattern()
    long_texts(docs.sparkSession)
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            tables = [c.table(x) for x in texts]
            cols = [b.column(0), pa.array([t.ends for t in tables], longs), pa.array([t.counts for t in tables], longs)]
            names = ["doc_id", "ends", "counts"]
            if every:
                cols.append(pa.array([c.every(x).tolist() for x in texts], longs))
                names.append("prefixes")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = taken.schema["doc_id"].dataType.simpleString()
    return taken.mapInArrow(run, f"doc_id {kind}, ends array<long>, counts array<long>{', prefixes array<long>' if every else ''}")
