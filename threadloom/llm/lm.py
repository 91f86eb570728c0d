r"""LM scores of whole texts: marginal likelihood over all subword segmentations.

The pieces are those of an existing subword vocabulary, and its scores are their first weights. EM_STEPS rounds of expectation
maximisation over the training documents' distinct words follow, in which the first weights stay as PRIOR pseudo-counts, so
scores of the vocabulary weigh all segmentations throughout and those of rare pieces most. A word, with the vocabulary's
mark for a word's beginning, has a lattice of all its segmentations, and a forward recursion on logarithms sums them, for
many words at once, position by position. Characters that the vocabulary lacks fall back to pieces for their bytes. A text's
log10 probability is the sum over its words and one end.

The lattice of a word that occurs c times in training has one more arc, the word as a whole, of weight (c - d) / N. The discount
d is the usual n1 / (n1 + 2 n2), of how many words occur once and twice; what it takes from all words, d V / N, is the
weight of the segmentations into pieces. So probabilities of all texts add up to at most one: what is missing is the weight of
byte pieces in orders that are no text, and of pieces that hold a mark inside.

Counts of words pass through one shuffle and stay a table. The HOT most frequent words (about; never more) are broadcast
with their counts, and what a text holds beside them is joined with the table, so base scores are exact for every word.

Defined results: null and empty texts hold the end alone. A null id counts as the empty text for the held-out remainder.
Repeated rows are scored one by one, and each counts in training. With no training documents all counts are 0 and the
first weights stay. Very long texts and words are scored whole. Other columns take no part, whatever their names. Empty tables
give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ENTRY, kept, long_texts, settled
from threadloom.llm.token_counts import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
MODULUS, HELD_OUT = 7, 2
EM_STEPS = 2
#: Pseudo-counts that the first weights have together.
PRIOR = 2000.0
HOT = 500_000
#: Distinct words that a task counts before it passes them on, bytes of the words whose probability a worker remembers, and characters of words that are summed at once.
TOGETHER, WORD_BYTES, CHARACTERS = 400_000, 64 << 20, 1 << 17
#: The log of a piece that never occurs.
NEVER = -745.0
MARK, CODE_BITS = "\u2581", 21


class Vocabulary:
    """Pieces, and the tree of their characters as sorted numbers (node << CODE_BITS | character) of its edges."""

    def __init__(self, pieces: list[str], kinds: list[str]):
        self.kinds, self.byte = kinds, np.zeros(256, np.int64)
        edges: dict[int, int] = {}
        ends = [-1]
        for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == "byte":
                self.byte[int(p[3:-1], 16)] = i
            elif kind == "normal":
                node = 0
                for c in p:
                    key = node << CODE_BITS | ord(c)
                    node = edges.setdefault(key, len(ends))
                    if node == len(ends):
                        ends.append(-1)
                ends[node] = i
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)


class Arcs:
    """The lattices of some words: arcs from node to node. A word of n characters has n + 1 nodes in a row."""

    def __init__(self, vocabulary: Vocabulary, logs: np.ndarray, tokens: list[bytes]):
        words = [MARK + t.decode("utf-8", "surrogatepass") for t in tokens]
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array(list(map(len, words)), np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(codes)) - begin[word]
        left = sizes[word] - place
        at, state, length = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        alone = np.zeros(len(codes), bool)
        sources, lengths, pieces = [], [], []
        while len(at):
            key = state << CODE_BITS | codes[at + length]
            k = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
            hit = vocabulary.keys[k] == key
            at, state = at[hit], vocabulary.to[k[hit]]
            length += 1
            piece = vocabulary.ends[state]
            is_piece = piece >= 0
            sources.append(at[is_piece])
            lengths.append(np.full(int(is_piece.sum()), length))
            pieces.append(piece[is_piece])
            if length == 1:
                alone[sources[0]] = True
            more = left[at] > length
            at, state = at[more], state[more]
        rest = np.flatnonzero(~alone)
        sources.append(rest)
        lengths.append(np.ones(len(rest), np.int64))
        pieces.append(np.full(len(rest), -1))
        source, length, self.piece = np.concatenate(sources), np.concatenate(lengths), np.concatenate(pieces)
        #: fallback characters, each with the pieces of its bytes
        self.fallback, self.which = np.unique(codes[rest], return_inverse=True)
        self.bytes_of = [vocabulary.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in self.fallback.tolist()]
        self.log = np.empty(len(source))
        self.log[: len(source) - len(rest)] = logs[self.piece[: len(source) - len(rest)]]
        self.log[len(source) - len(rest) :] = np.array([logs[b].sum() for b in self.bytes_of])[self.which] if len(rest) else 0.0
        self.source = source + word[source]
        self.to = self.source + length
        self.position, self.word = place[source], word[source]
        self.reach = self.position + length
        self.first = begin + np.arange(len(words))
        self.last = self.first + sizes

    def _summed(self, value: np.ndarray, by: np.ndarray, other: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums over arcs, in the order of places `at`: value[by] = log of the sum of exp(value[other] + log)."""
        by, other, log, at = by[order], other[order], self.log[order], at[order]
        heads = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        steps = np.flatnonzero(np.r_[True, at[heads][1:] != at[heads][:-1]])
        for a, b in zip(steps.tolist(), [*steps[1:].tolist(), len(heads)], strict=True):
            lo, hi = heads[a], heads[b] if b < len(heads) else len(by)
            x = value[other[lo:hi]] + log[lo:hi]
            starts = heads[a:b] - lo
            most = np.maximum.reduceat(x, starts)
            value[by[heads[a:b]]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, np.diff(np.r_[starts, hi - lo]))), starts))
        return value

    def forward(self) -> np.ndarray:
        """For each node the log of the summed probability of all ways to it."""
        value = np.full(int(self.last[-1]) + 1, -np.inf)
        value[self.first] = 0.0
        return self._summed(value, self.to, self.source, np.lexsort((self.to, self.reach)), self.reach)

    def backward(self) -> np.ndarray:
        value = np.full(int(self.last[-1]) + 1, -np.inf)
        value[self.last] = 0.0
        return self._summed(value, self.source, self.to, np.lexsort((self.source, -self.position)), self.position)


class Lattice:
    """A vocabulary and the logs of its pieces' probabilities."""

    def __init__(self, vocabulary: Vocabulary, logs: list[float]):
        self.vocabulary, self.logs = vocabulary, np.array(logs)
        self.end = logs[vocabulary.kinds.index("end")]

    def _parts(self, tokens: list[bytes]) -> Iterator[np.ndarray]:
        """Numbers of the words, those of like lengths together."""
        sizes = np.array(list(map(len, tokens)), np.int64)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        part = np.cumsum(sizes[order] + 2) // CHARACTERS
        return iter(np.split(order, np.flatnonzero(np.diff(part)) + 1)) if len(order) else iter(())

    def logs_of(self, tokens: list[bytes]) -> np.ndarray:
        """Logs of the words' marginal probabilities; of an end, the empty word."""
        out = np.full(len(tokens), self.end)
        for some in self._parts(tokens):
            arcs = Arcs(self.vocabulary, self.logs, [tokens[i] for i in some.tolist()])
            out[some] = arcs.forward()[arcs.last]
        return out

    def expected(self, tokens: list[bytes]) -> np.ndarray:
        """How often each piece is expected where every word occurs once."""
        out = np.zeros(len(self.logs))
        for some in self._parts(tokens):
            arcs = Arcs(self.vocabulary, self.logs, [tokens[i] for i in some.tolist()])
            f, b = arcs.forward(), arcs.backward()
            n = np.exp(np.minimum(0.0, f[arcs.source] + arcs.log + b[arcs.to] - f[arcs.last][arcs.word]))
            normal = arcs.piece >= 0
            out += np.bincount(arcs.piece[normal], n[normal], len(out))
            for pieces, x in zip(arcs.bytes_of, np.bincount(arcs.which, n[~normal], len(arcs.bytes_of)).tolist(), strict=True):
                np.add.at(out, pieces, x)
        return out


def first_weights(path: str) -> tuple[list[str], list[str], list[float]]:
    """The vocabulary's pieces, their kinds, and logs of first weights from its scores: a piece of score -r weighs 1 / (r + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, kinds, weights = [], [], []
    for i in range(model.vocab_size()):
        pieces.append(model.id_to_piece(i))
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.get_score(i) < -1e8
        kinds.append("byte" if model.is_byte(i) else "end" if i == model.eos_id() else "none" if special else "normal")
        weights.append(1e-4 if kinds[-1] == "byte" else 0.01 if kinds[-1] == "end" else 0.0 if special else 1 / (10 - model.get_score(i)))
    return pieces, kinds, logs_of(weights)


def logs_of(weights: list[float]) -> list[float]:
    total = math.fsum(weights)
    return [math.log(w / total) if w > 0 else NEVER for w in weights]


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def counted(texts: DataFrame) -> DataFrame:
    """word, c: of texts (a column text). The end of each text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = pa.array(list(found), pa.binary())
            return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "c"])

        found: Counter[bytes] = Counter()
        for b in batches:
            for x in b.column(0):
                found.update(lowered(x.as_py()))
            found[b""] += len(b)
            if len(found) > TOGETHER:
                yield out()
                found.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of so many words that it pays to sum them at once, and no more characters than bound a task's memory."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.get_total_buffer_size()
        if size > 1 << 22:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def expectation(counts: DataFrame, vocabulary: Vocabulary, logs: list[float]) -> np.ndarray:
    """Expected counts of the pieces over all words, each once, as for what has not been seen. At most one row a piece and task is shuffled, one a piece collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, found = Lattice(vocabulary, logs), np.zeros(len(logs))
        for t in together(batches):
            found += lattice.expected([w for w in t.column(0).to_pylist() if w])
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], ["piece", "n"])

    out = np.zeros(len(logs))
    for r in counts.select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


def logs_of_words(counts: DataFrame, vocabulary: Vocabulary, logs: list[float]) -> DataFrame:
    """word, c, p: log probability of each word by its pieces, or of an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary, logs)
        for t in together(batches):
            yield from t.append_column("p", pa.array(lattice.logs_of(t.column(0).to_pylist()))).to_batches()

    return counts.select("word", "c").mapInArrow(run, "word binary, c long, p double")


class Worker:
    """What a worker makes of a broadcast model, once for all its tasks: places of frequent words, their two scores, and a memory of other words' logs."""

    def __init__(self, told: tuple):
        words, self.base, self.likely, self.pieces, *model = told
        self.index, self.lattice = {w: i for i, w in enumerate(words)}, Lattice(*model)
        self.logs: dict[bytes, float] = {}
        self.held = 0

    def learn(self, words: list[bytes]) -> None:
        if self.held > WORD_BYTES:
            self.logs.clear()
            self.held = 0
        new = list({w for w in words if w not in self.logs})
        self.logs.update(zip(new, self.lattice.logs_of(new).tolist(), strict=True))
        self.held += sum(map(len, new)) + 2 * ENTRY * len(new)


def lm_scores(docs: DataFrame, path: str | None = None, hot: int = HOT, steps: int = EM_STEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score: a row for each row of docs.

    lattice_score is the log10 of the text's marginal probability by the lattice of pieces alone; score mixes the whole word in as one more
    arc where training has seen it.
    """
    long_texts(docs.sparkSession)
    rest = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % MODULUS
    taken = docs.select(F.col(id_col).alias("doc_id"), (rest == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    counts = settled(counted(taken.where("not held_out")).where("c > 0"), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(b""), F.col("c"))), F.lit(0)).alias("ends"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()

    pieces, kinds, logs = first_weights(path or tokenizer_path(VOCABULARY))
    vocabulary, first = Vocabulary(pieces, kinds), np.where(np.array(logs) > NEVER, np.exp(logs), 0.0)
    for _ in range(steps if total["v"] else 0):
        logs = logs_of((expectation(counts, vocabulary, logs) + PRIOR * first).tolist())
    discount = min(0.9, max(0.1, total["once"] / max(1, total["once"] + 2 * total["twice"])))
    all_tokens, left = max(1, total["n"]), discount * total["v"] / total["n"] if total["n"] else 1.0

    # the words that occur at least so often that there are no more than `hot` of them, by counts in classes of an eighth of a doubling
    size = F.floor(F.log2("c") * 8)
    classes = sorted(((r["k"], r["n"]) for r in counts.groupBy(size.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = 1 << 60, 0
    for k, n in classes:
        held += n
        if held > hot:
            break
        least = k
    counts = settled(logs_of_words(counts, vocabulary, logs), "lm-words")
    frequent = counts.where(size >= least).toArrow()
    spark = docs.sparkSession
    floor = math.log10(total["n"] + total["v"] + 1)
    c = np.array(frequent.column("c"), np.int64)
    p = np.array(frequent.column("p"), np.float64)
    likely = np.log10((c - discount) / all_tokens + left * np.exp(p))
    told = spark.sparkContext.broadcast((frequent.column("word").to_pylist(), np.log10(c + 1.0) - floor, likely, p / math.log(10), vocabulary, logs))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = kept(("lm", name), lambda: Worker(told.value))
        index, base, likely, pieces = worker.index, worker.base, worker.likely, worker.pieces
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("p", pa.float64())]))]
        for b in batches:
            rows, rare_of = [], []
            new = b.column(1).to_pylist()
            for x in b.column(2):
                tokens = lowered(x.as_py())
                tokens.append(b"")
                at = np.fromiter(map(index.get, tokens, repeat(-1)), np.int64, len(tokens))
                known = at[at >= 0]
                rare_of.append(Counter([tokens[i] for i in np.flatnonzero(at < 0).tolist()]) if len(known) < len(tokens) else {})
                rows.append((len(tokens), len(known), float(base[known].sum()), float(likely[known].sum()), float(pieces[known].sum())))
            # words of training documents are all in the table
            worker.learn([w for rare, held in zip(rare_of, new, strict=True) if held for w in rare])
            rows = [(*row, [{"word": w, "n": k, "p": worker.logs[w] if held else None} for w, k in rare.items()]) for row, rare, held in zip(rows, rare_of, new, strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *(pa.array(v, t) for v, t in zip(cols, kinds, strict=True))], ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "lattice", "rare"])

    kind = taken.schema["doc_id"].dataType.simpleString()
    scored = taken.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, lattice double, rare array<struct<word:binary,n:long,p:double>>")
    scored = settled(scored, "lm-scored")
    told.unpersist()
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n", F.col("r.p").alias("own")).join(counts, "word", "left").withColumn("p", F.coalesce("own", "p"))
    ten = math.log(10)
    whole = F.when(F.col("c").isNull(), math.log10(left) + F.col("p") / ten).otherwise(F.log10((F.col("c") - discount) / all_tokens + left * F.exp("p")))
    sums = rare.groupBy("row").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - floor)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * whole).alias("likely"), F.sum(F.col("n") * F.col("p") / ten).alias("pieces")
    )
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("likely", F.lit(0.0))).alias("score"),
        (F.col("lattice") + F.coalesce("pieces", F.lit(0.0))).alias("lattice_score"),
    )
