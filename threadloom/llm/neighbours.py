r"""Quality by nearest-neighbour voting: labelled texts as latent-semantic vectors, exact cosines with every document, votes by similarity.

1. A text's terms are its words in lower case, the shapes of its words (runs of capitals, small letters and digits, other characters
   as they are) and a few facts in classes (number and length of words, shares of different words, of the commonest one, of words that
   follow themselves and of repeated lines), hashed
   to fixed numbers of slots. Document frequencies are counted over all documents. Each of the three blocks is weighted
   by inverse document frequency and normalised.
2. LABELLED texts of each label at most, drawn by a hash of their ids, are fitted: block power iterations over a table of
   their terms give the DIMENSIONS leading right singular vectors. Only the sums of a few partitions, of a fixed size, reach the driver.
3. The labelled vectors are broadcast, 2 * LABELLED * DIMENSIONS numbers at most. Each block of documents is multiplied with all of
   them; the K most similar, and all that equal the last of these, vote by their similarity, and by how many labelled
   documents each stands for, as a label that is cut to the bound must not lose weight.

One pass over all texts counts, one scores; nothing but the frequencies is shuffled. Language, source and ids are never inputs.

Defined results: a null or empty text, and one that resembles no labelled one, has the share of label 1 among labelled documents,
0.5 without any. With one label only, all scores are that label. Of several labels of a document the greatest counts; a null
one is none. Of a labelled document's repeated rows the least text counts; repeated rows are scored alike. A labelled document of the
training folds is its own neighbour. A null id is in a training fold and has no label. Very long texts have more terms and nothing
else. Other columns take no part, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import Memo, kept, long_texts, settled, words

#: Labelled documents of each label that are fitted at most.
LABELLED = 4096
DIMENSIONS, EXTRA, ROUNDS = 64, 8, 4
#: Tasks that fit, each of which sends the driver one block of numbers.
PARTS = 4
K = 24
#: Slots of words, shapes and facts, and the weight of each block.
SLOTS, WEIGHTS = (1 << 14, 1 << 11, 96), (1.0, 1.0, 1.0)
ALL = sum(SLOTS)
#: Bytes of the words by kind of character whose shapes a worker remembers.
SHAPE_BYTES = 16 << 20
#: Documents that meet all labelled vectors at once.
BLOCK = 256
MODULUS, HELD_OUT = 3, 1
KINDS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 117 if c >= 128 else c for c in range(256))
RUNS = re.compile(rb"([\s\S])\1+")


def shape(kinds: bytes) -> bytes:
    """Of a word's characters by kind: one for each run."""
    return RUNS.sub(rb"\1", kinds)


def shape_slot(kinds: bytes) -> int:
    return zlib.crc32(shape(kinds)) % SLOTS[1]


class Terms:
    """A text's slots and raw weights, in the order of blocks, with where each block begins. Words that share a slot each have their own weight there."""

    def __init__(self) -> None:
        self.shapes = Memo(shape_slot, SHAPE_BYTES)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, tuple[int, int]] | None:
        found = words(text)
        if not found:
            return None
        counts = Counter(found)
        each = np.fromiter(counts.values(), np.float64, len(counts))
        spelled = b" ".join(counts)  # words hold no spaces, so their letters can be changed in one go
        plain = np.fromiter(map(zlib.crc32, spelled.lower().split(b" ")), np.int64, len(counts)) % SLOTS[0]
        in_shape = np.bincount(np.fromiter(map(self.shapes.__getitem__, spelled.translate(KINDS).split(b" ")), np.int64, len(counts)), each, SLOTS[1])
        shapes = np.flatnonzero(in_shape)
        lines = [x for x in text.split("\n") if x.strip()]
        n, different = len(found), len(counts)
        facts = [
            min(11, n.bit_length() - 1), 12 + 10 * different // n, 24 + (10 * (len(lines) - len(set(lines))) // len(lines) if lines else 0), 36 + min(20, sum(map(len, found)) // n),
            60 + 10 * sum(map(eq, found, found[1:])) // n, 72 + min(11, (n // different).bit_length() - 1), 84 + 10 * max(counts.values()) // n,
        ]
        at = np.concatenate([plain, shapes + SLOTS[0], np.array(facts) + (SLOTS[0] + SLOTS[1])])
        return at, np.log1p(np.concatenate([each, in_shape[shapes], np.ones(len(facts))])), (len(plain), len(plain) + len(shapes))


def weighted(terms: tuple, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights, each block normalised."""
    at, raw, cuts = terms
    x = raw * idf[at]
    for a, b, w in zip((0, *cuts), (*cuts, len(x)), WEIGHTS, strict=True):
        norm = math.sqrt(float(x[a:b] @ x[a:b]))
        x[a:b] *= w / norm if norm else 0.0
    return at, x


def summed(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each slot once."""
    slot, own = np.unique(at, return_inverse=True)
    return slot.astype(np.int32), np.bincount(own, x)


def frequencies(texts: DataFrame) -> np.ndarray:
    """How many of all texts have each slot; a row a slot and task is shuffled. The last number is how many texts have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, found = kept(("terms",), Terms), np.zeros(ALL + 1, np.int64)
        for b in batches:
            for x in b.column(0):
                if t := terms.of(x.as_py()):
                    found[t[0]] += 1
                    found[ALL] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], ["slot", "n"])

    out = np.zeros(ALL + 1, np.int64)
    for r in texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """doc_id, label, text of at most `most` labelled documents of each label, and how many labels 0 and 1 there are."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS
    own = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").where(fold != HELD_OUT).groupBy("doc_id").agg(F.max("quality").alias("label"))
    own = settled(own.where("label in (0, 1)"), "neighbours-labels")
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = [own.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    drawn = settled(drawn[0].union(drawn[1]), "neighbours-drawn")
    texts = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts.where("text is not null"), [counts.get(0, 0), counts.get(1, 0)]


def fitted(texts: DataFrame, idf: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading right singular vectors of labelled texts' weights, the texts' unit vectors in them, and their labels."""
    spark = texts.sparkSession

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = kept(("terms",), Terms)
        for b in batches:
            found = [(i, y, *summed(*weighted(t, idf))) for i, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True) if (t := terms.of(x))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], b.column(0).type), pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.list_(pa.int32())), pa.array([r[3] for r in found], pa.list_(pa.float64()))], ["doc_id", "label", "at", "x"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = settled(texts.select("doc_id", F.col("label").cast("int"), "text").mapInArrow(weights, f"doc_id {kind}, label int, at array<int>, x array<double>"), "neighbours-fit").coalesce(PARTS)

    def each(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, x in zip(b.column(0), b.column(1), strict=True):
            yield at.values.to_numpy(), x.values.to_numpy()

    def product(basis: np.ndarray) -> np.ndarray:
        """A'A basis, of the weights A."""
        told = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, out = told.value, np.zeros_like(told.value)
            for b in batches:
                for at, x in each(b):
                    out[at] += x[:, None] * (x @ q[at])  # a text's slots are different ones
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()], pa.binary())], ["part"])

        out = np.zeros(basis.shape)
        for r in rows.select("at", "x").mapInArrow(run, "part binary").toLocalIterator():
            out += np.frombuffer(r["part"], np.float32).reshape(basis.shape)
        told.destroy()
        return out

    q = np.linalg.qr(np.random.default_rng(7).standard_normal((ALL, dimensions + EXTRA)))[0]
    for _ in range(ROUNDS):
        q = np.linalg.qr(product(q))[0]
    values, turned = np.linalg.eigh(q.T @ product(q))
    basis = (q @ turned[:, np.argsort(-values)[:dimensions]]).astype(np.float32)
    told = spark.sparkContext.broadcast(basis)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(x @ told.value[at]).astype(np.float32).tobytes() for at, x in each(b)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(2), b.column(3)], ["v", "label", "doc_id"])

    found = sorted(rows.select("at", "x", "label", "doc_id").mapInArrow(vectors, f"v binary, label int, doc_id {kind}").collect(), key=lambda r: r["doc_id"])
    v = np.array([np.frombuffer(r["v"], np.float32) for r in found], np.float32).reshape(len(found), dimensions)
    return basis, unit(v), np.array([r["label"] for r in found], np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def votes(v: np.ndarray, known: np.ndarray, labels: np.ndarray, stands_for: np.ndarray, k: int, prior: float) -> np.ndarray:
    """The share of label 1 among the k labelled vectors most similar to each row of v, and those that tie with the last, by similarity."""
    if not len(known):
        return np.full(len(v), prior)
    out = []
    sums = np.stack([stands_for * labels, stands_for], 1)
    for a in range(0, len(v), BLOCK):
        s = v[a : a + BLOCK] @ known.T
        last = np.partition(s, len(known) - k, axis=1)[:, len(known) - k] if k < len(known) else np.full(len(s), -1.0, s.dtype)
        s[s < last[:, None] - 1e-6] = 0
        yes, of = (np.maximum(s, 0) @ sums).astype(np.float64).T
        out.append(np.divide(yes, of, out=np.full(len(s), prior), where=of > 1e-6))
    return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED, dimensions: int = DIMENSIONS, k: int = K) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. labels: doc_id, quality (0 or 1)."""
    long_texts(docs.sparkSession)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % MODULUS
    taken = docs.select(F.col(id_col).alias("doc_id"), (fold == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    found = frequencies(taken.select("text"))
    idf = np.log((1 + found[ALL]) / (1 + found[:ALL])) + 1
    texts, counts = labelled_texts(taken.select("doc_id", "text"), labels, most)
    basis, known, own = fitted(texts, idf, dimensions)
    prior = counts[1] / sum(counts) if sum(counts) else 0.5
    here = [max(1, int((own == y).sum())) for y in (0, 1)]
    stands_for = np.where(own == 1, counts[1] / here[1], counts[0] / here[0]).astype(np.float32)
    told = docs.sparkSession.sparkContext.broadcast((idf, basis, known, own, stands_for / (stands_for.max() if len(own) else 1)))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = kept(("terms", name), Terms)
        idf, basis, *model = told.value
        for b in batches:
            v = np.zeros((b.num_rows, dimensions), np.float32)
            for i, x in enumerate(b.column(2)):
                if t := terms.of(x.as_py()):
                    at, w = weighted(t, idf)
                    v[i] = w.astype(np.float32) @ basis[at]
            score = np.round(votes(unit(v), *model, k, prior), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return taken.mapInArrow(run, f"doc_id {taken.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
