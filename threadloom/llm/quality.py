r"""Risk-controlled quality rules.

Fixed base rules reject a document at once. Beyond them each rule has a score, and a document is rejected where the
score exceeds the rule's cutoff. Cutoffs come from the labelled documents: for every stratum and rule, cutoffs are tried
from the laxest to the strictest, and one is certified if the exact (Clopper-Pearson) upper bound on the share of good
documents that it rejects is at most `risk / number of rules`, at a level of `level / (strata * rules)`. The first
failure ends the sequence (fixed-sequence testing needs no further correction within it), Bonferroni's correction covers
strata and rules, and the rules' risks add up to at most `risk`. Equal texts are one text here, as copies are no independent
evidence. So with probability 1 - level, in no stratum are more than `risk` of the distinct good texts that pass the base
rules rejected. A stratum with too few labels certifies nothing and keeps whatever the base rules keep.

Defined results: null or empty text has no words, so base_failed is true. A null stratum is a stratum of its own. Null
labels count as no label; of several labels for a document or for equal texts of a stratum the best counts, and equal
texts count once. Repeated rows are judged one by one, each alike; very long texts are judged whole. Empty tables give empty results, and without labels
no cutoff is certified. Input columns of any name, also those named as the outputs, stay as they are in `filter_rules`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import long_texts, settled

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
SPACES = bytes([0x20, *range(0x09, 0x0E)])

#: The rules: score of a document, in thousandths, as numerator and denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
}
#: Cutoffs that are tried, in thousandths, from the laxest to the strictest.
CUTOFFS = tuple(range(950, 0, -50))
RISK, LEVEL = 0.02, 0.05
#: Thresholds of up to so many strata are broadcast; more are joined.
BROADCAST_STRATA = 10_000
#: Ids of labelled documents are broadcast up to this number; with more, features of all documents are joined with the labels.
BROADCAST_LABELS = 2_000_000

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines"]
SCHEMA = T.StructType([T.StructField(x, T.LongType(), False) for x in [*FEATURES, "text_hash"]])


def repeat_words(tokens: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more among the text's windows, first one included."""
    n = len(tokens) - window + 1
    if n < 2:
        return 0
    ids = defaultdict(count().__next__)
    at = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    if len(ids) == len(tokens):
        return 0
    key, size = at, 1
    while size < window:  # ranks of windows of doubled length, exact
        step = min(size, window - size)
        pairs = key[: len(key) - step] * (len(at) + 1) + key[step:]
        size += step
        if size < window:
            _, key = np.unique(pairs, return_inverse=True)
        else:
            key = pairs
    _, inverse, found = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(found[inverse] > 1)
    edges = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def features(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(tokens),
        len(text or "") - (len(raw) - len(raw.translate(None, SPACES))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(tokens),
        len(raw) - len(raw.translate(None, UPPER)),
        len(lines),
        xxhash.xxh3_64_intdigest(raw) - (1 << 63),
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column(b.num_columns - 1)
        rows = [features(x.as_py()) for x in text]
        found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(SCHEMA), SCHEMA.names)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*b.schema.names[:-1], "found"])


def with_features(docs: DataFrame, text: str, keep: dict[str, F.Column]) -> DataFrame:
    """The columns of `keep`, and the struct `found`. Whole texts; one Arrow pass, no shuffle."""
    long_texts(docs.sparkSession)
    taken = docs.select(*(c.alias(k) for k, c in keep.items()), F.col(text).alias("found"))
    return taken.mapInArrow(_features, T.StructType([*taken.schema.fields[:-1], T.StructField("found", SCHEMA)]))


def base_failed(f: str = "found") -> F.Column:
    return (F.col(f"{f}.n_words") < 20) | (100 * F.col(f"{f}.n_repeat_words") > 30 * F.col(f"{f}.n_words"))


def score(rule: str, f: str = "found") -> F.Column:
    over, under = (F.col(f"{f}.{x}") for x in RULES[rule])
    return F.floor(1000 * over / F.greatest(under, F.lit(1)))


def certified(wrong: int, n: int, risk: float, level: float) -> bool:
    """Whether the exact binomial upper bound for `wrong` of n at this level is at most risk: P(X <= wrong | risk) <= level."""
    if n <= 0 or wrong >= n * risk:
        return False
    total = 0.0
    for i in range(wrong + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk))
    return total <= level


def thresholds(found: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """A row per stratum: stratum, and the certified cutoff of each rule (null where none is).

    found: id, stratum, found. labels: doc_id, quality. All labelled documents count; what is shuffled is a row of
    numbers for each document, then a row of counts for each stratum.
    """
    best = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    texts = (
        found.where(~base_failed()).join(best, "id")
        .groupBy("stratum", "found.text_hash", *(score(r).alias(r) for r in RULES)).agg(F.max("quality").alias("quality"))
        .where("quality = 1")
    )
    counts = settled(texts.groupBy("stratum").agg(F.count("*").alias("n"), *(F.array(*(F.count_if(F.col(r) > c) for c in cutoffs)).alias(r) for r in RULES)), "quality-counts")
    tests = max(1, counts.count()) * len(RULES)

    def chosen(n: pd.Series, wrong: pd.Series) -> pd.Series:
        out = []
        for size, row in zip(n, wrong, strict=True):
            best = None
            for cut, k in zip(cutoffs, row, strict=True):
                if not certified(int(k), int(size), risk / len(RULES), level / tests):
                    break
                best = cut
            out.append(best)
        return pd.Series(out, dtype="object")

    choose = F.pandas_udf(chosen, T.LongType())
    return counts.select("stratum", *(choose("n", r).alias(r) for r in RULES))


def verdicts(found: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    cut = cutoffs.select("stratum", F.struct(*RULES).alias("cut"))
    if cut.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        cut = F.broadcast(cut)
    over = [F.coalesce(score(r) > F.col(f"cut.{r}"), F.lit(False)) for r in RULES]
    failed = base_failed()
    for x in over[1:]:
        over[0] = over[0] | x
    return found.join(cut, "stratum", "left").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~over[0])


def stratum(column: str | None) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit("")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, the base features, base_failed, kept: a row for each row of docs."""
    found = settled(with_features(docs, text_col, {"id": F.col(id_col), "stratum": stratum(stratum_col)}), "quality-features")
    judged = verdicts(found, thresholds(found, labels, risk, level))
    return judged.select(F.col("id").alias("doc_id"), *(F.col(f"found.{x}").alias(x) for x in FEATURES[:5]), "base_failed", "kept")


def filter_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns. Texts never move: cutoffs come from the features of labelled documents, and the second pass judges each row where it lies."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_labelled")).distinct()
    some = docs.select(F.col(id_col).alias("id"), stratum(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    if known.count() <= BROADCAST_LABELS:
        some = some.join(F.broadcast(known), F.col("id") == F.col("_labelled"), "left_semi")
    first = settled(with_features(some, "text", {"id": F.col("id"), "stratum": F.col("stratum")}), "quality-features")
    cutoffs = thresholds(first, labels, risk, level)
    found = with_features(docs, text_col, {"doc": F.struct(*(F.col(f"`{c}`") for c in docs.columns)), "stratum": stratum(stratum_col)})
    return verdicts(found, cutoffs).where("kept").select("doc.*")
