"""What the operators share: tables, word splitting, cut lineage and bounded memories."""

from __future__ import annotations

import re
from collections.abc import Callable
from sys import getsizeof

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.tables import settled, shared_dir, table

__all__ = ["Memo", "kept", "long_texts", "parts", "settled", "shared_dir", "table", "words"]

BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
#: What an entry of a dictionary takes beside its key and value, and a whole number in a list.
ENTRY, NUMBER = 100, 32


def long_texts(spark: SparkSession) -> None:
    """Bounds the Arrow batches that pass between executors and their Python workers by bytes: ten thousand texts in one could be a GB.

    This sets the session's spark.sql.execution.arrow.maxBytesPerBatch and maxRecordsPerBatch, to lower values only.
    """
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        now = int(now) if re.fullmatch(r"-?\d+", now) else most + 1
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


class Memo(dict):
    """A function's results by argument, forgotten all at once when they take about `limit` bytes. What alone would take an eighth of them is not remembered."""

    def __init__(self, f: Callable, limit: int):
        super().__init__()
        self.f, self.limit, self.held = f, limit, 0

    def __missing__(self, key):
        out = self.f(key)
        size = getsizeof(key) + getsizeof(out) + ENTRY + (NUMBER * len(out) if isinstance(out, list) else 0)
        if size <= self.limit // 8:
            if self.held + size > self.limit:
                self.clear()
                self.held = 0
            self[key] = out
            self.held += size
        return out


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps for its next tasks, made once. Only the last operator's is kept: a worker outlives an operator, and memories would add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def words(text: str | None) -> list[bytes]:
    r"""The matches of [^\x20\x09-\x0D]+ in a text, as UTF-8; bytes.split() splits at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def parts(df: DataFrame, rows_each: int, least: int = 1) -> int:
    """How many groups of about rows_each rows df needs. One count, no data to the driver."""
    return max(least, -(-df.count() // rows_each))
