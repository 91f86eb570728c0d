"""The vote of nearest neighbours: exactness against plain sums, held-out accuracy, and every case that the docstring defines."""

import random
import zlib

import numpy as np
import pytest

from threadloom.llm import neighbours

held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_votes_are_exact():
    r = np.random.default_rng(1)
    known = neighbours.unit(r.standard_normal((60, 5)).astype(np.float32))
    known[7] = known[3]  # a tie
    y, w = (r.random(60) < 0.4).astype(np.float32), r.choice([0.5, 1.0], 60).astype(np.float32)
    v = np.vstack([neighbours.unit(r.standard_normal((300, 5)).astype(np.float32)), np.zeros((1, 5), np.float32), known[3:4]])
    for k in (1, 6, 60, 100):
        got = neighbours.votes(v, known, y, w, k, 0.25)
        for i, x in enumerate(v):
            s = known @ x
            last = sorted(s)[-k] if k <= 60 else -1
            use = [(max(float(a), 0), b, c) for a, b, c in zip(s, y, w, strict=True) if a >= last - 1e-6]
            of = sum(a * c for a, _, c in use)
            assert abs(got[i] - (sum(a * b * c for a, b, c in use) / of if of > 1e-6 else 0.25)) < 1e-4
    assert list(neighbours.votes(v[:2], known[:0], y[:0], w[:0], 3, 0.25)) == [0.25, 0.25]


def test_shapes():
    assert [neighbours.shape(x.encode().translate(neighbours.KINDS)) for x in ("The", "THE!!", "a1b22", "x$$$", "été", "--")] == [b"Aa", b"A!", b"a0a0", b"a$", b"uau", b"-"]


@pytest.fixture(scope="module")
def judged(spark):
    """Good prose and three kinds of junk, labelled for a part; nulls, empty, repeated and long texts; columns of clashing names."""
    r = random.Random(4)
    w = lambda n: [f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.choice('nrst')}{r.choice(['', 'ing', 'er', 'ly'])}" for _ in range(n)]
    out = []
    for k in range(900):
        words, good = w(r.randint(15, 90)), k % 4 > 0
        if not good:
            words = [[x + "###" for x in words], [x.upper() + "!!" for x in words], [x for x in words[:4] for _ in range(20)]][k // 4 % 3]
        out.append((k, " ".join(words), int(good)))
    docs = [(k, t, "s", "l", 0.5, 1) for k, t, _ in out] + [(1000, None, "s", "l", 0.5, 1), (1001, "", "s", "l", 0.5, 1), (1002, " \n", "s", "l", 0.5, 1), (None, "nobody", "s", "l", 0.5, 1), (1003, "long " * 30_000, "s", "l", 0.5, 1)] + [(5, out[5][1], "s", "l", 0.5, 1)] * 3
    labels = [(k, g, 0, "x") for k, _, g in out if k % 5] + [(1000, 1, 0, "x"), (1001, 0, 0, "x"), (2000, 1, 0, "x"), (None, 0, 0, "x"), (7, None, 0, "x"), (5, 0, 0, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, label string, score double, held_out int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), {k: g for k, _, g in out}


def test_held_out_accuracy(judged):
    docs, labels, good = judged
    got = neighbours.quality_scores(docs, labels).collect()
    assert len(got) == 908 and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    right = [r["predicted"] == good[r["doc_id"]] for r in got if r["doc_id"] in good and r["held_out"]]
    assert len(right) > 200 and np.mean(right) > 0.97
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (1000, 1001, 1002)}) == 1
    few = neighbours.quality_scores(docs, labels, most=40, dimensions=8, k=5).collect()  # a bounded sample still learns
    assert np.mean([r["predicted"] == good[r["doc_id"]] for r in few if r["doc_id"] in good and r["held_out"]]) > 0.9


def test_held_out_labels_are_never_read(spark, judged):
    docs, labels, _ = judged
    fold = [i for i in range(1100) if held(i)]
    turned = labels.where(~labels["doc_id"].isin(fold) | labels["doc_id"].isNull()).unionByName(spark.createDataFrame([(i, 1 - i % 2, 0, "") for i in fold], labels.schema))
    a, b = (sorted((r["doc_id"] or -1, r["score"]) for r in neighbours.quality_scores(docs, x).collect()) for x in (labels, turned))
    assert np.allclose(a, b, atol=1e-4)


def test_without_labels(judged, empty):
    docs, labels, _ = judged
    some = docs.limit(30)
    assert {r["score"] for r in neighbours.quality_scores(some, labels.limit(0)).collect()} == {0.5}
    one = neighbours.quality_scores(docs, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one} == {1.0}
    assert neighbours.quality_scores(docs.limit(0), labels).count() == 0
