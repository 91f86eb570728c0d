"""Matches of sessions, gathers and batches against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from threadloom.operators import clusters, gather, sessions
from threadloom.operators.sampling import lot


def test_sessions_are_matched_both_ways(spark, tmp_path):
    r = random.Random(6)
    animals = {"a": 3, "b": 3, "c": 5, "d": 2, "e": 1}
    rows = [(x, y, r.randrange(animals[x]), r.randrange(animals[y])) for x, y in itertools.permutations(animals, 2) if {x, y} != {"a", "d"} for _ in range(60)]
    rows += [("a", "a", 0, 0)] * 9
    df = spark.createDataFrame(rows, "session string, model string, identity long, predicted long").repartition(3)
    found = sessions.matrices(df)
    got = {}
    for x in sessions.matched(found, spark.createDataFrame(list(animals.items()), "session string, n_animals long")).collect():
        got.setdefault((x["session"], x["master"]), []).append(x)
    assert got.keys() == {p for p in itertools.combinations(animals, 2)} - {("a", "d")}
    for (a, b), xs in got.items():
        n, m = animals[a], animals[b]
        direct, indirect = np.zeros((n, m)), np.zeros((n, m))
        for s, t, i, j in rows:
            if (s, t) == (a, b):
                direct[i, j] += 1
            elif (s, t) == (b, a):
                indirect[j, i] += 1
        judge = direct + indirect if n == m else indirect if n > m else direct
        ways = [list(zip(p, range(m), strict=True)) for p in itertools.permutations(range(n), m)] if n > m else [list(enumerate(p)) for p in itertools.permutations(range(m), n)]
        pairs = [(x["identity"], x["assignment"]) for x in xs]
        assert sum(judge[p] for p in pairs) == max(sum(judge[p] for p in w) for w in ways) and len(pairs) == min(n, m)
        joined = direct + indirect
        for x in xs:
            i, j = x["identity"], x["assignment"]
            for row, k, said in ((direct[i], j, x["direct_score"]), (indirect[:, j], i, x["indirect_score"])):
                others = [v for q, v in enumerate(row) if q != k]
                assert abs(said - ((row[k] - max(others, default=0)) / row.max() if row.max() else 0)) < 1e-12
            assert abs(x["agreement"] - sum(joined[p] for p in pairs) / joined[[p[0] for p in pairs]].sum()) < 1e-12
    sessions.write(sessions.matched(found, spark.createDataFrame(list(animals.items()), "session string, n_animals long")), str(tmp_path / "out"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out"))
    assert back.count() == sum(map(len, got.values())) and set(back.columns) == {"session", "master", "identity", "assignment", "direct_score", "indirect_score", "agreement"}


def test_gathers_keep_order_and_repeats(spark):
    asked = [(k, k * 7 % 3, k % 4) for k in range(200)]
    images = spark.createDataFrame([(e, i, f"{e}.{i}") for e in range(2) for i in range(3)], "episode long, image long, pixels string")
    got = [tuple(r) for r in gather.gathered(spark.createDataFrame(asked[::-1], "ordinal long, episode long, image long").repartition(5), images).select("ordinal", "episode", "image", "pixels").collect()]
    by = {tuple(r)[1:3]: r for r in got}
    assert len(by) == 12
    assert got == [(k, e, i, f"{e}.{i}" if e < 2 and i < 3 else None) for k, e, i in asked]  # collected in the order of partitions


def test_batches_move_centres_at_their_own_rates(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.standard_normal((120, 4)) + 9 * k for k in range(3)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").repartition(3)
    k, share = 5, 3
    first = clusters.first_centres(df, k)
    lots = {seed: {x["vec_id"]: x["l"] for x in df.select("vec_id", lot(F.col("vec_id") + 1, seed).alias("l")).collect()} for seed in range(1, 6)}
    ids = sorted(lots[1], key=lambda i: (lots[1][i], i))[:k]
    centre, n = v[ids].copy(), np.zeros(k)
    inertia = lambda c: float(((v[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    start = inertia(centre)
    for step in range(4):
        batch = [i for i in range(len(v)) if lots[1 + step][i] % share == 0]
        near = {i: int(np.argmin(np.sqrt(((v[i] - centre) ** 2).sum(1)))) for i in batch}
        for c in range(k):
            own = [i for i in batch if near[i] == c]
            if own:
                centre[c] = (centre[c] * n[c] + v[own].sum(0)) / (n[c] + len(own))
                n[c] += len(own)
        got = sorted(tuple(x) for x in clusters.mini_batches(df, first, step + 1, share).collect())
        assert [g[0] for g in got] == list(range(k)) and [g[2] for g in got] == n.tolist()
        assert np.allclose([g[1] for g in got], centre)
    assert inertia(centre) < start
