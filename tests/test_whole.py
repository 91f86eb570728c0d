"""What the reference computes, against brute force written out in the tests."""

import itertools
import math

import numpy as np
import pytest

from threadloom.operators import assignment, clusters, frames, identities, links
from threadloom.plans import queries

LABELS = [0, 0, 0, 1, 1, 1, 1, 2, 3, 3]


def far(v):
    return np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize("block", [3, 4096])
def test_silhouettes_are_of_euclidean_distances(spark, block):
    v = np.random.default_rng(6).normal(size=(10, 4))
    df = spark.createDataFrame([(k, v[k].tolist(), x) for k, x in enumerate(LABELS)], "vec_id long, v array<double>, label long")
    d, labels, want = far(v), np.array(LABELS), {}
    for i, x in enumerate(LABELS):
        own = [d[i, j] for j in range(10) if labels[j] == x and j != i]
        other = min(d[i, labels == k].mean() for k in set(LABELS) - {x})
        want[i] = (other - np.mean(own)) / max(other, np.mean(own)) if own else 0.0
    got = {r["vec_id"]: r["silhouette"] for r in clusters.euclidean_silhouettes(df, block).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    squared = {r["vec_id"]: r["silhouette"] for r in clusters.silhouettes(df).collect()}
    assert max(abs(squared[k] - want[k]) for k in want) > 0.01
    assert {r["silhouette"] for r in clusters.euclidean_silhouettes(df.where("label = 0"), block).collect()} == {0.0}


def test_swap_margins_are_of_the_optimal_assignment(spark):
    r, pairs, sizes, want = np.random.default_rng(8), [], [], {}
    for f in range(40):
        n, m = (int(x) for x in r.integers(1, 6, 2))
        s = np.round(r.random((n, m)), 6) * (r.random((n, m)) < 0.7)
        sizes.append((f, n, m))
        pairs += [(f, i, j, float(s[i, j])) for i in range(n) for j in range(m) if s[i, j] > 0]
        k = max(n, m)
        wide = np.zeros((k, k))
        wide[:n, :m] = s
        costs = np.ones((k, k))
        costs[:n, :m] = 1 - s
        partner = assignment.solve(costs)
        assert sum(wide[i, j] for i, j in enumerate(partner)) == pytest.approx(max(sum(wide[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k))))
        paired = [i for i in range(n) if partner[i] < m]
        for i in range(n):
            swaps = [s[i, partner[i]] + s[o, partner[o]] - s[i, partner[o]] - s[o, partner[i]] for o in paired if o != i] if i in paired else []
            want[f, i] = min(swaps, default=math.inf)
    similar = spark.createDataFrame(pairs, "frame long, i long, j long, similarity double")
    assigned = assignment.ambiguous_links(similar, spark.createDataFrame(sizes, "frame long, n long, m long"), 0.1)
    margins = links.assigned_swap_margins(similar, assigned)
    got = {(x["frame"], x["i"]): x["margin"] for x in margins.collect()}
    assert got == pytest.approx(want, abs=1e-9) and math.inf in got.values()
    shared = {(x["frame"], x["i"]): x["margin"] for x in links.two_swap_margins(similar, links.best_matches(similar)).collect()}
    assert shared != pytest.approx(want, abs=1e-9)
    swept = {x["threshold"]: (x["n"], x["percent"]) for x in links.margin_sweep(margins, [0.1, 0.5]).collect()}
    counts = {t: sum(v <= t for v in want.values()) for t in (0.1, 0.5)}
    assert swept == {t: (c, pytest.approx(100 * c / len(want))) for t, c in counts.items()}


@pytest.mark.parametrize("first, last", [(0, 719), (0, 1500), (-300, 40), (5, 6)])
def test_every_frame_has_an_episode(spark, first, last):
    df = spark.createDataFrame([(k,) for k in {*range(first, last, 7), last}], "frame long")
    eps = frames.data_episodes(df, 100)
    starts = sorted(r["start_frame"] for r in eps.collect())
    got = {r["frame"]: r["episode"] for r in frames.frame_episodes(df, eps).collect()}
    assert got == {f: int(np.searchsorted(starts, f, side="right")) - 1 for f in got} and len(got) == df.count()
    short = {r["frame"]: r["episode"] for r in frames.frame_episodes(df, frames.episodes(spark, 30, 10)).collect()}
    assert short == {f: min(2, int(np.searchsorted([0, 10, 20], f, side="right")) - 1) for f in got if f >= 0}


def test_global_index_keeps_events_of_later_days(spark, tmp_path):
    from datetime import datetime, timedelta

    at = [datetime(2024, 1, 1) + timedelta(days=k) for k in (-3, 0, 29, 31, 400)]
    spark.createDataFrame([(k, t, 1, "click", 1.0) for k, t in enumerate(at)], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["global_index"] for r in queries.global_index(spark, str(tmp_path)).collect()}
    assert got == {k: k for k in range(len(at))}


@pytest.mark.parametrize("block", [3, 4096])
def test_silhouettes_under_every_hypothesis(spark, block):
    v, labels = np.random.default_rng(9).normal(size=(10, 4)), np.array(LABELS)
    df = spark.createDataFrame([(k, v[k].tolist(), x) for k, x in enumerate(LABELS)], "vec_id long, v array<double>, label long")
    d = far(v)
    mean = np.array([[d[i, labels == k].sum() / max((labels == k).sum() - (labels[i] == k), 1) for k in range(4)] for i in range(10)])
    want = np.array([[(np.delete(m, k).min() - m[k]) / max(m[k], np.delete(m, k).min(), 1e-12) for k in range(4)] for m in mean])
    scores = clusters.hypothesis_silhouettes(df, block)
    assert {(r["vec_id"], r["cluster"]): r["silhouette"] for r in scores.collect()} == pytest.approx({(i, k): want[i, k] for i in range(10) for k in range(4)}, abs=1e-12)
    images = spark.createDataFrame([(k, k // 2) for k in range(10)], "vec_id long, fragment_id long")
    per = clusters.fragment_scores(scores, images)
    f = {r["fragment_id"]: r for r in per.collect()}
    mine = np.array([want[2 * k : 2 * k + 2].mean(axis=0) for k in range(5)])
    assert all(r["p"] == pytest.approx(list(mine[k])) and r["n_images"] == 2 for k, r in f.items()) and len(f) == 5
    got = {r["fragment_id"]: r["identity"] for r in identities.assign_by_scores(*queries._neighbours(per, 3)).collect()}
    near = [[o for o in range(5) if o != k and o // 3 == k // 3] for k in range(5)]
    assert got == dict(enumerate(identities.by_scores(mine, near)))


def test_demotion_runs_over_saturated_votes(spark):
    sf = "/root/testdata/sf0.001"
    n = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_quantity").collect():
        n.setdefault(r[0], [0, 0, 0])[0 if r[1] < 20 else 1 if r[1] < 45 else 2] += 1
    p = {k: [1 / sum(2.0 ** (o - x) for o in v) for x in v] for k, v in n.items()}
    lost = set()
    for k in sorted((k for k in p if max(p[k]) >= 1.0), key=lambda k: (-sum(n[k]), k)):
        if k not in lost:
            lost |= {o for o in p if o != k and o // 5 == k // 5 and max(p[o]) >= 1.0 and p[o].index(max(p[o])) == p[k].index(max(p[k]))}
    got = {r["fragment_id"]: r["demoted"] for r in queries.uniqueness_demotion(spark, sf).collect()}
    assert got == {k: k in lost for k in p} and any(got.values()) and not all(got.values())
    assert not any(r["demoted"] for r in queries.identity_cascade(spark, sf).collect())
