"""Rules that are decided one after the other, against brute force, and the sweep over fragment lengths."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions.config import Settings, merged
from threadloom.operators import assignment, collisions, identities, intervals, links, votes
from threadloom.sources import trajectories


def test_ambiguity_against_all_permutations():
    r = np.random.default_rng(1)
    for t in range(200):
        n, m = (int(x) for x in r.integers(1, 5, 2))
        s = np.round(r.random((n, m)), 1 if t % 2 else 3)
        limit = float(r.choice([0.05, 0.1, 0.3]))
        k = max(n, m)
        c = np.ones((k, k))
        c[:n, :m] = 1 - s
        cost = {p: sum(c[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k))}
        chosen = assignment.solve(c)
        assert abs(cost[tuple(chosen)] - min(cost.values())) < 1e-9
        near = [p for p, x in cost.items() if x <= min(cost.values()) + limit + 1e-9]
        partner, rows, cols, _ = assignment.ambiguity(s, limit)
        assert list(rows) == [any(p[i] != chosen[i] for p in near) or partner[i] < 0 for i in range(n)]
        assert list(cols) == [any(p.index(j) != chosen.index(j) for p in near) or chosen.index(j) >= n for j in range(m)]


def test_ambiguity_per_edge_finds_ties():
    _, rows, cols, _ = assignment.ambiguity(np.array([[0.9, 0.9], [0.9, 0.9]]), 0.05, per_edge=True)
    assert rows.all() and cols.all()
    _, rows, _, _ = assignment.ambiguity(np.array([[0.9, 0.1], [0.1, 0.9]]), 0.05, per_edge=True)
    assert not rows.any()


@pytest.mark.parametrize("n", [2, 5, 10, 16])
@pytest.mark.parametrize("length", [4, 20, 53, 60, 500, 5000])
def test_p1_adds_up(spark, n, length):
    df = spark.createDataFrame([(1, 1, length - 1), (1, 2, 1)], "fragment_id long, identity long, n_images long")
    p = [r["p1"] for r in votes.p1(df, n).collect()]
    assert len(p) == n and abs(sum(p) - 1) < 1e-9


def test_cascade_is_the_same_for_components_together_and_apart():
    r = np.random.default_rng(2)
    for _ in range(50):
        sizes = [int(x) for x in r.integers(1, 6, 2)]
        p = [np.round(r.dirichlet(np.ones(3), k), 2) for k in sizes]
        near = [[[j for j in range(k) if j != i and (i + j) % 2] for i in range(k)] for k in sizes]
        both = identities.cascade(np.vstack(p), [9] * sum(sizes), near[0] + [[j + sizes[0] for j in x] for x in near[1]])[0]
        assert both == identities.cascade(p[0], [9] * sizes[0], near[0])[0] + identities.cascade(p[1], [9] * sizes[1], near[1])[0]


def test_demotion_keeps_the_longest_claim():
    p = np.array([[1.0, 0.0], [1.0, 0.0], [0.5, 0.5]])
    assert identities.demote(p, [5, 9, 20], [[1], [0], []]) == [True, False, False]
    assert p[0, 0] < 1 and p[1, 0] == 1


def test_scores_on_two_identities_take_the_better_colouring():
    assert identities.by_scores(np.array([[0.1, 0.9], [0.2, 0.3]]), [[1], [0]]) == [2, 1]
    assert identities.by_scores(np.array([[0.9, 0.1, 0.0], [0.8, 0.2, 0.0]]), [[1], [0]]) == [1, 2]


CASES = [
    # frame, identity, fragment, overlapping, p1 -> outcome
    (0, 1, 1, False, 0.9, "kept"), (1, 1, 1, True, None, "all_overlapping"), (1, 1, 2, True, None, "all_overlapping"),
    (2, 1, 3, False, 0.9, "by_length"), (2, 1, 1, False, None, "kept"), (3, 1, 1, False, 0.5, "by_p1"), (3, 1, 2, False, 0.6, "kept"),
    (4, 1, 1, False, 0.5, "unresolved"), (4, 1, 2, False, 0.5, "unresolved"), (5, 1, 1, False, None, "unresolved"), (5, 1, 2, False, None, "unresolved"),
    (6, 0, 1, False, 0.9, "unassigned"), (7, 1, 1, False, float("nan"), "by_p1"), (7, 1, 2, False, 0.1, "kept"),
]


def test_collisions(spark):
    df = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(CASES)], "event_id int, frame long, identity long, fragment_id long, is_overlapping boolean, p1_max double")
    got = {r["event_id"]: r["outcome"] for r in collisions.resolve_collisions(df).collect()}
    assert [got[k] for k in range(len(CASES))] == [c[5] for c in CASES]


def test_touching_intervals_do_not_overlap(spark):
    rows = [(0, 1, 0, 5), (0, 2, 5, 9), (0, 3, 4, 6), (0, 4, 4, 6), (1, 5, 0, 99), (1, 6, 20, 21), (1, 7, 3, 3)]
    df = spark.createDataFrame(rows, "video_id long, fragment_id long, start_frame long, end_frame long")
    assert {(r["frag_a"], r["frag_b"]) for r in intervals.coexisting(df).collect()} == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6)}


def test_chains(spark):
    n = 150
    df = spark.createDataFrame([(k, k + 1 if k < n else None) for k in range(n + 1)] + [(999, None)], "node long, next long")
    got = {r["node"]: (r["chain"], r["position"]) for r in links.chains(df).collect()}
    assert got[n] == (0, n) and got[999] == (999, 0)
    for bad in ([(1, 3), (2, 3), (3, None)], [(1, 2), (2, 1)], [(1, 7)]):
        with pytest.raises(ValueError):
            links.chains(spark.createDataFrame(bad, "node long, next long"))


def test_trajectories_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.5, 2.0, 0.5), (0, 1, 3.0, 4.0, 1.0), (2, 0, 5.0, 6.0, 0.0)], "frame long, individual long, x double, y double, probability double")
    for name in trajectories.FORMATS:
        path = str(tmp_path / name)
        assert trajectories.save(df, path, (name, "tape"), 2.0) == ["tape"]
        assert sorted(map(tuple, trajectories.load(spark, path).collect())) == sorted(map(tuple, trajectories.timed(df, 2.0).collect()))
    wide = trajectories.wide(df, 2, 2.0)
    assert {(r["frame"], r["time"], r["x1"], r["y2"]) for r in wide.collect()} == {(0, "0.000", "1.500", "4.000"), (2, "1.000", "5.000", None)}
    assert trajectories.long(wide, 2).count() == 3
    packed = trajectories.run_lengths(spark.createDataFrame([(1, k, v) for k, v in enumerate("aabba")], "key long, at long, v string"), "key", "at", "v")
    assert "".join(r["value"] for r in trajectories.from_run_lengths(packed, "key").orderBy("position").collect()) == "aabba"
    with pytest.raises(FileNotFoundError):
        trajectories.load(spark, str(tmp_path / "nothing"))


def test_settings():
    assert merged({"NUMBER_OF_ANIMALS": 3}, {"number_of_animals": 4}) == Settings(number_of_animals=4)
    for bad in ({"nonsense": 1}, {"similarity_method": "smell"}, {"report_ceiling": 0.1}):
        with pytest.raises(ValueError):
            merged(bad)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 9), (7, 8)], "a long, b long")
    assert {r["node"]: r["component"] for r in links.connected_components(e).collect()} == {4: 4, 5: 4, 9: 4, 7: 7, 8: 7}
    assert links.connected_components(e.where(F.lit(False))).count() == 0


def test_hulls():
    from threadloom.functions import hulls

    square, shifted = hulls.hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)]), hulls.hull([(1, 1), (3, 1), (3, 3), (1, 3)])
    assert len(square) == 4 and hulls.area(square) == 4 and abs(hulls.iou(square, shifted) - 1 / 7) < 1e-12 and hulls.iou(square, square) == 1
    assert hulls.hull([(0, 0), (1, 1), (2, 2)]) == [] and hulls.iou([], square) == 0 and hulls.iou(square, hulls.hull([(9, 9), (9, 8), (8, 9)])) == 0
    r = np.random.default_rng(4)
    grid = np.stack(np.meshgrid(np.linspace(0, 1, 300), np.linspace(0, 1, 300)), -1).reshape(-1, 2)
    inside = lambda h: np.all([(b[0] - a[0]) * (grid[:, 1] - a[1]) >= (b[1] - a[1]) * (grid[:, 0] - a[0]) for a, b in zip(h, h[1:] + h[:1], strict=True)], axis=0)
    for _ in range(20):
        a, b = (hulls.hull([tuple(p) for p in r.random((6, 2))]) for _ in range(2))
        x, y = inside(a), inside(b)
        assert abs(hulls.iou(a, b) - (x & y).sum() / (x | y).sum()) < 0.02


def test_accumulation():
    from threadloom.operators.decisions import Fragment, accumulation

    f = [Fragment(k, 10 * k, 10 * k + 9, 50, p1=[0.9, 0.1] if k % 2 == 0 else [0.2, 0.8]) for k in range(6)]
    for a, b in ((0, 1), (2, 3), (4, 5)):
        f[a].near.append(f[b])
        f[b].near.append(f[a])
    assert {k: v[0] for k, v in accumulation([[f[0], f[1]], [f[2], f[3]], [f[4], f[5]]], 2).items()} == {0: 1, 1: 2, 2: 1, 3: 2, 4: 1, 5: 2}
    f[3].certainty = 0.0
    assert set(accumulation([[f[0], f[1]], [f[2], f[3]]], 2)) == {0, 1}
    assert accumulation([], 2) == {}


def test_jumps_are_corrected():
    from threadloom.operators.decisions import Fragment, corrected_jumps

    a = Fragment(0, 0, 10, 10, p2=[1, 0], identity=1, fixed=True, leave=(0, 0))
    b = Fragment(1, 10, 20, 10, p2=[0.4, 0.6], identity=1, entry=(90, 0), leave=(90, 0))
    c = Fragment(2, 20, 30, 10, p2=[1, 0], identity=1, entry=(0, 0), fixed=True)
    d = Fragment(3, 0, 9, 9, p2=[0, 1], identity=2, leave=(90, 1), fixed=True)
    corrected_jumps([a, b, c, d], 0, 5.0, 2)
    assert [x.identity for x in (a, b, c, d)] == [1, 2, 1, 2]


def test_image_sizes():
    from threadloom.operators.blobs import image_size

    assert image_size(50) == (36, 1.0) and image_size(200) == (80, 0.56) and image_size(100, 0.5) == (36, 0.5)
