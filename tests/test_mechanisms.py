"""Sources, derived columns, splines, images, contours and stop rules against brute force."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import contours, epochs, pixels, splines
from threadloom.sources import columns, posefile

# pose files


@pytest.fixture(scope="module")
def pose_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("poses"))
    rows = [(e, f, i, None if i else "a\nb", f / 7 if i else None, [{"x": float(f), "y": None if i else 1.5}] * (i + 1)) for e in (0, 2, 10) for f in range(e * 100, e * 100 + 40, 3) for i in range(f % 3 + 1)]
    df = spark.createDataFrame(rows, posefile.SCHEMA)
    posefile.write(df.repartition(5), path)
    return path, df


@pytest.mark.parametrize("split", [50, 300, 1 << 20])
def test_pose_files_come_back(spark, pose_dir, split):
    path, df = pose_dir
    got = posefile.read(spark, path, split_bytes=split)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert got.where("frame > 203 and frame <= 1006 and episode in (2, 10)").count() == df.where("frame > 203 and frame <= 1006 and episode in (2, 10)").count()
    assert [r["frame"] for r in posefile.read(spark, path, "frame long").where("frame = 9").collect()] == [9]


def test_pose_reader_plans_by_episode_and_range(pose_dir):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

    reader = posefile.PoseReader(["frame"], pose_dir[0], 200)
    splits = reader.partitions()
    assert [s.episode for s in splits] == sorted(s.episode for s in splits) and {s.episode for s in splits} == {0, 2, 10}
    assert all(s.end - s.start <= 200 for s in splits)
    left = list(reader.pushFilters([EqualTo(("episode",), 2), GreaterThan(("frame",), 1000), IsNotNull(("frame",)), EqualTo(("score",), 1.0)]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"]
    splits = reader.partitions()
    assert {s.episode for s in splits} == {2} and not [b for s in splits for b in reader.read(s)]


def test_pose_files_are_pruned_and_filtered_at_the_scan(spark, pose_dir, capsys):
    posefile.read(spark, pose_dir[0], "episode long, frame long").where("frame > 20 and episode = 2").explain("formatted")
    said = capsys.readouterr().out
    assert "PushedFilters: [GreaterThan(frame,20), EqualTo(episode,2)]" in said
    assert "ReadSchema: struct<episode:bigint,frame:bigint>" in said


def test_pose_files_without_instances_or_without_what_they_hold(spark, tmp_path):
    (tmp_path / "x_3.jsonl").write_text("{}\n" + json.dumps({"frame": 5, "instances": []}) + "\n" + json.dumps({"frame": 6, "instances": [{"pose": [[1, None]]}]}) + "\n\n")
    (tmp_path / "readme.txt").write_text("no poses")
    got = posefile.read(spark, str(tmp_path)).collect()
    assert [(r["episode"], r["frame"], r["track"], r["score"], [tuple(p) for p in r["pose"]]) for r in got] == [(3, 6, None, None, [(1.0, None)])]
    empty = tmp_path / "none"
    empty.mkdir()
    assert posefile.read(spark, str(empty)).count() == 0
    with pytest.raises(Exception, match="no columns"):
        posefile.read(spark, str(tmp_path), "nose long").collect()


# derived columns


def test_what_comes_from_a_column_goes_when_it_is_made_anew(spark):
    m = {"b": ("a",), "c": ("b", "x"), "d": ("c",), "e": ("x",)}
    assert columns.stale(m, "b") == ["c", "d"] and columns.stale(m, "x") == ["c", "d", "e"] and columns.stale(m, "d") == []
    rows = spark.createDataFrame([(1, 2, None, "q"), (2, 3, 4, None), (2, 3, 4, None)], "id long, a long, x long, column string")
    one, manifest = columns.appended(rows, {}, "b", F.col("a") + 1, ("a",))
    one, manifest = columns.appended(one, manifest, "c", F.col("b") + 1, ("b",))
    two, manifest = columns.appended(one, manifest, "b", F.col("a") + 2, ("a",))
    assert two.columns == ["id", "a", "x", "column", "b"] and manifest == {"b": ("a",)}
    how = {r["column"]: r["change"] for r in columns.changes(columns.digests(one, "id"), columns.digests(two.repartition(3), "id")).collect()}
    assert how == {"a": "same", "x": "same", "column": "same", "b": "changed", "c": "dropped"}
    with pytest.raises(ValueError, match="not there"):
        columns.appended(rows, {}, "z", F.lit(1), ("nothing",))
    with pytest.raises(ValueError, match="from itself"):
        columns.appended(one, {"b": ("a",), "c": ("b",)}, "b", F.lit(1), ("c",))
    assert {r["digest"] for r in columns.digests(rows.limit(0), "id").collect()} == {0}


# splines


def dense_spline(x, y, k, at):
    """The same spline through the whole matrix, by the recursion's definition."""
    t = splines.knots(x, k)
    n = len(x)

    def b(i, d, u):
        if d == 0:
            last = i == n - 1 and u >= t[n]
            return float((t[i] <= u < t[i + 1]) or last or (i == k and u < t[k]))
        left = (u - t[i]) / (t[i + d] - t[i]) * b(i, d - 1, u) if t[i + d] > t[i] else 0.0
        right = (t[i + d + 1] - u) / (t[i + d + 1] - t[i + 1]) * b(i + 1, d - 1, u) if t[i + d + 1] > t[i + 1] else 0.0
        return left + right

    c = np.linalg.solve(np.array([[b(i, k, u) for i in range(n)] for u in x]), y)
    return np.array([[b(i, k, u) for i in range(n)] for u in at]) @ c


@pytest.mark.parametrize("k", splines.DEGREES)
def test_splines(k):
    r = np.random.default_rng(k)
    for n in (k + 1, k + 2, 17):
        x = np.sort(r.choice(60, n, replace=False)).astype(float)
        y = r.standard_normal((n, 2))
        at = np.linspace(x[0], x[-1], 23)
        assert np.allclose(splines.spline(x, y, k, at), dense_spline(x, y, k, at), atol=1e-8)
        assert np.allclose(splines.spline(x, y, k, x), y)
        assert np.allclose(splines.spline(x, np.stack([x**k, 1 + x], 1), k, at), np.stack([at**k, 1 + at], 1))


def test_gaps_are_filled_within_windows(spark):
    r = np.random.default_rng(5)
    frames = {0: [f for f in range(1200) if not 100 <= f < 130 and f != 512], 1: [0, 1, 40, 41, 200], 2: [5, 900], 3: [7]}
    rows = [(i, f, float(r.standard_normal()), float(f % 11)) for i, fs in frames.items() for f in fs] + [(0, 512, None, 1.0), (0, 110, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "individual long, frame long, x double, y double").repartition(3)
    xy = {(i, f): (x, y) for i, f, x, y in rows if x is not None and not math.isnan(x)}
    for k in (1, 3, 5):
        want = {}
        for i, fs in frames.items():
            for a, b in itertools.pairwise(fs):
                if b - a > 1:
                    for wide in range(12):
                        use = [f for f in fs if a + 1 - 10 - 10 * wide <= f < b + 10 + 10 * wide]
                        if len(use) >= 10:
                            break
                    if len(use) > k:
                        at = np.arange(a + 1, b, dtype=float)
                        got = dense_spline(np.array(use, float), np.array([xy[i, f] for f in use]), k, at)
                        want |= {(i, int(f)): tuple(v) for f, v in zip(at, got, strict=True)}
        got = {(r["individual"], r["frame"]): (r["x"], r["y"]) for r in splines.filled(df, k).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[q], want[q], atol=1e-6) for q in want)
        assert {q[1] for q in got if q[0] == 0} == {*range(100, 130), 512}
    assert splines.filled(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="degree"):
        splines.filled(df, 4)


# images


def test_blobs_and_their_depths(spark):
    r = random.Random(2)
    shape = {0: (9, 13), 1: (9, 13), 2: (1, 13), 3: (9, 1), 4: (6, 6), 5: (6, 6)}
    masks = {f: np.array([[r.random() < 0.55 for _ in range(w)] for _ in range(h)]) for f, (h, w) in shape.items()}
    masks[4][:] = False
    masks[5][:] = True
    masks[5][0, 0] = False
    images = spark.createDataFrame([(f, m.shape[1], m.ravel().tolist()) for f, m in masks.items()], "frame long, width int, mask array<boolean>")
    lit = spark.createDataFrame([(f, int(y), int(x)) for f, m in masks.items() for y, x in np.argwhere(m)], "frame long, y long, x long")
    want, deep = {}, {}
    for f, m in masks.items():
        left = {tuple(map(int, p)) for p in np.argwhere(m)}
        dark = [tuple(map(int, p)) for p in np.argwhere(~m)]
        while left:
            first = min(left)
            part, todo = {first}, [first]
            left.discard(first)
            while todo:
                y, x = todo.pop()
                for q in itertools.product((y - 1, y, y + 1), (x - 1, x, x + 1)):
                    if q in left:
                        left.discard(q)
                        part.add(q)
                        todo.append(q)
            ys, xs = zip(*part, strict=True)
            want[f, first] = (len(part), min(xs), min(ys), max(xs), max(ys), round(sum(xs) / len(part), 6), round(sum(ys) / len(part), 6))
            deep[f, first] = math.sqrt(max(min((y - a) ** 2 + (x - b) ** 2 for a, b in dark) for y, x in part))
        if dark:
            assert (pixels.squared_distances(m) == np.array([[min((y - a) ** 2 + (x - b) ** 2 for a, b in dark) for x in range(m.shape[1])] for y in range(m.shape[0])])).all()
    got = {(b["frame"], (b["blob"]["y"], b["blob"]["x1"])): (b["n_pixels"], b["left"], b["top"], b["right"], b["bottom"], round(b["cx"], 6), round(b["cy"], 6)) for b in pixels.blobs(lit).collect()}
    assert got == want
    assert pixels.blobs(lit, 3, 20).count() == sum(3 <= v[0] <= 20 for v in want.values())
    found = pixels.labelled(lit)
    assert {(b["frame"], (b["blob"]["y"], b["blob"]["x1"])): b["distance"] for b in pixels.depths(images, found).collect()} == deep
    rest = {(e["frame"], e["y"], e["x"]) for e in pixels.eroded(images, 1.0).collect()}
    assert rest == {(f, int(y), int(x)) for f, m in masks.items() for y, x in np.argwhere(pixels.squared_distances(m) > 1)}
    assert pixels.blobs(lit.limit(0)).count() == 0


# contours


def sides(c):
    return list(zip(c, c[1:] + c[:1], strict=True))


def turn(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def within(c, p):
    for a, b in sides(c):
        if turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
            return True
    return sum((a[1] <= p[1] < b[1] and turn(a, b, p) > 0) or (b[1] <= p[1] < a[1] and turn(a, b, p) < 0) for a, b in sides(c)) % 2 == 1


def meet(c, d):
    for (a, b), (e, f) in itertools.product(sides(c), sides(d)):
        s = lambda x: (x > 0) - (x < 0)
        boxes = all(min(a[k], b[k]) <= max(e[k], f[k]) and min(e[k], f[k]) <= max(a[k], b[k]) for k in (0, 1))
        if boxes and s(turn(a, b, e)) * s(turn(a, b, f)) <= 0 and s(turn(e, f, a)) * s(turn(e, f, b)) <= 0:
            return True
    return within(c, d[0]) or within(d, c[0])


def test_contours_that_overlap(spark):
    r = random.Random(8)
    star = lambda x, y, s: [(x + s * q * round(math.cos(k * math.pi / 4), 3), y + s * q * round(math.sin(k * math.pi / 4), 3)) for k, q in enumerate([1, 0.25] * 4)]
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    some = [(0, box(0.0, 0.0, 10.0, 10.0)), (1, box(10.0, 10.0, 5.0, 5.0)), (1, box(2.0, 2.0, 3.0, 3.0)), (1, box(-5.0, 10.0, 30.0, 1.0)), (1, box(11.0, 0.0, 2.0, 2.0)), (1, [(4.0, 4.0)]), (1, [(0.0, 12.0), (30.0, -20.0)]), (2, box(0.0, 0.0, 10.0, 10.0))]
    # a notch: the boxes meet, the shapes do not
    some += [(0, [(100.0, 0.0), (140.0, 0.0), (140.0, 40.0), (130.0, 40.0), (130.0, 10.0), (110.0, 10.0), (110.0, 40.0), (100.0, 40.0)]), (1, box(115.0, 20.0, 10.0, 10.0))]
    some += [(r.randint(0, 3), star(r.uniform(200, 300), r.uniform(0, 100), r.uniform(2, 30))) for _ in range(60)]
    df = spark.createDataFrame([(k, f, [{"x": float(x), "y": float(y)} for x, y in c]) for k, (f, c) in enumerate(some)], "blob_id long, frame long, contour array<struct<x:double,y:double>>")
    want = {(i, j) for (i, (f, c)), (j, (g, d)) in itertools.product(enumerate(some), repeat=2) if g == f + 1 and meet(c, d)}
    for cell in (7.0, 1000.0):
        assert {tuple(p) for p in contours.overlapping_contours(df, cell).collect()} == want
    assert (8, 9) not in want and {(0, 1), (0, 2), (0, 3), (0, 5), (0, 6)} <= want and (0, 4) not in want
    assert contours.overlapping_contours(df.limit(0), 7.0).count() == 0


def test_moments_of_a_turned_shape(spark):
    ell = [(0, 0), (8, 0), (8, 1), (1, 1), (1, 3), (0, 3)]
    grid = [(x + 0.5, y + 0.5) for x in range(8) for y in range(3) if y == 0 or x == 0]
    for angle in (0.0, 0.3, 1.2, -0.7):
        c, s = math.cos(angle), math.sin(angle)
        df = spark.createDataFrame([([{"x": 5 + c * x - s * y, "y": s * x + c * y} for x, y in ell],), ([{"x": 1.0, "y": 1.0}],), ([{"x": x, "y": y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))],)], "c array<struct<x:double,y:double>>")
        got, point, square = df.select(*(v.alias(k) for k, v in contours.moments(F.col("c")).items())).collect()
        pts = np.array([(5 + c * x - s * y, s * x + c * y) for x, y in grid])
        cov = np.cov(pts.T, bias=True) + np.eye(2) / 12  # unit squares, whose own moments are 1/12
        assert math.isclose(got["area"], 10) and np.allclose([got["x"], got["y"]], pts.mean(0))
        assert np.allclose([got["xx"], got["xy"], got["yy"]], [cov[0, 0], cov[0, 1], cov[1, 1]])
        axis = np.linalg.eigh(cov)[1][:, 1]
        assert abs(abs(axis @ [math.cos(got["orientation"]), math.sin(got["orientation"])]) - 1) < 1e-9
        assert point["area"] is None and square["orientation"] is None and math.isclose(square["xx"], 1 / 3)


def test_points_in_holes_have_no_region(spark):
    box = lambda a, b: [{"x": x, "y": y} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    cs = spark.createDataFrame([(1, k, box(10.0 * k, 100.0 - 10 * k)) for k in range(3)] + [(2, 9, box(0.0, 100.0))], "group_id long, contour_id long, contour array<struct<x:double,y:double>>")
    assert {tuple(r) for r in contours.nested(cs, 30.0).collect()} == {(0, 0), (1, 1), (2, 2), (9, 0)}
    at = lambda *p: spark.createDataFrame([(g, k, x, 50.0) for k, (g, x) in enumerate(p)], "group_id long, point_id long, x double, y double")
    assert {tuple(r) for r in contours.regions_of(at((1, 5.0), (1, 25.0), (2, 15.0), (2, 0.0)), cs, 30.0).collect()} == {(0, 0), (1, 0), (2, 9), (3, 9)}
    for bad in ((1, 15.0), (1, 101.0), (3, 1.0)):
        with pytest.raises(ValueError, match="no region"):
            contours.regions_of(at((1, 5.0), bad), cs, 30.0)


def test_points_are_routed_to_the_nearest_contour(spark):
    r = random.Random(11)
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    shapes = [(0, box(0.0, 0.0, 10.0)), (0, box(5.0, 5.0, 10.0)), (0, box(3000.0, -3000.0, 1.0)), (1, [(4.0, 4.0)]), (1, [(0.0, 0.0), (8.0, 0.0), (0.0, 8.0)])] + [(2, box(r.uniform(0, 500), r.uniform(0, 500), r.uniform(1, 60))) for _ in range(12)]
    points = [(0, 7.0, 7.0), (0, 10.0, 2.0), (0, -90.0, 5.0), (0, 2990.0, -2000.0), (1, 4.0, 4.0), (1, 5.0, 5.0), (9, 1.0, 2.0)] + [(2, r.uniform(-300, 900), r.uniform(-300, 900)) for _ in range(80)]
    df = spark.createDataFrame([(k, f, [{"x": x, "y": y} for x, y in c]) for k, (f, c) in enumerate(shapes)], "blob_id long, frame long, contour array<struct<x:double,y:double>>")
    ps = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "point_id long, frame long, x double, y double")

    def off(c, p):
        out = []
        for a, b in sides(c):
            d = (b[0] - a[0], b[1] - a[1])
            n = d[0] ** 2 + d[1] ** 2
            t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0
            out.append(math.dist(p, (a[0] + t * d[0], a[1] + t * d[1])))
        return 0.0 if within(c, p) else min(out)

    for cell in (5.0, 700.0):
        got = {x["point_id"]: x for x in contours.routed(ps, df, cell).collect()}
        assert len(got) == len(points)
        for k, (f, *p) in enumerate(points):
            own = [(off(c, tuple(p)), i) for i, (g, c) in enumerate(shapes) if g == f]
            if own:
                assert got[k]["blob_id"] == min(own)[1] and abs(got[k]["distance"] - min(own)[0]) < 1e-9
                assert [tuple(q) for q in got[k]["contour"]] == shapes[min(own)[1]][1]
            else:
                assert got[k]["blob_id"] is None and [tuple(q) for q in got[k]["contour"]] == [(-1.0, 0.0), (3.0, 0.0), (3.0, 4.0), (-1.0, 4.0)]
    assert contours.routed(ps.limit(0), df, 5.0).count() == 0 and contours.routed(ps, df.limit(0), 5.0).where("blob_id is null").count() == len(points)


# stop rules


def test_stops(spark):
    nan = float("nan")
    runs = {
        "overfitting": [(1.0, x, 0.5) for x in (1.0, 0.9, 0.5, 0.4, 2.0, 3.0)], "plateau": [(1.0, 0.5, 0.5)] * 9, "accuracy": [(1.0, 1.0 / 2**k, 1.0) for k in range(6)],
        "epochs": [(1.0, 0.9**k if k % 2 else 5.0, 0.1) for k in range(30)], "diverged": [(1.0, 1.0, 0.1), (1.0, 1.0, 0.1), (nan, 1.0, 0.1)], "zero loss": [(1.0, x, 0.1) for x in (1.0, 0.9, 0.5, 0.4, 0.0)], None: [(1.0, 1.0, 0.1)],
    }
    rows = [(str(name), k, *e) for name, es in runs.items() for k, e in enumerate(es)]
    df = spark.createDataFrame(rows, "run string, epoch long, train_loss double, loss double, accuracy double")
    got = {r["run"]: (r["epoch"], r["reason"]) for r in epochs.stops(df, epochs.Limits(20, patience=3, worse=2)).collect()}
    assert got == {"overfitting": (5, "overfitting"), "plateau": (4, "plateau"), "accuracy": (4, "accuracy"), "epochs": (20, "epochs"), "diverged": (2, "diverged"), "zero loss": (4, "zero loss")}
