import datetime as dt
import itertools

import numpy as np
import pytest

from lumispark.kernels import distance, filters, linking, morphology, segmentation


def solid(shape, inside):
    return inside(*np.indices(shape).astype(float))


def test_labels_match_a_flood():
    rng = np.random.default_rng(1)
    for shape, connectivity in (((12, 13), None), ((12, 13), 1), ((7, 8, 6), None), ((7, 8, 6), 1)):
        mask = rng.random(shape) < 0.4
        want, count = np.zeros(shape, int), 0
        most = connectivity or mask.ndim
        steps = [s for s in itertools.product((-1, 0, 1), repeat=mask.ndim) if 0 < np.abs(s).sum() <= most]
        for p in map(tuple, np.argwhere(mask)):
            if not want[p]:
                count += 1
                todo = [p]
                want[p] = count
                while todo:
                    q = todo.pop()
                    for s in steps:
                        r = tuple(a + b for a, b in zip(q, s))
                        if all(0 <= a < n for a, n in zip(r, shape)) and mask[r] and not want[r]:
                            want[r] = count
                            todo.append(r)
        assert (morphology.label(mask, connectivity) == want).all()
    assert morphology.label(np.zeros((3, 3), bool)).max() == 0


def test_distances_and_expansion_match_brute_force():
    rng = np.random.default_rng(2)
    for shape in ((9, 11), (5, 6, 7)):
        mask = rng.random(shape) < 0.8
        out = np.argwhere(~mask)
        want = np.array([np.sqrt(((out - p) ** 2).sum(axis=1).min()) if mask[tuple(p)] else 0 for p in np.argwhere(np.ones(shape, bool))]).reshape(shape)
        assert np.allclose(distance.distances(mask), want)
    labels = np.zeros((9, 9), int)
    labels[2, 2], labels[6, 7] = 1, 2
    grown = distance.expand(labels, 3)
    for p in np.argwhere(np.ones((9, 9), bool)):
        d = {1: np.hypot(*(p - [2, 2])), 2: np.hypot(*(p - [6, 7]))}
        assert grown[tuple(p)] == (min(d, key=d.get) if min(d.values()) <= 3 else 0)
    assert (distance.ring(labels == 1, 1, 2) == (lambda y, x: (np.hypot(y - 2, x - 2) > 1) & (np.hypot(y - 2, x - 2) <= 2))(*np.indices((9, 9)))).all()


def test_morphology_matches_its_definition():
    rng = np.random.default_rng(3)
    mask = rng.random((10, 11)) < 0.5
    disk = morphology.ball(2, 2)
    assert len(disk) == 13
    for p in np.argwhere(np.ones(mask.shape, bool)):
        near = [tuple(p + o) for o in disk if all(0 <= a < n for a, n in zip(p + o, mask.shape))]
        assert morphology.dilate(mask, disk)[tuple(p)] == any(mask[q] for q in near)
        assert morphology.erode(mask, disk)[tuple(p)] == all(mask[q] for q in near)


def test_small_objects_holes_and_borders():
    mask = np.zeros((12, 12), bool)
    mask[2:9, 2:9] = True
    mask[4, 4] = False
    mask[11, 11] = True
    assert morphology.without_small(mask, 2).sum() == 48 and morphology.without_holes(mask, 2)[4, 4]
    assert morphology.clear_border(morphology.label(mask)).max() == 1
    tied = np.zeros((5, 9), int)
    tied[1:3, 1:3], tied[1:3, 5:7] = 1, 2
    kept, others = morphology.largest(tied)
    assert others and (kept == (tied == 1)).all()
    assert not morphology.largest(np.zeros((3, 3), int))[0].any()


def test_ball_ellipsoid_and_dumbbell():
    ball = solid((40, 40, 40), lambda z, y, x: (z - 20) ** 2 + (y - 20) ** 2 + (x - 20) ** 2 <= 225)
    assert ball.sum() == pytest.approx(4 / 3 * np.pi * 15**3, rel=0.02)
    assert segmentation.roundness(ball) == pytest.approx(1, abs=1e-6)
    long = solid((50, 50, 50), lambda z, y, x: ((z - 25) / 24) ** 2 + ((y - 25) / 16) ** 2 + ((x - 25) / 10) ** 2 <= 1)
    assert segmentation.roundness(long) == pytest.approx((16**2 + 10**2) / (24**2 + 16**2), rel=0.02)
    two = solid((40, 40, 80), lambda z, y, x: ((z - 20) ** 2 + (y - 20) ** 2 + (x - 20) ** 2 <= 225) | ((z - 20) ** 2 + (y - 20) ** 2 + (x - 58) ** 2 <= 225) | ((z - 20) ** 2 + (y - 20) ** 2 <= 9) & (x > 20) & (x < 58))
    assert segmentation.roundness(two) < 0.55


def test_watershed_parts_touching_discs():
    discs = solid((40, 60), lambda y, x: ((y - 20) ** 2 + (x - 20) ** 2 <= 144) | ((y - 20) ** 2 + (x - 37) ** 2 <= 144))
    far = distance.distances(discs)
    points = segmentation.peaks(far, 8)
    assert len(points) == 2
    parts = segmentation.watershed(-far, segmentation.seeds(discs.shape, points, 2), discs)
    assert sorted(np.unique(parts)) == [0, 1, 2] and (parts > 0).sum() == discs.sum()
    assert abs(int((parts == 1).sum()) - int((parts == 2).sum())) < 0.1 * discs.sum()


def test_filters():
    flat = np.full((9, 9), 3.0)
    assert np.allclose(filters.gaussian(flat, 2), 3) and np.allclose(filters.laplace(flat), 0)
    point = np.zeros((21, 21))
    point[10, 10] = 1
    assert filters.gaussian(point, 1).sum() == pytest.approx(1) and filters.laplace(point)[10, 10] == 4
    image = np.array([0.0] * 50 + [10.0] * 50)
    assert 0 < filters.otsu(image) < 10 and filters.otsu(flat) == 3
    assert filters.to_bytes(np.array([2, 4, 3])).tolist() == [0, 255, 127] and filters.to_bytes(flat).max() == 0
    assert filters.rescale(np.arange(8.0), (0.5,)).tolist() == [0.5, 2.5, 4.5, 6.5]
    bumps = np.zeros((30, 30))
    bumps[10, 10] = 50
    assert filters.rolling_ball(bumps, 5)[10, 10] < 5
    assert np.allclose(filters.rolling_ball(np.full((10, 10), 7.0), 3), 7)
    assert (np.uint8(200) + np.array([100], np.uint8))[0] == 44


def test_stripes_and_rings_align():
    y, x = np.indices((81, 81)) - 40.0
    inner = (np.hypot(y, x) > 10) & (np.hypot(y, x) < 34)
    normal = np.arctan2(y, x)
    for image, want in ((np.sin(np.hypot(y, x)), 1.0), (np.sin(12 * np.arctan2(y, x)), 0.0)):
        angle = segmentation.orientation(image, 2)
        assert (np.cos(angle - normal) ** 2)[inner].mean() == pytest.approx(want, abs=0.1)


def test_shapes():
    square = np.zeros((20, 20), bool)
    square[5:15, 5:15] = True
    assert segmentation.solidity(square) == 1 and segmentation.eccentricity(square) == pytest.approx(0)
    ell = square.copy()
    ell[5:11, 5:11] = False
    assert segmentation.solidity(ell) < 0.85
    disc = solid((60, 60), lambda y, x: np.hypot(y - 30, x - 30) <= 20)
    assert (segmentation.smoothed_fill(disc) ^ disc).sum() < 0.08 * disc.sum()
    assert segmentation.features(np.random.default_rng(1).random((12, 12))).shape == (12, 12, 1 + 4 * 6)
    assert morphology.filled_from_corners(~disc).sum() == (~disc).sum()


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(30):
        cost = rng.random((4, 6))
        best = min(sum(cost[i, p[i]] for i in range(4)) for p in itertools.permutations(range(6), 4))
        got = linking.assign(cost)
        assert len(set(got.tolist())) == 4 and sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(best)


def test_linking_reach_and_memory():
    track = lambda xs, fs: linking.link(np.array(fs), np.array([[x, 0.0] for x in xs]), 20, 2).tolist()
    assert track([0, 19], [0, 1]) == [0, 0] and track([0, 21], [0, 1]) == [0, 1]
    assert track([0, 1], [0, 3]) == [0, 0] and track([0, 1], [0, 4]) == [0, 1]
    crossing = linking.link(np.array([0, 0, 1, 1]), np.array([[0.0, 0], [10, 0], [9, 0], [1, 0]]), 20, 2).tolist()
    assert crossing == [0, 1, 1, 0]


def test_every_group_is_linked_at_the_least_cost():
    rng = np.random.default_rng(8)

    def cheapest(old, new, reach):
        """On a line some cheapest linking keeps the order, so it is a shortest path over both lists."""
        best = np.zeros((len(old) + 1, len(new) + 1))
        best[1:, 0] = reach * reach * np.arange(1, len(old) + 1)
        for i, a in enumerate(old):
            for j, b in enumerate(new):
                pair = best[i, j] + (a - b) ** 2 if abs(a - b) <= reach else np.inf
                best[i + 1, j + 1] = min(pair, best[i, j + 1] + reach * reach, best[i + 1, j])
        return best[-1, -1]

    for n, m in ((3, 4), (40, 50), (150, 140)):  # one group each, the larger ones of far over 60 points
        old, new = np.sort(rng.random(n) * 6 * n), np.sort(rng.random(m) * 6 * n)
        flat = lambda x: np.column_stack([x, np.zeros(len(x))])
        got = linking.match(flat(old), flat(new), 20.0)
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        assert all(abs(old[a] - new[b]) <= 20 for a, b in got)
        assert sum((old[a] - new[b]) ** 2 for a, b in got) + 400 * (n - len(got)) == pytest.approx(cheapest(old, new, 20.0))


def test_q36_links_every_event(spark, tmp_path):
    from lumispark.queries import queries

    rng = np.random.default_rng(2)
    rows = [(k, dt.datetime(2024, 1, 1 + int(f)), int(u), "ab"[k % 2], float(x)) for k, (f, u, x) in enumerate(zip(rng.integers(0, 6, 44), rng.choice([3, 4, 5, 21, 22, 1499], 44), rng.random(44) * 40))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.movie_id, r.particle) for r in queries()["q36_linking"](spark, str(tmp_path)).collect()}
    assert got.keys() == {r[0] for r in rows}
    points = {k: (kind, ts.day - 1, np.array([x, u * 10.0])) for k, ts, u, kind, x in rows}

    def cheapest(old, new):
        """(cost, old of each new) over all one-to-one linkings within reach."""
        if not new:
            return 400.0 * len(old), ()
        best = (np.inf, ())
        for k in (None, *old):
            far = 0.0 if k is None else ((points[k][2] - points[new[0]][2]) ** 2).sum()
            if far <= 400:
                cost, rest = cheapest([o for o in old if o != k], new[1:])
                best = min(best, (far + cost, (k, *rest)), key=lambda x: x[0])
        return best

    for kind in "ab":
        live, particle = {}, {}
        for frame in range(6):
            here = sorted(k for k, p in points.items() if p[:2] == (kind, frame))
            live = {k: f for k, f in live.items() if frame - f <= 3}
            for k, before in zip(here, cheapest(list(live), here)[1]):
                particle[k] = k if before is None else particle[before]
                live.pop(before, None)
                live[k] = frame
        pairs = lambda of: {(a, b) for a in particle for b in particle if of[a] == of[b]}
        assert pairs(particle) == pairs(got)


def test_objects_centroids_and_peaks_equal_plain_scans():
    from lumispark.kernels import segmentation

    rng = np.random.default_rng(3)
    labels = rng.integers(0, 5, (7, 9, 6)) * rng.integers(0, 2, (7, 9, 6))
    for (name, own), k in zip(segmentation.objects(labels), np.unique(labels[labels > 0]), strict=True):
        at = np.argwhere(labels == k)
        low, high = at.min(axis=0), at.max(axis=0) + 1
        assert name == k and (own == (labels == k)[tuple(slice(a, b) for a, b in zip(low, high))]).all()
    assert np.allclose(segmentation.centroids(labels), [np.argwhere(labels == k).mean(axis=0) for k in np.unique(labels[labels > 0])])
    assert segmentation.objects(np.zeros((3, 3), int)) == [] and segmentation.centroids(np.zeros((3, 3), int)).shape == (0, 2)
    image = rng.random((30, 31))
    for apart in (1, 2, 3, 5):
        tops = [(y, x) for y in range(apart, 30 - apart) for x in range(apart, 31 - apart) if image[y, x] == image[y - apart : y + apart + 1, x - apart : x + apart + 1].max()]
        assert sorted(map(tuple, segmentation.peaks(image, apart).tolist())) == tops
