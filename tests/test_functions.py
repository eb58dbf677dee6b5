import math

import numpy as np
import pytest

from tidewake.functions import geo, trajectory
from tidewake.functions.assignment import solve

CAMERA = geo.SAMPLE_CAMERA


def points(*p):
    return np.array(p, float)


def test_distances():
    assert geo.distance_m(0, 0, 0, 1) == pytest.approx(111319.4908, abs=5e-4)
    assert geo.distance_m(-37.951033416667, 144.424867888889, -37.652821138889, 143.926495527778) == pytest.approx(54972.271, abs=5e-4)
    assert geo.distance_m(10, 20, 10, 20) == 0
    assert geo.distance_m(1, 2, 3, 4) == pytest.approx(float(geo.distance_m(3, 4, 1, 2)), abs=1e-6)


@pytest.mark.parametrize("lat,lon,want", [(0, 1, 90), (1, 0, 0), (-1, 0, 180), (0, -1, 270)])
def test_bearings(lat, lon, want):
    assert geo.bearing_deg(0, 0, lat, lon) == pytest.approx(want)


def test_destinations():
    assert geo.destination(0, 0, 90, 111319.4908)[1] == pytest.approx(1, abs=1e-6)
    lat, lon = geo.destination(29.87, 121.5, 47, 3704)
    assert geo.distance_m(29.87, 121.5, lat, lon) == pytest.approx(3704, abs=1e-3)
    assert geo.destination(29.87, 121.5, 47, 0) == pytest.approx((29.87, 121.5), abs=1e-9)
    assert -180 < geo.destination(0, 179.99, 90, 5000)[1] < 0
    assert geo.destination_point(29.87, 121.5, 47, 3704) == pytest.approx((float(lat), float(lon)), abs=1e-12)


@pytest.mark.parametrize("distance,bearing,want", [(1000, 90, 1), (50, 90, 0), (1000, 0, 2), (1000, 125, 1), (1000, 126, 2)])
def test_classes(distance, bearing, want):
    assert geo.classify(CAMERA, distance, bearing) == want


def test_projection():
    x, y = geo.project(CAMERA, 1000.0, 90.0)
    assert 958 <= x <= 962 and y > 540
    assert geo.project(CAMERA, 1000.0, 80.0)[0] < x < geo.project(CAMERA, 1000.0, 100.0)[0]
    assert geo.project(CAMERA, 2000.0, 90.0)[1] < y


def test_warping():
    assert trajectory.dtw(points((0, 0), (1, 1)), points((0, 0), (1, 1))) == 0
    assert trajectory.dtw(points((0, 0)), points((3, 4))) == 5
    assert trajectory.dtw(points(*[(0, 0)] * 3), points(*[(0, 2)] * 3)) == 6
    assert trajectory.dtw(points((0, 0), (0, 0), (5, 5)), points((0, 0), (5, 5))) == 0
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.normal(size=(rng.integers(1, 9), 2)), rng.normal(size=(rng.integers(1, 9), 2))
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = math.dist(a[i], b[j]) + min(d[i, j + 1], d[i + 1, j], d[i, j])
        assert trajectory.dtw(a, b) == pytest.approx(d[-1, -1])
        assert trajectory.dtw(b, a) == pytest.approx(d[-1, -1])


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_pairs_warped_together_equal_each_alone(monkeypatch, cells):
    monkeypatch.setattr(trajectory, "DTW_CELLS", cells)
    rng = np.random.default_rng(2)
    tracks, vessels = ([rng.normal(size=(n, 2)) for n in rng.integers(1, 25, size=k)] for k in (9, 7))
    angles = trajectory.angles_between(tracks, vessels)
    assert angles.tolist() == [[trajectory.angle_between(t, v) for v in vessels] for t in tracks]
    wanted = rng.random(angles.shape) < 0.7
    got = trajectory.similarities(tracks, vessels, angles, wanted)
    assert got.tolist() == [trajectory.similarity(tracks[i], vessels[j]) for i, j in zip(*np.nonzero(wanted))]
    assert trajectory.similarities(tracks, vessels, angles, wanted & False).tolist() == []
    empty = trajectory.padded([np.empty((0, 2))])
    assert trajectory.dtw_many(empty, trajectory.padded(vessels[:1]), np.array([0]), np.array([0])).tolist() == [math.inf]


def test_angles_and_similarity():
    east, west, north = points((0, 0), (10, 0)), points((10, 0), (0, 0)), points((0, 0), (0, 10))
    assert trajectory.angle_between(east, east) == 0
    assert trajectory.angle_between(east, west) == pytest.approx(math.pi)
    assert trajectory.angle_between(east, north) == pytest.approx(math.pi / 2)
    assert trajectory.angle_between(points((0, 0), (-1, -1)), points((0, 0), (-1, 1))) == pytest.approx(math.pi / 2)
    bend = points(*[(0, i) for i in range(5)], *[(i, 4) for i in range(1, 12)])
    assert trajectory.angle_between(bend, east) == pytest.approx(0)
    assert trajectory.halve_points(points((0, 0), (10, 20), (30, 30), (50, 70), (9, 9))).tolist() == [[5, 10], [40, 50]]
    line = points(*[(10 * i, 0) for i in range(6)])
    assert trajectory.similarity(line, line + [0, 5]) == pytest.approx(15)
    assert trajectory.similarity(line, line + [0, 100]) == pytest.approx(300)
    assert trajectory.similarity(line, line[::-1]) == pytest.approx(1851.255, abs=1e-3)


@pytest.mark.parametrize("cost,want", [([[1, 2], [1, 90]], [1, 0]), ([[7]], [0]), ([[9, 1, 9], [9, 9, 2]], [1, 2]), ([[5, 9], [9, 5], [6, 6]], [0, 1, -1]), ([[-300, 1], [1, 1]], [0, 1]), ([], []), (np.zeros((2, 0)), [-1, -1])])
def test_assignment(cost, want):
    assert solve(cost) == want


def test_assignment_total():
    cost = np.array([[4, 1, 3], [2, 0, 5], [3, 2, 2]])
    assert sum(cost[i, j] for i, j in enumerate(solve(cost))) == 5
