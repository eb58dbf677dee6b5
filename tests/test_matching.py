import itertools
import random

import numpy as np

from tidewake.operators import matching, motion, occlusion

BOX = "sequence long, frame long, id long, x double, y double, w double, h double"


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    common = max(w, 0) * max(h, 0)
    return common / (a[2] * a[3] + b[2] * b[3] - common)


def best_by_trying(apart):
    """Most possible pairs, least distance: all ways tried."""
    rows, cols = apart.shape
    small, large, flip = (rows, cols, False) if rows <= cols else (cols, rows, True)
    best = (0, 0.0)
    for way in itertools.permutations(range(large), small):
        d = [apart[(j, i) if flip else (i, j)] for i, j in enumerate(way)]
        d = [v for v in d if not np.isnan(v)]
        best = min(best, (-len(d), sum(d)))
    return best


def test_nearest_pairs_equal_all_ways():
    rng = np.random.default_rng(4)
    for _ in range(60):
        apart = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
        apart[apart > 0.5] = np.nan
        pairs = matching.nearest_pairs(apart)
        n, total = best_by_trying(apart)
        assert len(pairs) == -n and abs(sum(apart[i, j] for i, j in pairs) - total) < 1e-9


def test_matches_are_kept_and_switches_counted(spark):
    truth = [(1, f, 1, 0.0, 0.0, 10.0, 10.0) for f in range(1, 5)]
    found = [(1, 1, 7, 1.0, 0.0, 10.0, 10.0), (1, 2, 7, 3.0, 0.0, 10.0, 10.0), (1, 2, 8, 0.0, 0.0, 10.0, 10.0), (1, 3, 8, 0.0, 0.0, 10.0, 10.0), (1, 4, 9, 90.0, 0.0, 10.0, 10.0)]
    got = matching.match_boxes(spark.createDataFrame(truth, BOX), spark.createDataFrame(found, BOX))
    events = sorted((r["frame"], r["kind"], r["truth_id"] or 0, r["found_id"] or 0) for r in got.collect() if r["kind"] != "NEAR")
    # Frame 2 keeps 7 although 8 is nearer; frame 3 switches; frame 4 has a miss and a false box.
    assert events == [(1, "MATCH", 1, 7), (2, "FALSE", 0, 8), (2, "MATCH", 1, 7), (3, "SWITCH", 1, 8), (4, "FALSE", 0, 9), (4, "MISS", 1, 0)]
    scores = {r["sequence"]: r for r in matching.mot_scores(got).collect()}
    assert set(scores) == {1, -1} and scores[1]["num_switches"] == 1
    assert abs(scores[1]["mota"] - (1 - (1 + 2 + 1) / 4)) < 1e-9 and scores[1]["precision"] == 3 / 5 and scores[1]["recall"] == 3 / 4
    # 7 and 8 are both near twice: the identity of most common frames counts once.
    assert scores[1]["idr"] == 2 / 4 and scores[1]["idp"] == 2 / 5 and abs(scores[-1]["idf1"] - 4 / 9) < 1e-9


def test_ignored_boxes_take_found_ones_away(spark):
    truth = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0)], BOX)
    found = spark.createDataFrame([(1, 1, 5, 0.0, 0.0, 10.0, 10.0), (1, 1, 6, 50.0, 0.0, 10.0, 10.0), (2, 3, 6, 50.0, 0.0, 10.0, 10.0)], BOX)
    ignored = spark.createDataFrame([(1, 1, 1, 51.0, 0.0, 10.0, 10.0)], BOX)
    kinds = sorted((r["sequence"], r["kind"]) for r in matching.match_boxes(truth, found, ignored).collect())
    assert kinds == [(1, "MATCH"), (1, "NEAR"), (2, "FALSE")]


def test_near_pairs_equal_the_events(spark):
    rng = random.Random(2)
    boxes = lambda n: [(s, f, i, float(rng.randrange(30)), float(rng.randrange(30)), 20.0, 20.0) for s in (1, 2) for f in range(6) for i in range(n)]
    truth, found = spark.createDataFrame(boxes(4), BOX), spark.createDataFrame(boxes(5), BOX)
    joined = {(r["sequence"], r["truth_id"], r["found_id"]): r["n"] for r in matching.near_pairs(truth, found).collect()}
    events = matching.match_boxes(truth, found).filter("kind = 'NEAR'").groupBy("sequence", "truth_id", "found_id").count().collect()
    assert joined == {(r[0], r[1], r[2]): r[3] for r in events} and joined


def test_cover_suppression(spark):
    rows = [(1, 1, 0.0, 0.0, 100.0, 100.0, 0.9), (1, 2, 10.0, 10.0, 20.0, 20.0, 0.8), (1, 3, 90.0, 90.0, 200.0, 200.0, 0.7)]
    df = spark.createDataFrame(rows, "frame long, det int, x1 double, y1 double, x2 double, y2 double, score double")
    assert {r["det"] for r in motion.suppress_covered(df).collect()} == {1, 3}


def moving(second, x, speed, feature):
    return (x + speed * second, 100.0, x + speed * second + 40, 140.0, 0.9, feature)


def test_an_occluded_track_moves_with_its_vessel():
    run = occlusion.OcclusionRun(540.0)
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    ids = None
    for second in range(16):
        boxes = [moving(second, 0, 10, a), moving(second, 300, -10, b)]
        if second > 13:  # both boxes overlap at second 13: nothing is detected behind it
            boxes = []
        points = {431000001: (20.0 + 10 * second, 120.0), 431000002: (320.0 - 10 * second, 120.0)}
        rows = {r[0]: r for r in run.step(second * 1000, boxes, points)}
        if second == 12:
            assert len(rows) == 2 and {r[5] for r in rows.values()} == {431000001, 431000002}
            ids = {r[5]: t for t, r in rows.items()}
    assert set(rows) == set(ids.values())
    first, other = rows[ids[431000001]], rows[ids[431000002]]
    # The vessel's step of the two seconds before, added to the last box.
    assert abs(first[1] - 150) <= 12 and abs(other[1] - 150) <= 12 and first[5] == 431000001 and other[5] == 431000002


def test_an_unbound_track_moves_at_its_own_speed_or_is_given_up():
    tracker = occlusion.OcclusionTracker()
    tracker.last = [{1: occlusion.Seen((10 * s, 0, 10 * s + 20, 20), s, (10.0, 0.0))} for s in range(5)]
    tracker.areas = {1: tracker.last[-1][1].box, 2: (0, 0, 5, 5)}
    assert tracker.predicted(5, {}, {}) == {1: (50.0, 0.0, 70.0, 20.0)}
    assert set(tracker.areas) == {1}
    tracker.areas = {1: (0, 0, 20, 20)}
    assert tracker.predicted(5, {1: 9}, {9: {4: (7.0, 1.0), 3: (5.0, 0.0)}}) == {1: (2.0, 1.0, 22.0, 21.0)}
    tracker.areas = {1: (0, 0, 20, 20)}
    assert tracker.predicted(5, {1: 9}, {9: {4: (7.0, 1.0)}}) == {} and not tracker.areas
