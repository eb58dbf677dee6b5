from itertools import permutations

import pytest

from tidewake.operators import states
from tidewake.plans import queries

FRAMES = {7: 2, 401: 3, 1999: 7, 2001: 1, 70000: 7}


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders of up to seven lines, with numbers below and above every former bound."""
    path = str(tmp_path_factory.mktemp("orders"))
    rows = [(f, k + 1, f % 97 + k * 31, f % 89 + k * 17, float(5 + k), 10.0 * k, 0.05, 0.01 * k, "N") for f, n in FRAMES.items() for k in range(n)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, names).write.parquet(f"{path}/lineitem.parquet")
    return path


def boxes_of(spark, path):
    by = {}
    for r in queries.A.boxes(spark, path).collect():
        by.setdefault(r["frame"], {})[r["det"]] = r
    return by


def test_every_frame_is_assigned_at_least_cost(spark, orders):
    got = {}
    for r in queries.QUERIES["assignment_min_cost"](spark, orders).collect():
        got.setdefault(r["tick_ms"], []).append(r)
    for frame, b in boxes_of(spark, orders).items():
        cost = lambda order, b=b: sum(abs(b[i]["x1"] - b[j]["y1"]) for i, j in zip(sorted(b), order))
        assert sorted(r["i"] for r in got[frame]) == sorted(r["j"] for r in got[frame]) == sorted(b)
        assert sum(r["cost"] for r in got[frame]) == pytest.approx(min(map(cost, permutations(b))))
    assert got.keys() == FRAMES.keys()


def test_every_box_of_every_frame_is_tracked(spark, orders):
    got = sorted(map(tuple, queries.QUERIES["appearance_tracker"](spark, orders).collect()))
    want = []
    for frame, b in boxes_of(spark, orders).items():
        tracker = states.DeepTracker("cosine")
        for t in range(6):
            now = [(*(b[d][c] + 2 * t for c in ("x1", "y1", "x2", "y2")), 0.9, [1.0 if d == i else 0.05 for i in range(1, max(3, len(b)) + 1)]) for d in sorted(b)]
            want += [(frame, 1000 * t, *map(int, r)) for r in tracker.step(now)]
    assert got == sorted(want) and {r[0] for r in got} == FRAMES.keys()


def test_means_add_in_the_order_of_the_sql(spark):
    """Two values six times over: their mean is whole, and the order of addition decides its last digit (F7)."""
    from tidewake.operators import vessels

    values = [83.84, 20.16] * 6
    rows = [(1, k, 1704500000 + k, v) for k, v in enumerate(values)] + [(2, 50, None, 3.5), (2, 51, None, 4.0)]
    points = spark.createDataFrame(rows, "user_id long, event_id long, s long, value double").selectExpr("user_id", "event_id", "timestamp_seconds(s) AS ts", "value")
    points = points.repartitionByRange(4, (points["event_id"] % 2).desc(), "event_id")
    got = {r["user_id"]: (r["start"] is None, r["value"], r["event_id"]) for r in vessels.tumbling_means(points, "user_id", ["value", "event_id"], "1 day", order="event_id").collect()}
    assert got == {1: (False, 52, 5), 2: (True, 3, 50)}
