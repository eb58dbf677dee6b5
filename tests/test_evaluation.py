import numpy as np
import pytest

from tidewake.operators import evaluation


@pytest.fixture(scope="module")
def tables(spark):
    """Truths and judged rows of two classes: ties, confidences at and beyond the ends, one without."""
    rng = np.random.default_rng(4)
    conf = [None, 0.0, 1.0, 1.5, -0.5, *rng.choice([0.25, 0.5, 0.9, 0.9001], 20), *rng.random(35)]
    rows = [(k // 4, k % 4, "ab"[k % 2], None if c is None else float(c), [1, 0, None][int(rng.integers(0, 3))]) for k, c in enumerate(conf)]
    truth = spark.createDataFrame([(f, k, c, False) for f in range(12) for k, c in enumerate("ab")], "frame long, gt int, cls string, difficult boolean")
    return truth, spark.createDataFrame(rows, "frame long, det int, cls string, conf double, tp int"), rows


def by_hand(rows, cls):
    """(rank, rec, prec) of a class in its order, and its AP."""
    own = sorted((r for r in rows if r[2] == cls), key=lambda r: (r[3] is None, -(r[3] or 0), r[0], r[1]))
    out, tp, fp = [], 0, 0
    for rank, r in enumerate(own, 1):
        tp, fp = tp + (r[4] or 0), fp + (r[4] == 0)
        out.append((rank, tp / 12, tp / max(tp + fp, 1)))
    ap = sum((now[1] - last) * max(p for _, _, p in out[i:]) for i, (now, last) in enumerate(zip(out, [0, *(o[1] for o in out)])))
    return out, ap


@pytest.mark.parametrize("slices", [1, 7, 4096])
def test_ranks_do_not_depend_on_slices(tables, slices):
    truth, judged, rows = tables
    points = evaluation.curve(truth, judged, slices)
    got = {c: sorted((r["rank"], r["rec"], r["prec"]) for r in points.collect() if r["cls"] == c) for c in "ab"}
    areas = {r["cls"]: r["ap"] for r in evaluation.average_precision(points).collect()}
    for cls in "ab":
        want, ap = by_hand(rows, cls)
        assert got[cls] == [pytest.approx(w) for w in want]
        assert areas[cls] == pytest.approx(ap)


def test_miss_rates_are_read_at_nine_places(tables):
    truth, judged, rows = tables
    got = {r["cls"]: r["lamr"] for r in evaluation.log_average_miss_rate(evaluation.curve(truth, judged)).collect()}
    for cls in "ab":
        own = sorted((r for r in rows if r[2] == cls), key=lambda r: (r[3] is None, -(r[3] or 0), r[0], r[1]))
        logs = []
        for i in range(9):
            misses, tp, fp = [1.0], 0, 0
            for r in own:
                tp, fp = tp + (r[4] or 0), fp + (r[4] == 0)
                if fp / 12 <= 10 ** (-2 + i / 4):
                    misses.append(1 - tp / 12)
            logs.append(np.log(max(misses[-1], 1e-10)))
        assert got[cls] == pytest.approx(np.exp(np.mean(logs)))
