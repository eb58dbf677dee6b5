"""Matching of true and found boxes frame by frame, and the scores a tracker gets from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake import config as C
from tidewake.functions.assignment import solve
from tidewake.operators import hosting

EVENTS = "sequence long, frame long, truth_id long, found_id long, kind string, distance double"
#: Stands for a pair that may not match; any number of such pairs costs more than all others.
FAR = 1e6


def apart_by(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """1 - IoU of boxes (x, y, w, h) in the last axis, pair by pair; NaN beyond ``most``."""
    left, top = np.maximum(a[..., 0], b[..., 0]), np.maximum(a[..., 1], b[..., 1])
    right = np.minimum(a[..., 0] + a[..., 2], b[..., 0] + b[..., 2])
    bottom = np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3])
    common = np.maximum(0, right - left) * np.maximum(0, bottom - top)
    whole = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - common
    apart = 1 - np.divide(common, whole, out=np.zeros_like(common), where=whole > 0)
    return np.where(apart > most, np.nan, apart)


def distances(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """apart_by() of rows by columns."""
    return apart_by(a[:, None], b[None], most)


def nearest_pairs(apart: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of most possible pairs, least distance in all."""
    if not apart.size:
        return []
    cost = np.where(np.isnan(apart), FAR, apart)
    return [(i, j) for i, j in enumerate(solve(cost)) if j >= 0 and not np.isnan(apart[i, j])]


class Matcher:
    """One sequence's matching: a pair of the last match is kept while both are there and near."""

    def __init__(self, most: float = C.EVAL_MIN_IOU):
        self.most = most
        self.last: dict[int, int] = {}

    def step(self, truth: dict[int, tuple], found: dict[int, tuple], ignored: list[tuple] = ()) -> list[tuple]:
        """(truth id, found id, kind, distance): NEAR for all near pairs, then MATCH, SWITCH, MISS and FALSE."""
        t, f = (np.array(list(side.values()), float).reshape(-1, 4) for side in (truth, found))
        t_ids, f_ids = list(truth), list(found)
        if len(ignored):
            covered = {j for _, j in nearest_pairs(distances(np.array(ignored, float).reshape(-1, 4), f, self.most))}
            f_ids = [i for j, i in enumerate(f_ids) if j not in covered]
            f = np.array([found[i] for i in f_ids], float).reshape(-1, 4)
        apart = distances(t, f, self.most)
        rows = [(t_ids[i], f_ids[j], "NEAR", float(apart[i, j])) for i, j in zip(*np.nonzero(~np.isnan(apart)))]
        open_ = apart.copy()
        done_t, done_f = set(), set()

        def take(i: int, j: int, kind: str) -> None:
            rows.append((t_ids[i], f_ids[j], kind, float(apart[i, j])))
            self.last[t_ids[i]] = f_ids[j]
            open_[i], open_[:, j] = np.nan, np.nan
            done_t.add(i)
            done_f.add(j)

        for i, name in enumerate(t_ids):
            if name in self.last and self.last[name] in f_ids and not np.isnan(open_[i, f_ids.index(self.last[name])]):
                take(i, f_ids.index(self.last[name]), "MATCH")
        for i, j in nearest_pairs(open_):
            take(i, j, "SWITCH" if self.last.get(t_ids[i], f_ids[j]) != f_ids[j] else "MATCH")
        rows += [(name, None, "MISS", None) for i, name in enumerate(t_ids) if i not in done_t]
        rows += [(None, name, "FALSE", None) for j, name in enumerate(f_ids) if j not in done_f]
        return rows


def match_boxes(truth: DataFrame, found: DataFrame, ignored: DataFrame | None = None, most: float = C.EVAL_MIN_IOU) -> DataFrame:
    """Events (sequence, frame, truth_id, found_id, kind, distance) of boxes (sequence, frame, id, x, y, w, h).

    In each frame found boxes that are assigned to ignored ones leave; then pairs of the last match
    are kept, the others assigned by IoU distance up to ``most``.  Sequences are the keys.
    """
    sides = [truth, found] + ([ignored] if ignored is not None else [])
    rows = None
    for side, boxes in enumerate(sides):
        part = boxes.select(F.col("sequence").cast("long"), F.col("frame").cast("long"), F.lit(side).alias("side"), F.col("id").cast("long"), *[F.col(c).cast("double") for c in "xywh"])
        rows = part if rows is None else rows.unionAll(part)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for table in whole_frames(batches):
            sequence, frame, side, ids = (table.column(k).to_numpy() for k in range(4))
            boxes = np.stack([table.column(k).to_numpy() for k in range(4, 8)], 1)
            edges = np.concatenate(([0], np.flatnonzero(sequence[1:] != sequence[:-1]) + 1, [len(sequence)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if run is None or run[0] != sequence[a]:
                    run = int(sequence[a]), Matcher(most)
                yield events_of(run[0], run[1], frame[a:b], side[a:b], ids[a:b], boxes[a:b])

    order = ("sequence", "frame", "side", "id")
    return rows.repartition("sequence").sortWithinPartitions(*order).mapInArrow(step, EVENTS)


def whole_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows again, cut where a frame begins: no more is held than a batch and a frame."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if any(batch.column(k).null_count for k in range(4)):
            raise ValueError("match_boxes: a box without sequence, frame or id")
        if not batch.num_rows:
            continue
        sequence, frame = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = batch.num_rows - 1
        same = (sequence == sequence[cut]) & (frame == frame[cut])
        cut = int(np.argmax(same))
        if held and (cut or (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (sequence[0], frame[0])):
            yield pa.Table.from_batches(held + [batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def crossed(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs of each frame's stretches, which begin at a and b and hold n_a and n_b rows."""
    n = n_a * n_b
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    return a[owner] + place // n_b[owner], b[owner] + place % n_b[owner]


def alone(values: np.ndarray) -> bool:
    return len(set(values)) == len(values)


def events_of(sequence: int, matcher: Matcher, frame: np.ndarray, side: np.ndarray, ids: np.ndarray, boxes: np.ndarray) -> pa.RecordBatch:
    """Matcher.step() of whole frames in order, sorted by side and id: pairs are measured together, frames walked one by one."""
    # Of equal ids of a side the last one counts.
    keep = np.concatenate(((frame[1:] != frame[:-1]) | (side[1:] != side[:-1]) | (ids[1:] != ids[:-1]), [True])) | (side == 2)
    frame, side, ids, boxes = frame[keep], side[keep], ids[keep], boxes[keep]
    first = np.concatenate(([0], np.flatnonzero(frame[1:] != frame[:-1]) + 1))
    n_t, n_f, n_g = (np.add.reduceat((side == k).astype(np.int64), first) for k in range(3))
    t0, f0, g0 = first, first + n_t, first + n_t + n_f
    number = np.repeat(np.arange(len(first)), n_t + n_f + n_g)

    covered = np.zeros(len(ids), bool)
    g, f = crossed(g0, n_g, f0, n_f)
    near = ~np.isnan(apart_by(boxes[g], boxes[f], matcher.most))
    g, f = g[near], f[near]
    clash = np.zeros(len(first), bool)
    for row in (g, f):
        clash[number[row[np.bincount(row, minlength=len(ids))[row] > 1]]] = True
    covered[f[~clash[number[f]]]] = True
    for k in np.flatnonzero(clash).tolist():
        for _, j in nearest_pairs(distances(boxes[g0[k] : g0[k] + n_g[k]], boxes[f0[k] : g0[k]], matcher.most)):
            covered[f0[k] + j] = True

    t, f = crossed(t0, n_t, f0, n_f)
    t, f = t[~covered[f]], f[~covered[f]]
    apart = apart_by(boxes[t], boxes[f], matcher.most)
    near = ~np.isnan(apart)
    t, f, apart = t[near], f[near], apart[near]
    taken, switch, last = [], [], matcher.last
    owner = number[t]
    edges = np.concatenate((np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))), [len(t)])).tolist() if len(t) else [0]
    true, found, t_rows, f_rows = ids[t].tolist(), ids[f].tolist(), t.tolist(), f.tolist()
    for a, b in zip(edges[:-1], edges[1:]):
        open_ = range(a, b)
        if b - a > 1:
            done_t, done_f = set(), set()
            for p in open_:
                if last.get(true[p]) == found[p] and t_rows[p] not in done_t and f_rows[p] not in done_f:
                    taken.append(p)
                    switch.append(False)
                    done_t.add(t_rows[p])
                    done_f.add(f_rows[p])
            open_ = [p for p in open_ if t_rows[p] not in done_t and f_rows[p] not in done_f]
            if not (alone([t_rows[p] for p in open_]) and alone([f_rows[p] for p in open_])):
                k = owner[a]
                free = [j for j in range(f0[k], g0[k]) if not covered[j]]
                column = {j: c for c, j in enumerate(free)}
                matrix, at = np.full((n_t[k], len(free)), np.nan), {}
                for p in open_:
                    cell = t_rows[p] - int(t0[k]), column[f_rows[p]]
                    matrix[cell], at[cell] = apart[p], p
                open_ = [at[cell] for cell in nearest_pairs(matrix)]
        for p in open_:
            taken.append(p)
            switch.append(last.get(true[p], found[p]) != found[p])
            last[true[p]] = found[p]

    taken = np.array(taken, np.int64)
    free = ~covered & (side < 2)
    free[t[taken]] = free[f[taken]] = False
    miss, false = np.flatnonzero(free & (side == 0)), np.flatnonzero(free & (side == 1))
    rows = np.concatenate((t, t[taken], miss, false))
    n, m = len(t) + len(taken), len(miss) + len(false)
    some = lambda v, none: pa.array(v, mask=none)
    lone = np.arange(n + m) >= n
    kinds = np.concatenate((np.zeros(len(t), np.int8), np.where(switch, 2, 1).astype(np.int8), np.full(len(miss), 3, np.int8), np.full(len(false), 4, np.int8)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + m, sequence)), pa.array(frame[rows]), some(ids[rows], np.arange(n + m) >= n + len(miss)), some(ids[np.concatenate((f, f[taken], miss, false))], lone & (kinds == 3)),
            pa.array(["NEAR", "MATCH", "SWITCH", "MISS", "FALSE"]).take(pa.array(kinds)), some(np.concatenate((apart, apart[taken], np.zeros(m))), lone),
        ],
        [c.split()[0] for c in EVENTS.split(", ")],
    )


@F.pandas_udf(T.DoubleType())
def most_in_common(pairs: pd.Series) -> pd.Series:
    """Of each list of (i, j, cost) the least cost of an assignment, negated; pairs that are not there cost nothing."""
    out = []
    for rows in pairs:
        i, j, cost = (np.array([r[c] for r in rows]) for c in ("i", "j", "cost"))
        out.append(-float(hosting.solve_lists(np.array([len(rows)]), i, j, cost, 0.0)[3].sum()) if len(rows) else 0.0)
    return pd.Series(out, dtype="float64")


def mot_scores(events: DataFrame) -> DataFrame:
    """Per sequence, and over all (sequence -1): mota, num_switches, idp, idr, idf1, precision, recall."""
    # One pass over the events: how often each kind, and each pair that is near, occurs.
    near = F.col("kind") == "NEAR"
    tallies = events.groupBy("sequence", "kind", F.when(near, F.col("truth_id")).alias("i"), F.when(near, F.col("found_id")).alias("j")).agg(F.count("*").alias("n"))
    is_ = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    pair = F.when(near, F.struct("i", "j", (-F.col("n")).cast("double").alias("cost")))
    rows = tallies.groupBy("sequence").agg(is_("MATCH", "SWITCH").alias("hits"), is_("SWITCH").alias("switches"), is_("MISS").alias("misses"), is_("FALSE").alias("wrong"), F.collect_list(pair).alias("pairs"))
    rows = rows.withColumn("idtp", most_in_common("pairs")).drop("pairs")
    total = rows.rollup("sequence").agg(*[F.sum(c).alias(c) for c in ("hits", "switches", "misses", "wrong", "idtp")]).filter("hits IS NOT NULL")
    truths, founds = F.col("hits") + F.col("misses"), F.col("hits") + F.col("wrong")
    return total.select(
        F.coalesce("sequence", F.lit(-1)).alias("sequence"), (1 - F.try_divide(F.col("misses") + F.col("wrong") + F.col("switches"), truths)).alias("mota"), F.col("switches").alias("num_switches"),
        F.try_divide("idtp", founds).alias("idp"), F.try_divide("idtp", truths).alias("idr"), F.try_divide(2 * F.col("idtp"), truths + founds).alias("idf1"),
        F.try_divide("hits", founds).alias("precision"), F.try_divide("hits", truths).alias("recall"),
    )


def near_pairs(truth: DataFrame, found: DataFrame, most: float = C.EVAL_MIN_IOU) -> DataFrame:
    """(sequence, truth_id, found_id, n): in how many frames two ids are near, as a join on the frame."""
    a, b = truth.alias("a"), found.alias("b")
    both = a.join(b, (F.col("a.sequence") == F.col("b.sequence")) & (F.col("a.frame") == F.col("b.frame")))
    w = F.least(F.col("a.x") + F.col("a.w"), F.col("b.x") + F.col("b.w")) - F.greatest("a.x", "b.x")
    h = F.least(F.col("a.y") + F.col("a.h"), F.col("b.y") + F.col("b.h")) - F.greatest("a.y", "b.y")
    common = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    whole = F.col("a.w") * F.col("a.h") + F.col("b.w") * F.col("b.h") - common
    near = both.filter((whole > 0) & (1 - F.try_divide(common, whole) <= most))
    return near.groupBy("a.sequence", F.col("a.id").alias("truth_id"), F.col("b.id").alias("found_id")).agg(F.count("*").alias("n"))
