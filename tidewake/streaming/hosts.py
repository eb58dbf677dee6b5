"""The same state machines as streaming operators: one state per key, evicted by event time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewake.functions import geo
from tidewake.operators import hosting, states

_TRACKED = "run_id long, tick_ms long, det int, track_id int"


def sight_vessels_stream(messages: DataFrame, step_ms: int, camera: geo.Camera) -> DataFrame:
    """Streaming form of ``hosting.sight_vessels``.

    Rows with a null lon are heartbeats: they bring a vessel to their tick without a message, so a
    silent vessel coasts.  Rows of a key must come tick by tick, as files of seconds do.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        vessel, at = pickle.loads(state.get[0]) if state.exists else (states.VesselState(), None)
        pdf = pd.concat(list(frames))
        received = hosting.messages_of(pdf[pdf["lon"].notna()])
        last = int(pdf["tick_ms"].max())
        first = min(received, default=None) if at is None else at + step_ms
        if first is not None and first <= last:
            rows = list(hosting.vessel_rows(vessel, int(key[0]), int(key[1]), np.arange(first, last + 1, step_ms), received, camera))
            state.update((pickle.dumps((vessel, last)),))
            yield hosting.frame(rows, hosting.SIGHTINGS)

    return messages.groupBy("run_id", "mmsi").applyInPandasWithState(fold, hosting.SIGHTINGS, "payload binary", "append", GroupStateTimeout.NoTimeout)


def track_boxes_stream(boxes: DataFrame) -> DataFrame:
    """Streaming form of ``hosting.track_boxes``: run_id, tick_ms, det, x1..y2 to track ids, a state per run."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else states.IouTracker()
        rows = []
        for tick, now in pd.concat(list(frames)).sort_values(["tick_ms", "det"]).groupby("tick_ms", sort=True):
            ids = tracker.step(list(now[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)))
            rows += [(int(key[0]), int(tick), int(d), i) for d, i in zip(now["det"], ids)]
        state.update((pickle.dumps(tracker),))
        yield hosting.frame(rows, _TRACKED)

    return boxes.groupBy("run_id").applyInPandasWithState(fold, _TRACKED, "payload binary", "append", GroupStateTimeout.NoTimeout)


def _side_rows(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Tables under one another with a column ``side``; columns that one lacks are null there."""
    out = None
    for name, table in tables.items():
        kinds = {f.name: f.dataType for t in tables.values() for f in t.schema}
        part = table.select(F.lit(name).alias("side"), *[F.col(c) if c in table.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    return out


def track_appearances_stream(detections: DataFrame, metric: str = "cosine") -> DataFrame:
    """Streaming form of ``hosting.track_appearances``; a run's rows must come tick by tick."""
    out = "run_id long, tick_ms long, track_id int, x1 int, y1 int, x2 int, y2 int"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else states.DeepTracker(metric)
        rows = []
        for tick, now in pd.concat(list(frames)).sort_values(["tick_ms", "det"]).groupby("tick_ms", sort=True):
            rows += [(int(key[0]), int(tick), *r) for r in tracker.step(list(now[["x1", "y1", "x2", "y2", "score", "feature"]].itertuples(index=False, name=None)))]
        state.update((pickle.dumps(tracker),))
        yield hosting.frame(rows, out)

    return detections.groupBy("run_id").applyInPandasWithState(fold, out, "payload binary", "append", GroupStateTimeout.NoTimeout)


def fuse_tracks_stream(tracks: DataFrame, vessels: DataFrame, gate: float) -> DataFrame:
    """Streaming form of ``hosting.fuse_tracks``: both streams under one another, a state per run.

    A tick's tracks and vessels must come in the same batch, as a second's files do.
    """
    out = "run_id long, tick_ms long, track_id int, mmsi long"
    both = _side_rows({"track": tracks, "vessel": vessels}, ["run_id", "tick_ms", "track_id", "mmsi", "x", "y"])

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = pickle.loads(state.get[0]) if state.exists else hosting.FusionRun(gate)
        pdf = pd.concat(list(frames))
        rows = list(hosting.fusion_rows(run, pdf[pdf["side"] == "track"], pdf[pdf["side"] == "vessel"]))
        state.update((pickle.dumps(run),))
        yield hosting.frame([(int(key[0]), *r) for r in rows], out)

    return both.groupBy("run_id").applyInPandasWithState(fold, out, "payload binary", "append", GroupStateTimeout.NoTimeout)


def repeat_within_seconds(results: DataFrame, frames: DataFrame) -> DataFrame:
    """Every frame (run_id, tick_ms) with the results of its second, which only a second's first frame computes."""
    second = lambda c: F.floor(F.col(c) / 1000)
    told = results.withColumn("__second", second("tick_ms")).withColumnRenamed("tick_ms", "computed_ms")
    return frames.withColumn("__second", second("tick_ms")).join(told, ["run_id", "__second"]).drop("__second")
