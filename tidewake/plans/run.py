"""One fusion run: message files, a camera and detected boxes to fused tracks and MOT rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import boxes as B
from tidewake.functions.geo import Camera
from tidewake.operators import hosting, occlusion
from tidewake.sources import files


@dataclass(frozen=True)
class RunConfig:
    """fusion: "trajectory" (ways, assignment, remembered bindings) or "nearest".

    tracker: "iou", or "appearance" where detections have score and feature; with ``anti`` that one
    predicts tracks that overlap by more than ``anti_rate`` of either.  ``max_coast_seconds`` ends
    the dead reckoning of a silent vessel.
    """

    start_ms: int
    frames: int
    step_ms: int = 1000
    utc_offset_hours: float = 0.0
    run_id: int = 1
    fusion: str = "trajectory"
    tracker: str = "iou"
    anti: bool = False
    anti_rate: float = 0.0
    metric: str = "cosine"
    max_coast_seconds: float | None = None

    def __post_init__(self) -> None:
        if self.frames <= 0 or self.step_ms <= 0:
            raise ValueError("frames and step_ms must be positive")
        if self.fusion not in ("trajectory", "nearest"):
            raise ValueError(f"no such fusion: {self.fusion}")
        if self.tracker not in ("iou", "appearance"):
            raise ValueError(f"no such tracker: {self.tracker}")
        if self.anti and (self.tracker, self.fusion) != ("appearance", "trajectory"):
            raise ValueError("prediction of occluded tracks needs the appearance tracker and trajectory fusion")


@dataclass
class RunResult:
    sightings: DataFrame
    tracks: DataFrame
    fused: DataFrame
    camera: Camera
    config: RunConfig

    @property
    def size(self) -> tuple[float, float]:
        """Picture size by the camera's principal point."""
        return 2 * self.camera.u0, 2 * self.camera.v0

    def mot_rows(self, kind: str) -> DataFrame:
        """frame (from 1), id and box of "detection" (id 0), "tracking" or "fusion" (matched tracks, by mmsi)."""
        frame = ((F.col("tick_ms") - self.config.start_ms) / self.config.step_ms).cast("int") + 1
        rows = self.fused if kind == "fusion" else self.tracks
        name = {"detection": F.lit(0), "tracking": F.col("track_id"), "fusion": F.col("mmsi")}[kind]
        rows = rows.filter("mmsi IS NOT NULL") if kind == "fusion" else rows
        return rows.select(frame.alias("frame"), name.alias("id"), *B.mot_row(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], *self.size))

    def response(self) -> DataFrame:
        """One row per tick: its vessels and fused tracks as nested lists."""
        seen = self.sightings.filter("class = 'Transform'").groupBy("tick_ms").agg(F.array_sort(F.collect_list(F.struct("mmsi", "ord", "lon", "lat", "speed", "x", "y"))).alias("vessels"))
        fused = self.fused.groupBy("tick_ms").agg(F.array_sort(F.collect_list(F.struct("track_id", "mmsi", "x1", "y1", "x2", "y2"))).alias("fused_tracks"))
        return seen.join(fused, "tick_ms", "full")


def run(spark: SparkSession, ais_path: str, camera_path: str, config: RunConfig, detections: DataFrame | None = None, result_path: str | None = None) -> RunResult:
    """Run over a clip; detections (tick_ms, det, x1..y2) are optional, result_path gets three MOT files."""
    camera = files.read_camera(spark, camera_path)
    told = files.read_ais(spark, ais_path, config.utc_offset_hours)
    # A tick receives the file of its second, also where a run starts off the second or steps within it.
    ticks = files.ticks(spark, config.start_ms, config.frames, config.step_ms).select("tick_ms", F.floor(F.col("tick_ms") / 1000).alias("second"))
    messages = told.withColumn("second", F.unix_seconds("tick")).join(ticks, "second").withColumn("run_id", F.lit(config.run_id).cast("long"))
    sightings = hosting.sight_vessels(messages, (config.start_ms, config.frames, config.step_ms), camera, config.max_coast_seconds)
    gate = min(camera.u0, camera.v0)
    vessels = sightings.filter("class = 'Transform'").select("run_id", "tick_ms", "mmsi", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    boxes = detections if detections is not None else spark.createDataFrame([], "tick_ms long, det int, x1 double, y1 double, x2 double, y2 double, score double, feature array<double>")
    boxes = boxes.withColumn("run_id", F.lit(config.run_id).cast("long"))
    if config.anti:
        fused = occlusion.track_through_occlusion(boxes, vessels, gate, config.metric, True, config.anti_rate)
        result = RunResult(sightings, fused.drop("mmsi"), fused, camera, config)
        return _written(result, result_path)
    tracks = hosting.track_boxes(boxes) if config.tracker == "iou" else hosting.track_appearances(boxes, config.metric)
    x, y = B.center(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    left = tracks.select("run_id", "tick_ms", "track_id", x.alias("x"), y.alias("y"))
    matches = (hosting.fuse_tracks if config.fusion == "trajectory" else hosting.fuse_nearest)(left, vessels, gate)
    fused = tracks.join(matches, ["run_id", "tick_ms", "track_id"], "left")
    return _written(RunResult(sightings, tracks, fused, camera, config), result_path)


def _written(result: RunResult, result_path: str | None) -> RunResult:
    if result_path:
        for kind in ("detection", "tracking", "fusion"):
            files.write_mot(result.mot_rows(kind), f"{result_path}/{kind}")
    return result
