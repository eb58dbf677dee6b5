"""Command line: ``python -m tidewake --data-path clip-01 --result-path result``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidewake.plans.run import RunConfig, run
from tidewake.sources import clips


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidewake", description="Fuse vessel messages and detected boxes of a clip folder.")
    parser.add_argument("--data-path", required=True, help="clip folder: a video named by its start time, ais/ and a camera text")
    parser.add_argument("--result-path", required=True, help="folder for MOT rows")
    parser.add_argument("--detections", help="Parquet of detected boxes (tick_ms, det, x1, y1, x2, y2[, score, feature])")
    parser.add_argument("--frames", type=int, required=True)
    parser.add_argument("--step-seconds", type=float, default=1.0)
    parser.add_argument("--tracker", choices=("iou", "appearance"), default="iou")
    parser.add_argument("--fusion", choices=("trajectory", "nearest"), default="trajectory")
    parser.add_argument("--anti", type=int, choices=(0, 1), default=0, help="predict occluded tracks")
    parser.add_argument("--anti-rate", type=float, default=0.0, help="least overlap that counts as occlusion, 0 to 1")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    a = arguments(given)
    spark = SparkSession.builder.appName("tidewake").getOrCreate()
    clip = clips.find_clip(spark, a.data_path, a.result_path)
    config = RunConfig(clip.start_ms, a.frames, int(a.step_seconds * 1000), fusion=a.fusion, tracker=a.tracker, anti=bool(a.anti), anti_rate=a.anti_rate)
    for name, value in (vars(a) | vars(clip)).items():
        print(f"{name}: {value}")
    run(spark, clip.ais, clip.camera, config, spark.read.parquet(a.detections) if a.detections else None, clip.result)


if __name__ == "__main__":
    main()
