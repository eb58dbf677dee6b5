import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_run import ROWS, T0, clip  # noqa: F401
from tidewake.__main__ import arguments
from tidewake.functions import pictures
from tidewake.operators import hosting, states
from tidewake.plans.run import RunConfig, run
from tidewake.sources import clips, exports, files
from tidewake.streaming import hosts


@pytest.mark.parametrize("start,step,frames", [(T0, 1000, 3), (T0 + 750, 1000, 3), (T0 + 250, 500, 3)])
def test_runs_start_off_the_whole_second(spark, clip, start, step, frames):  # noqa: F811
    result = run(spark, f"{clip}/ais", f"{clip}/camera.txt", RunConfig(start, frames, step))
    assert result.sightings.count() == 9


def test_a_silent_vessel_may_be_given_up(spark, clip):  # noqa: F811
    kept = run(spark, f"{clip}/ais", f"{clip}/camera.txt", RunConfig(T0, 5, 60_000, max_coast_seconds=90)).sightings
    assert kept.agg(F.max("tick_ms")).head()[0] == T0 + 60_000


def test_trackers_can_be_chosen(spark, clip):  # noqa: F811
    schema = "tick_ms long, det int, x1 double, y1 double, x2 double, y2 double, score double, feature array<double>"
    boxes = spark.createDataFrame([(T0 + 1000 * t, 0, 930.0, 680.0 + t, 990.0, 720.0 + t, 0.9, [1.0, 0.2]) for t in range(6)], schema)
    for config in (RunConfig(T0, 6, tracker="appearance"), RunConfig(T0, 6, tracker="appearance", anti=True)):
        result = run(spark, f"{clip}/ais", f"{clip}/camera.txt", config, boxes)
        last = result.fused.filter(F.col("tick_ms") == T0 + 5000).collect()
        assert [r["mmsi"] for r in last] == [431234567] and result.mot_rows("fusion").count() > 0
    for wrong in ({"tracker": "none"}, {"anti": True}, {"fusion": "none"}):
        with pytest.raises(ValueError):
            RunConfig(T0, 1, **wrong)


def test_clip_folders(spark, tmp_path):
    folder = tmp_path / "clip-01"
    (folder / "ais").mkdir(parents=True)
    (folder / "2022_06_04_12_05_12_12_07_02.mp4").write_bytes(b"x")
    (folder / "camera_para.txt").write_text("[1]")
    (folder / "ais" / "2022_06_04_12_05_14.csv").write_text("mmsi\n")
    (folder / "ais" / "notes.csv").write_text("mmsi\n")
    found = clips.find_clip(spark, str(folder), "/out")
    assert found.start_ms == 1654344312000 and found.ais.endswith("clip-01/ais") and found.result == "/out/clip-01" and found.camera.endswith("camera_para.txt")
    assert [tuple(r) for r in clips.second_files(spark, found.ais, found.start_ms).collect()] == [("2022_06_04_12_05_14.csv", 2)]
    (folder / "2022_06_04_12_05_12_12_07_02.mp4").unlink()
    with pytest.raises(ValueError):
        clips.find_clip(spark, str(folder), "/out")
    with pytest.raises(ValueError):
        clips.check_request(str(folder / "none"), str(folder / "camera_para.txt"), 1, 1)
    with pytest.raises(ValueError):
        clips.check_request(str(folder), str(folder / "camera_para.txt"), 0, 1)
    given = arguments(["--data-path", "a", "--result-path", "b", "--frames", "3", "--anti", "1"])
    assert given.anti == 1 and given.tracker == "iou" and given.step_seconds == 1.0


def test_pictures_and_settings(spark, tmp_path):
    for name in ("b/1.jpg", "a/2.PNG", "a/3.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = clips.labelled_pictures(clips.read_pictures(spark, str(tmp_path)))
    assert {(r["label"], r["number"]) for r in found.collect()} == {("a", 0), ("b", 1)}
    (tmp_path / "s.yaml").write_text("DEEPSORT:\n  MAX_DIST: 0.2 # near\n  NAME: \"x\"\nUSE: true\n")
    assert clips.read_settings(str(tmp_path / "s.yaml")) == {"DEEPSORT": {"MAX_DIST": 0.2, "NAME": "x"}, "USE": True}
    assert clips.merged(RunConfig(T0, 1), {"frames": 2}, {"fusion": "nearest"}).fusion == "nearest"
    with pytest.raises(ValueError):
        clips.merged(RunConfig(T0, 1), {"frame": 2})
    assert [r[0] for r in spark.createDataFrame([("a.MP4",), ("a.csv",)], "n string").select(clips.is_video(F.col("n"))).collect()] == [True, False]


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def test_implausible_edits_are_found(spark):
    edits = box(b"elst", bytes(4) + struct.pack(">I", 3) + struct.pack(">IiI", 4294963696, -1, 1) + struct.pack(">IiI", 3600, -1, 1) + struct.pack(">IiI", 4294963696, 0, 1))
    head = box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 110_000) + bytes(80))
    movie = box(b"ftyp", b"isom") + box(b"moov", head + box(b"trak", box(b"edts", edits)))
    at = movie.index(struct.pack(">I", 4294963696))
    assert clips.implausible_edits(movie) == [(at, 4)]
    assert clips.implausible_edits(movie[: len(movie) // 2]) == [] and clips.implausible_edits(b"") == []
    df = spark.createDataFrame([("x.mp4", movie), ("y.mp4", b"")], "path string, content binary")
    assert [tuple(r) for r in clips.find_implausible_edits(df).collect()] == [("x.mp4", at, 4)]


def test_picture_values(spark):
    rgb = bytes(range(12))
    df = spark.createDataFrame([(2, 2, rgb)], "w int, h int, rgb binary")
    got = np.array(df.select(pictures.normalised("w", "h", pictures.checked_rgb(F.col("w"), F.col("h"), F.col("rgb")))).head()[0])
    want = (np.arange(12).reshape(2, 2, 3) / 255 - pictures.MEAN) / pictures.DEVIATION
    assert np.allclose(got, want.transpose(2, 0, 1).ravel(), atol=1e-5)
    with pytest.raises(Exception, match="has bytes"):
        df.select(pictures.checked_rgb(F.col("w") + 1, F.col("h"), F.col("rgb"))).collect()
    row = spark.range(1).select(pictures.vector(F.lit("[1.5, -2]")), pictures.vector(F.lit("x")), pictures.label_colour(F.lit(3)), pictures.vessel_hue(F.lit(431000001))).head()
    assert list(row[0]) == [1.5, -2.0] and row[1] is None and list(row[2]) == [p * 7 % 255 for p in pictures.PALETTE] and row[3] == 431000001 * 47 % 360


def test_exports(spark, tmp_path):
    truth = spark.createDataFrame([(2, 1, "b", False, 0.0, 0.0, 10.0, 20.0), (1, 1, "a", True, 1.0, 1.0, 3.0, 3.0)], "frame long, gt int, cls string, difficult boolean, x1 double, y1 double, x2 double, y2 double")
    found = truth.select("frame", "cls", F.lit(0.5).alias("conf"), "x1", "y1", "x2", "y2")
    exports.write_coco(truth, found, ["a", "b"], f"{tmp_path}/coco")
    rows = {r["id"]: r for r in spark.read.json(f"{tmp_path}/coco/annotations").collect()}
    assert rows[0]["image_id"] == 1 and rows[0]["category_id"] == 1 and rows[0]["iscrowd"] == 1 and rows[1]["area"] == 190.0 and rows[1]["bbox"] == [0.0, 0.0, 10.0, 20.0]
    assert {r["id"] for r in spark.read.json(f"{tmp_path}/coco/categories").collect()} == {0, 1}
    with pytest.raises(Exception, match="no such class"):
        exports.coco_results(found, ["a"]).collect()
    parts = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "id long, part string")
    exports.write_image_lists(parts, f"{tmp_path}/lists")
    assert {r[0] for r in spark.read.text(f"{tmp_path}/lists/list=trainval").collect()} == {"1", "2"}
    assert {r["id"] for r in exports.members(parts, exports.image_lists(parts), "test").collect()} == {3}
    lines = exports.annotation_lines(spark.createDataFrame([(1, 1, 5.0, 6.0, 7.0, 8.0, 0), (1, 0, 1.0, 2.0, 3.0, 4.0, 2)], "id long, n int, x1 double, y1 double, x2 double, y2 double, cls int"), "/p")
    assert lines.head()["line"] == "/p/1.png 1,2,3,4,2 5,6,7,8,0"
    report = exports.report_lines(spark.createDataFrame([("a", 0.5)], "cls string, ap double"), spark.createDataFrame([("a", 1, 0.5, 1.0)], "cls string, rank int, rec double, prec double"), spark.createDataFrame([("a", 2, 1, 1)], "cls string, n_gt long, n_found long, tp long"))
    assert report.head()["text"].split("\n")[0] == "50.00% = a AP" and "Detected: 1 (tp:1, fp:0)" in report.head()["text"]
    log = spark.createDataFrame([(1, 5, 1, 0, 0, 9, 9, "ship", 0.9), (2, 65, 1, 0, 0, 9, 9, "ship", 0.9)], "frame_id int, s long, bbox_id int, top int, left int, width int, height int, category string, confidence double").withColumn("ts", F.timestamp_seconds("s"))
    assert {r["file"] for r in exports.rotated_log(log).select("file").collect()} == {"1970-01-01 00-00-00.json", "1970-01-01 00-01-00.json"}
    exports.write_rotated_log(log, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    step = exports.timed(lambda x: x + 1)
    assert step(1) == 2 and len(step.seconds) == 1


def test_labels_and_marks_count_in_some_files_only(spark, tmp_path):
    rows = "1,1,0,0,5,5,1,1,1\n1,2,0,0,5,5,0,1,1\n1,3,0,0,5,5,1,7,1\n0,4,0,0,5,5,1,1,1\n1,5,0,0,5,5,1,3,-1\n"
    for name in ("MOT16-02.txt", "other.txt"):
        (tmp_path / name).write_text(rows)
    ids = lambda name, **kw: sorted(r["id"] for r in files.read_mot(spark, f"{tmp_path}/{name}", **kw).collect())
    assert ids("MOT16-02.txt", truth=True) == [1] and ids("MOT16-02.txt", ignored=True) == [3, 5] and ids("MOT16-02.txt") == [1, 2, 3, 5]
    assert ids("other.txt", truth=True) == [1, 2, 3, 5] and ids("other.txt", ignored=True) == []


def test_streams_equal_batch(spark, tmp_path):
    detections = [(1, 1000 * t, d, 100.0 * d + t, 0.0, 100.0 * d + 40 + t, 40.0, 0.9, [1.0 * (d == 0), 1.0 * (d == 1), 0.1]) for t in range(6) for d in range(2)]
    schema = "run_id long, tick_ms long, det int, x1 double, y1 double, x2 double, y2 double, score double, feature array<double>"
    tracks = [(1, 1000 * t, d, 100.0 * d + t, 5.0 * t) for t in range(6) for d in range(2)]
    vessels = [(1, 1000 * t, 431000000 + d, 100.0 * d + t + 3, 5.0 * t + 2) for t in range(6) for d in range(2)]
    track_schema, vessel_schema = "run_id long, tick_ms long, track_id int, x double, y double", "run_id long, tick_ms long, mmsi long, x double, y double"

    def stream(rows, schema, name):
        for t in range(6):
            spark.createDataFrame([r for r in rows if r[1] == 1000 * t], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")

    def drained(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c-{name}").start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.table(name).collect()), key=str)

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = drained(hosts.track_appearances_stream(stream(detections, schema, "d")), "appearances")
        assert got == sorted(map(tuple, hosting.track_appearances(spark.createDataFrame(detections, schema)).collect()), key=str) and got
        got = drained(hosts.fuse_tracks_stream(stream(tracks, track_schema, "t"), stream(vessels, vessel_schema, "v"), 540.0), "fused")
        assert got == sorted(map(tuple, hosting.fuse_tracks(spark.createDataFrame(tracks, track_schema), spark.createDataFrame(vessels, vessel_schema), 540.0).collect()), key=str) and got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    repeated = hosts.repeat_within_seconds(spark.createDataFrame([(1, 1000, 5)], "run_id long, tick_ms long, track_id int"), spark.createDataFrame([(1, 1000), (1, 1040), (1, 2000)], "run_id long, tick_ms long"))
    assert sorted((r["tick_ms"], r["track_id"]) for r in repeated.collect()) == [(1000, 5), (1040, 5)]


def test_a_distance_of_ones_own():
    tracker = states.DeepTracker(lambda gallery, features: np.abs(gallery[-1][0] - features[:, 0]))
    for t in range(4):
        rows = tracker.step([(0.0, 0.0, 10.0, 10.0, 0.9, [1.0]), (50.0, 0.0, 60.0, 10.0, 0.9, [9.0])])
    assert [r[0] for r in rows] == [1, 2]
