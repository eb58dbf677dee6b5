import pytest
from pyspark.sql import functions as F

from tidewake.functions import boxes as B
from tidewake.functions import geo
from tidewake.operators import hosting, motion
from tidewake.plans.run import RunConfig, run
from tidewake.sources import files
from tidewake.streaming import hosts

T0 = 1609502400000
ROWS = """mmsi,lon,lat,speed,course,heading,type,timestamp
431234567,121.508287,29.870000,8.0,270,270,70,1609502400000
431987654,121.515199,29.872812,12.0,90,90,80,1609502400000

431555001,121.500000,29.878115,6.0,180,180,70,1609502400000
431222999,121.546617,29.870000,10.0,270,270,70,1609502400000
"""


@pytest.fixture
def clip(tmp_path):
    (tmp_path / "ais").mkdir()
    (tmp_path / "ais" / "2021_01_01_12_00_00.csv").write_text(ROWS)
    (tmp_path / "camera.txt").write_text("[121.5,29.87,90,5,20,55,35,1500,1500,960,540]\n")
    return tmp_path


def test_sample_run(spark, clip):
    result = run(spark, f"{clip}/ais", f"{clip}/camera.txt", RunConfig(T0, 3, 60_000))
    got = {(r["mmsi"], (r["tick_ms"] - T0) // 60_000): (r["x"], r["y"]) for r in result.sightings.filter("class = 'Transform'").collect()}
    assert got == {(431234567, 0): (959, 709), (431234567, 1): (959, 726), (431234567, 2): (960, 770), (431987654, 0): (638, 691), (431987654, 1): (703, 687), (431987654, 2): (746, 684)}
    assert result.tracks.count() == 0 and result.mot_rows("fusion").count() == 0


@pytest.mark.parametrize("fusion", ["trajectory", "nearest"])
def test_boxes_are_fused_and_written(spark, clip, fusion):
    boxes = spark.createDataFrame([(T0, 0, 930.0, 680.0, 990.0, 720.0), (T0, 1, 100.0, 650.0, 160.0, 690.0)], "tick_ms long, det int, x1 double, y1 double, x2 double, y2 double")
    result = run(spark, f"{clip}/ais", f"{clip}/camera.txt", RunConfig(T0, 1, fusion=fusion), boxes, f"{clip}/out")
    assert result.fused.filter("track_id = 1").head()["mmsi"] == 431234567
    written = {kind: [tuple(int(v) for v in r) for r in spark.read.csv(f"{clip}/out/{kind}").collect()] for kind in ("detection", "tracking", "fusion")}
    assert (1, 431234567, 930, 680, 60, 40, 1, 1, 1, 1) in written["fusion"]
    assert {r[1] for r in written["detection"]} == {0} and {r[1] for r in written["tracking"]} == {1, 2}
    assert result.response().count() == 1
    with pytest.raises(ValueError):
        RunConfig(T0, 0)


def test_message_files(spark, clip):
    (clip / "ais" / "2021_01_01_20_00_01.csv").write_text(",mmsi,lon,lat,speed,course,heading,type,timestamp\n0,431234567,121.5,29.87,5,45,47,30,1609502401000\n")
    got = files.read_ais(spark, f"{clip}/ais")
    assert got.count() == 5 and got.filter("ts_ms = 1609502401000").head()["course"] == 45.0
    assert files.read_ais(spark, f"{clip}/none").count() == 0
    assert files.read_ais(spark, f"{clip}/ais/2021_01_01_20_00_01.csv", 8).head()["tick"].isoformat() == "2021-01-01T12:00:01"
    (clip / "ais" / "2021_01_01_12_00_02.csv").write_text("mmsi,lon\n1,2\n")
    with pytest.raises(Exception, match="missing columns"):
        files.read_ais(spark, f"{clip}/ais").collect()


def test_camera_text(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1,2,3,4,5,6,7,8,9,10,11")
    assert list(files.read_camera(spark, f"{tmp_path}/c.txt")) == [float(i) for i in range(1, 12)]
    (tmp_path / "c.txt").write_text("[1,2,3]")
    with pytest.raises(ValueError):
        files.read_camera(spark, f"{tmp_path}/c.txt")


def test_text_formats(spark, tmp_path):
    lines = spark.createDataFrame([("fishing boat 1 2 3 4 difficult",), ("ship 5 6 7 8",)], "value string")
    assert [tuple(r) for r in files.eval_rows(lines, False).collect()] == [("fishing boat", True, 1, 2, 3, 4), ("ship", False, 5, 6, 7, 8)]
    found = files.eval_rows(spark.createDataFrame([("fishing boat 0.9 1 2 3 4",)], "value string"), True)
    assert tuple(found.head()) == ("fishing boat", 0.9, 1, 2, 3, 4)
    boxes = files.annotation_boxes(spark.createDataFrame([("a/b.jpg 1,2,3,4,0 5,6,7,8,1",), ("c.jpg",)], "value string"))
    assert [(r["path"], r["x1"], r["cls"]) for r in boxes.collect()] == [("a/b.jpg", 1.0, 0), ("a/b.jpg", 5.0, 1)]
    (tmp_path / "v.xml").write_text("<annotation><object><name>ship</name><difficult>0</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>boat</name><bndbox><xmin>5</xmin><ymin>6</ymin><xmax>7</xmax><ymax>8</ymax></bndbox></object></annotation>")
    assert [(r["name"], r["x2"]) for r in files.read_voc(spark, f"{tmp_path}/v.xml").collect()] == [("ship", 3.0), ("boat", 7.0)]
    (tmp_path / "names.txt").write_text("ship\nboat\n")
    assert [tuple(r) for r in files.read_classes(spark, f"{tmp_path}/names.txt").collect()] == [(0, "ship"), (1, "boat")]
    (tmp_path / "MOT16-gt.txt").write_text("0,1,1,2,3,4,1,1,1\n1,1,1,2,3,4,1,1,1\n1,2,1,2,3,4,0,1,1\n1,3,1,2,3,4,1,7,1\n")
    assert [r["id"] for r in files.read_mot(spark, f"{tmp_path}/MOT16-gt.txt", truth=True).collect()] == [1]
    rows = spark.createDataFrame([(1, 5, 1, 2, 3, 4), (1, -1, 1, 2, 3, 4)], "frame int, id int, x int, y int, w int, h int")
    assert [r[0] for r in files.mot_lines(rows).collect()] == ["1,5,1,2,3,4,-1,-1,-1,-1"]
    assert files.mot_lines(rows, "kitti").head()[0].startswith("0 5 pedestrian 0 0 -10 1 2 4 6")


def test_json_log(spark):
    rows = spark.createDataFrame([(1, 10, 1, "a", 0.9, 1, 2, 3, 4), (1, 10, 1, "b", 0.5, 1, 2, 3, 4), (1, 10, 2, "a", 0.7, 5, 6, 7, 8)], "frame_id int, ts int, bbox_id int, category string, confidence double, top int, left int, width int, height int")
    doc = files.json_log(rows, {"name": "v"}, top_k=1).head()
    assert [[len(b["labels"]) for b in f["bboxes"]] for f in doc["frames"]] == [[1, 1]]
    twice = rows.union(rows.limit(1).withColumn("top", F.lit(99)))
    with pytest.raises(Exception, match="twice"):
        files.json_log(twice, {"name": "v"}).collect()


def test_video_frames(spark):
    frames = spark.createDataFrame([(1, i * 100) for i in range(50)], "video_id int, pos_ms long")
    wanted = spark.createDataFrame([(1, 0), (1, 1000), (1, 2500), (1, -1000), (1, 10_000)], "video_id int, want_ms long")
    assert sorted((r["want_ms"], r["pos_ms"]) for r in files.nearest_frames(wanted, frames).collect()) == [(0, 0), (1000, 1000), (2500, 2500)]


def test_detector_rows(spark):
    rows = [(320, 320, 100, 50, 0.9, 0.9), (322, 321, 100, 50, 0.8, 0.8), (100, 200, 40, 20, 0.7, 0.9), (500, 400, 60, 30, 0.5, 0.5), (630, 150, 40, 20, 0.9, 0.6)]
    df = spark.createDataFrame([(1, 1280, 720, i, *map(float, r)) for i, r in enumerate(rows)], "frame int, width int, height int, det int, cx double, cy double, w double, h double, obj double, cls double")
    got = [tuple(int(r[c]) for c in ("x1", "y1", "x2", "y2")) for r in motion.detections_of(df).orderBy(F.desc("score")).collect()]
    assert got == [(540, 310, 740, 410), (160, 100, 240, 140), (1220, 0, 1280, 40)]


def test_mot_clamps(spark):
    row = spark.range(1).select(*B.mot_row(F.lit(-40.0), F.lit(-30.0), F.lit(1960.0), F.lit(1120.0), 1920, 1080)).head()
    assert tuple(row) == (0, 0, 1920, 1080)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, T0 + 1000 * t, 431000000 + v, 0, 121.508 + v * 1e-4, 29.87, 8.0, 270.0, 511.0, 70, T0 + 1000 * t) for t in range(6) for v in range(3) if (t + v) % 2 == 0]
    beats = [(1, T0 + 1000 * t, 431000000 + v, 0, None, None, None, None, None, None, None) for t in range(6) for v in range(3)]
    schema = "run_id long, tick_ms long, mmsi long, ord int, lon double, lat double, speed double, course double, heading double, ship_type int, ts_ms long"
    for t in range(3):
        part = [r for r in rows + beats if (r[1] - T0) // 2000 == t]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = hosts.sight_vessels_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 1000, geo.SAMPLE_CAMERA)
    q = stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = hosting.sight_vessels(spark.createDataFrame(rows, schema), (T0, 6, 1000), geo.SAMPLE_CAMERA)
    assert sorted(map(str, spark.table("seen").collect())) == sorted(map(str, batch.collect()))
