"""Readers and writers of the domain's file formats, as Spark scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.geo import Camera

AIS_COLUMNS = {"mmsi": "long", "lon": "double", "lat": "double", "speed": "double", "course": "double", "heading": "double", "type": "int", "timestamp": "long"}
STAMP = "yyyy_MM_dd_HH_mm_ss"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    return whole.select("file", F.split("value", r"\r?\n").alias("lines"))


def read_ais(spark: SparkSession, path: str, utc_offset_hours: float = 0.0) -> DataFrame:
    """Per-second message files <yyyy_MM_dd_HH_mm_ss>.csv, columns bound by header name file by file.

    Extra columns (such as an unnamed index) are ignored, blank lines skipped, no file gives no
    rows; a file without a needed column, or a field that does not parse, raises.
    """
    try:
        files = _lines(spark, path)
    except Exception as error:  # the path's absence is an empty second, anything else is an error
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fields = ", ".join(f"{'ship_type' if c == 'type' else 'ts_ms' if c == 'timestamp' else c} {t}" for c, t in AIS_COLUMNS.items())
        return spark.createDataFrame([], f"file string, tick timestamp, ord int, {fields}")
    head = F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda c: F.trim(c))
    rows = files.select("file", head.alias("head"), F.posexplode("lines").alias("ord", "line")).filter("ord > 0 AND trim(line) <> ''")
    absent = [F.when(~F.array_contains("head", c), F.lit(c)) for c in AIS_COLUMNS]
    checked = rows.withColumn("absent", F.array_compact(F.array(*absent)))
    known = F.when(F.size("absent") > 0, F.raise_error(F.concat_ws(" ", F.lit("missing columns in"), F.col("file"), F.concat_ws(",", "absent"))).cast("map<string,string>")).otherwise(F.map_from_arrays("head", F.transform(F.split("line", ","), lambda c: F.trim(c))))
    named = checked.withColumn("row", known)
    tick = F.to_timestamp(F.regexp_replace("file", r"\.csv$", ""), STAMP) - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {utc_offset_hours * 3600})")
    rename = {"type": "ship_type", "timestamp": "ts_ms"}
    return named.select("file", tick.alias("tick"), "ord", *[F.col("row")[c].cast(kind).alias(rename.get(c, c)) for c, kind in AIS_COLUMNS.items()])


def read_camera(spark: SparkSession, path: str) -> Camera:
    """One line of eleven comma-separated numbers, brackets optional."""
    text = spark.read.text(path, wholetext=True).head()[0]
    values = [float(x) for x in text.strip().strip("[]").split(",")]
    if len(values) != 11:
        raise ValueError(f"a camera has 11 values, found {len(values)}")
    return Camera(*values)


def ticks(spark: SparkSession, start_ms: int, count: int, step_ms: int = 1000) -> DataFrame:
    """(frame, tick_ms) for i in 0..count-1."""
    if count <= 0 or step_ms <= 0:
        raise ValueError("count and step must be positive")
    return spark.range(count).select(F.col("id").cast("int").alias("frame"), (F.lit(start_ms) + F.col("id") * step_ms).alias("tick_ms"))


def nearest_frames(positions: DataFrame, frames: DataFrame, tolerance_ms: int = 20) -> DataFrame:
    """The first frame (video_id, pos_ms) at or after each wanted position less the tolerance; none past the end."""
    wanted = positions.select("video_id", "want_ms", F.floor((F.col("want_ms") - tolerance_ms) / 1000).alias("s"))
    # Frames stand in their second and the one before, so each position meets a few frames only.
    near = frames.select("video_id", "pos_ms", F.explode(F.array(F.floor(F.col("pos_ms") / 1000), F.floor(F.col("pos_ms") / 1000) - 1)).alias("s"))
    return wanted.join(near, ["video_id", "s"]).filter((F.col("want_ms") >= 0) & (F.col("pos_ms") + tolerance_ms >= F.col("want_ms"))).groupBy("video_id", "want_ms").agg(F.min("pos_ms").alias("pos_ms"))


def clip_start(name: str):
    """Start second of a clip, out of its file name's tokens."""
    return F.to_timestamp(F.regexp_extract(name, r"(\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2})", 1), STAMP)


MOT_SCHEMA = "frame int, id int, x double, y double, w double, h double, score double, label int, visibility double"


#: Labels that truth counts, and those whose boxes are ignored.
TRUE_LABELS, IGNORED_LABELS = (1,), (2, 7, 8, 12)


def read_mot(spark: SparkSession, path: str, truth: bool = False, ignored: bool = False) -> DataFrame:
    """MOT text; frames below 1 are dropped.

    Only files with MOT16- or MOT17- in their path have marks and labels: of those, ground truth
    keeps marked rows of true labels, ``ignored`` the rows of ignored labels or negative visibility;
    of other files truth keeps all rows and ``ignored`` none.
    """
    rows = spark.read.schema(MOT_SCHEMA).csv(path).select("*", F.col("_metadata.file_path").rlike("MOT1[67]-").alias("__marked")).filter("frame >= 1")
    if truth:
        rows = rows.filter(~F.col("__marked") | ((F.col("score").cast("int") != 0) & F.col("label").isin(*TRUE_LABELS)))
    elif ignored:
        rows = rows.filter(F.col("__marked") & (F.col("label").isin(*IGNORED_LABELS) | (F.col("visibility") < 0)))
    return rows.drop("__marked")


def kept_labels(rows: DataFrame, wanted: tuple, ignored: tuple, column: str = "label") -> DataFrame:
    """Rows of wanted labels that are not ignored ones."""
    return rows.filter(F.col(column).isin(*wanted) & ~F.col(column).isin(*ignored))


def write_mot(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """frame, id, x, y, w, h and four ones, ordered, without header."""
    ones = [F.lit(1).alias(f"one{i}") for i in range(4)]
    rows.select("frame", "id", "x", "y", "w", "h", *ones).orderBy("frame", "id").coalesce(1).write.mode(mode).csv(path, header=False)


def mot_lines(rows: DataFrame, kind: str = "mot") -> DataFrame:
    """Result lines for MOT (-1 filler) or KITTI (frame from 0, corners); negative ids are skipped."""
    kept = rows.filter("id >= 0")
    if kind == "mot":
        return kept.select(F.concat_ws(",", "frame", "id", "x", "y", "w", "h", *[F.lit("-1")] * 4).alias("line"))
    if kind == "kitti":
        return kept.select(F.concat_ws(" ", F.col("frame") - 1, "id", F.lit("pedestrian"), F.lit("0"), F.lit("0"), F.lit("-10"), "x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"), *[F.lit(v) for v in ("-10", "-10", "-10", "-1000", "-1000", "-1000", "-10")]).alias("line"))
    raise ValueError(f"no such kind: {kind}")


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, difficult, x1, y1, x2, y2) of the objects in annotation XML files."""
    obj = "struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_xml("value", f"object array<{obj}>").alias("x"))
    return whole.select("file", F.explode("x.object").alias("o")).select("file", "o.name", F.coalesce("o.difficult", F.lit(0)).alias("difficult"), *[F.col(f"o.bndbox.{a}").alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))])


def annotation_boxes(lines: DataFrame, column: str = "value") -> DataFrame:
    """``path x1,y1,x2,y2,cls ...`` lines to a row per box."""
    parts = F.split(F.trim(column), r"\s+")
    rows = lines.select(F.get(parts, F.lit(0)).alias("path"), F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("n", "box"))
    v = F.split("box", ",")
    return rows.select("path", "n", *[F.get(v, F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.get(v, F.lit(4)).cast("int").alias("cls"))


def eval_rows(lines: DataFrame, found: bool, column: str = "value") -> DataFrame:
    """Evaluation text lines, split from the right as class names may hold spaces.

    Truth: ``class l t r b [difficult]``; found: ``class confidence l t r b``.
    """
    parts = F.split(F.trim(column), r"\s+")
    hard = F.lit(False) if found else F.element_at(parts, -1) == "difficult"
    core = F.when(hard, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = lines.select("*", hard.alias("difficult"), core.alias("__p"))
    n = 5 if found else 4
    values = [F.element_at("__p", -4 + i).cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    conf = [F.element_at("__p", -5).cast("double").alias("conf")] if found else ["difficult"]
    return rows.select(*[c for c in lines.columns if c != column], F.concat_ws(" ", F.slice("__p", 1, F.size("__p") - n)).alias("cls"), *conf, *values)


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(index, name) of a class list file, in line order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("index", "name")).select("index", F.trim("name").alias("name"))


def unmatched_files(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Files on one side only; an evaluation needs this to be empty."""
    a, b = truth.select("file").distinct(), found.select("file").distinct()
    return a.join(b, "file", "left_anti").withColumn("side", F.lit("truth")).union(b.join(a, "file", "left_anti").withColumn("side", F.lit("found")))


def json_log(labels: DataFrame, video: dict, top_k: int | None = None) -> DataFrame:
    """One document per video of frames, boxes and labels from rows frame_id, ts, bbox_id, box and label fields.

    A second box of the same id in a frame raises, as do labels beyond ``top_k`` get dropped by confidence.
    """
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("frame_id", "bbox_id").orderBy(F.desc("confidence"), "category"))
    rows = labels.withColumn("r", rank)
    rows = rows.filter(F.col("r") <= top_k) if top_k else rows
    per_box = rows.groupBy("frame_id", "ts", "bbox_id").agg(F.array_sort(F.collect_list(F.struct("r", "category", "confidence"))).alias("l"), F.countDistinct("top", "left", "width", "height").alias("n"), *[F.min(c).alias(c) for c in ("top", "left", "width", "height")])
    sure = F.when(F.col("n") > 1, F.raise_error(F.lit("a box id stands twice in a frame")).cast("int")).otherwise(F.col("bbox_id"))
    box = F.struct(F.transform("l", lambda x: F.struct(x["category"].alias("category"), x["confidence"].alias("confidence"))).alias("labels"), sure.alias("bbox_id"), "top", "left", "width", "height")
    per_frame = per_box.groupBy("frame_id", "ts").agg(F.array_sort(F.collect_list(F.struct("bbox_id", box.alias("b")))).alias("b"))
    frame = F.struct("frame_id", F.col("ts").alias("timestamp"), F.transform("b", lambda x: x["b"]).alias("bboxes"))
    details = F.struct(*[F.lit(v).alias(k) for k, v in video.items()])
    return per_frame.groupBy().agg(F.array_sort(F.collect_list(frame)).alias("frames")).select(details.alias("video_details"), "frames")
