"""Exports for other evaluators: annotation documents, image lists, reports, rotated logs, streamed result rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewake.sources import files


def numbered_classes(names: list[str], numbers: DataFrame) -> DataFrame:
    """numbers' rows with ``listed``, the place of their cls in names from 0; an unknown name raises."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("cls")) - 1
    unknown = F.raise_error(F.concat(F.lit("no such class: "), F.col("cls"))).cast("long")
    return numbers.withColumn("listed", F.when(place < 0, unknown).otherwise(place).cast("int"))


def coco_annotations(truth: DataFrame, names: list[str], order: str = "gt") -> DataFrame:
    """Annotation rows of truth (frame, cls, difficult, x1..y2).

    Categories are listed from 0 but annotations count them from 1, and ten is taken off the area:
    both as the evaluators that read these documents expect.
    """
    rows = numbered_classes(names, truth)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # Numbers without one long window: by picture, behind the counts of the pictures before it.
    counts = truth.groupBy("frame").agg(F.count("*").alias("n"))
    before = counts.select("frame", F.coalesce(F.sum("n").over(W.orderBy("frame").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("frame").orderBy(order)) - 1
    numbered = rows.withColumn("own", own).join(before, "frame")
    return numbered.select((F.col("before") + F.col("own")).cast("long").alias("id"), F.col("frame").alias("image_id"), (F.col("listed") + 1).alias("category_id"), F.col("difficult").cast("int").alias("iscrowd"), F.array("x1", "y1", w, h).alias("bbox"), (w * h - 10.0).alias("area"))


def coco_results(found: DataFrame, names: list[str]) -> DataFrame:
    """Result rows of detections (frame, cls, conf, x1..y2)."""
    box = F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return numbered_classes(names, found).select(F.col("frame").alias("image_id"), (F.col("listed") + 1).alias("category_id"), box.alias("bbox"), F.col("conf").alias("score"))


def write_coco(truth: DataFrame, found: DataFrame, names: list[str], path: str) -> None:
    """path/images, categories, annotations and results, each as lines of JSON; parts of any size."""
    spark = truth.sparkSession
    image = truth.select("frame").distinct().select(F.concat(F.col("frame").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.col("frame").alias("id"))
    listed = spark.createDataFrame([(n, n, i) for i, n in enumerate(names)], "supercategory string, name string, id int")
    for name, rows in (("images", image), ("categories", listed), ("annotations", coco_annotations(truth, names)), ("results", coco_results(found, names))):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def image_lists(parts: DataFrame) -> DataFrame:
    """(list, name) of images dealt to parts (id, part): trainval holds train and val."""
    both = parts.filter("part <> 'test'").select(F.lit("trainval").alias("list"), F.col("id").cast("string").alias("name"))
    return parts.select(F.col("part").alias("list"), F.col("id").cast("string").alias("name")).unionAll(both)


def write_image_lists(parts: DataFrame, path: str) -> None:
    """path/list=<train|val|test|trainval>: a name per line."""
    image_lists(parts).write.mode("overwrite").partitionBy("list").text(path)


def members(images: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """The images (id) that a list holds."""
    return images.join(lists.filter(F.col("list") == name).select(F.col("name").alias("__name")), F.col("id").cast("string") == F.col("__name"), "left_semi")


def annotation_lines(boxes: DataFrame, folder: str, ending: str = ".png") -> DataFrame:
    """``path x1,y1,x2,y2,cls ...``, a line per image of boxes (id, n, x1..y2, cls)."""
    one = F.concat_ws(",", *[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2", "cls")])
    listed = boxes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", one.alias("box")))).alias("all"))
    return listed.select("id", F.concat_ws(" ", F.concat(F.lit(folder + "/"), F.col("id").cast("string"), F.lit(ending)), F.transform("all", lambda b: b["box"])).alias("line"))


def report_lines(average: DataFrame, points: DataFrame, counts: DataFrame) -> DataFrame:
    """The text report of an evaluation: per class its average precision and curve, then truths and detections per class.

    average: cls, ap; points: cls, rank, rec, prec; counts: cls, n_gt, n_found, tp.
    """
    two = lambda c: F.format_number(c, 2)
    curve = points.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("rank", two("prec").alias("p"), two("rec").alias("r")))).alias("c"))
    listed = lambda k: F.concat(F.lit("["), F.concat_ws(", ", F.transform("c", lambda x: x[k])), F.lit("]"))
    per_class = average.join(curve, "cls", "left").join(counts, "cls", "left")
    head = F.concat(two(F.col("ap") * 100), F.lit("% = "), F.col("cls"), F.lit(" AP"))
    wrong = F.col("n_found") - F.coalesce("tp", F.lit(0))
    text = F.concat_ws(
        "\n", head, F.concat(F.lit(" Precision: "), listed("p")), F.concat(F.lit(" Recall: "), listed("r")),
        F.concat(F.lit(" Ground truth: "), F.col("n_gt")), F.concat(F.lit(" Detected: "), F.col("n_found"), F.lit(" (tp:"), F.coalesce("tp", F.lit(0)), F.lit(", fp:"), wrong, F.lit(")")),
    )
    return per_class.select("cls", text.alias("text"))


def write_summary(scores: DataFrame, path: str) -> None:
    """A table of scores as CSV with a header, sequences in order."""
    scores.orderBy("sequence").write.mode("overwrite").csv(path, header=True)


def rotated_log(labels: DataFrame, seconds: int = 60) -> DataFrame:
    """labels (ts, ...) with ``file``, the name of the log that their time falls into; each covers so many seconds."""
    start = F.window("ts", f"{seconds} seconds")["start"]
    return labels.withColumn("file", F.concat(F.date_format(start, "yyyy-MM-dd HH-mm-ss"), F.lit(".json")))


def write_rotated_log(labels: DataFrame, path: str, seconds: int = 60) -> None:
    """A folder per log file; its frames are lines of JSON, so no log is gathered in one row."""
    box = F.struct("bbox_id", "top", "left", "width", "height", F.col("labels"))
    per_box = rotated_log(labels, seconds).groupBy("file", "frame_id", "ts", "bbox_id", "top", "left", "width", "height").agg(F.array_sort(F.collect_list(F.struct("category", "confidence"))).alias("labels"))
    frames = per_box.groupBy("file", "frame_id", F.col("ts").alias("timestamp")).agg(F.array_sort(F.collect_list(box)).alias("bboxes"))
    frames.write.mode("overwrite").partitionBy("file").json(path)


def mot_sink(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A streaming writer that appends each batch's MOT rows; a batch that runs again replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        files.write_mot(batch, f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def timed(step: Callable) -> Callable:
    """step, which notes the seconds that its calls took in ``step.seconds``."""

    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return step(*args, **kwargs)
        finally:
            run.seconds.append(time.perf_counter() - began)

    run.seconds = []
    return run


def time_stats(times: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population deviation and number of the times of each key."""
    return times.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))
