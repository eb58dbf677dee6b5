"""Track motion, occlusion, bindings and layout as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake import config as C
from tidewake.functions import boxes as B
from tidewake.functions import trajectory as Tr


def speeds(points: DataFrame) -> DataFrame:
    """points (id, tick, x, y) with vx, vy against the oldest of the five ticks before; none: 0."""
    w = W.partitionBy("id").orderBy("tick").rangeBetween(-5, -1)
    old = F.min_by(F.struct("tick", "x", "y"), "tick").over(w)
    gap = F.col("tick") - old["tick"]
    return points.withColumn("vx", F.coalesce((F.col("x") - old["x"]) / gap, F.lit(0.0))).withColumn("vy", F.coalesce((F.col("y") - old["y"]) / gap, F.lit(0.0)))


def displacement(points: DataFrame) -> DataFrame:
    """Per id and tick the step from tick-2 to tick-1, where both are there."""
    w = W.partitionBy("id").orderBy("tick")
    one, two = F.lag(F.struct("tick", "x", "y"), 1).over(w), F.lag(F.struct("tick", "x", "y"), 2).over(w)
    whole = (one["tick"] == F.col("tick") - 1) & (two["tick"] == F.col("tick") - 2)
    return points.withColumn("whole", whole).withColumn("dx", one["x"] - two["x"]).withColumn("dy", one["y"] - two["y"]).filter("whole").drop("whole")


def stable_ids(points: DataFrame, ticks: int = 5) -> DataFrame:
    """Ids seen at each of the last ``ticks`` ticks up to this one."""
    w = W.partitionBy("id").orderBy("tick").rangeBetween(-(ticks - 1), 0)
    return points.withColumn("n", F.count("*").over(w)).filter(F.col("n") == ticks).drop("n")


def shifted(box: dict, vx: Column, vy: Column, seconds: Column) -> dict:
    """A box moved at constant velocity."""
    return {"x1": box["x1"] + vx * seconds, "y1": box["y1"] + vy * seconds, "x2": box["x2"] + vx * seconds, "y2": box["y2"] + vy * seconds}


def first_overlap(frames: DataFrame, rate: float = 0.0) -> DataFrame:
    """Each box with the first later box of its frame that it overlaps by more than rate of either area."""
    a, b = frames.alias("a"), frames.alias("b")
    on = (F.col("a.frame") == F.col("b.frame")) & (F.col("b.det") > F.col("a.det")) & B.overlaps_either(B.columns("a."), B.columns("b."), rate)
    return a.join(b, on).groupBy("a.frame", "a.det").agg(F.min("b.det").alias("partner"))


def outside_areas(detections: DataFrame, areas: DataFrame) -> DataFrame:
    """Detections whose centre lies in no area of their frame."""
    x, y = B.center(*[F.col(f"d.{c}") for c in ("x1", "y1", "x2", "y2")])
    on = (F.col("d.frame") == F.col("o.frame")) & B.point_in_box(x, y, B.columns("o."))
    return detections.alias("d").join(areas.alias("o"), on, "left_anti")


def iou_pairs(frames: DataFrame, least: float, pixel: float = 0.0) -> DataFrame:
    """Pairs of a frame's boxes with at least this IoU; bounded by the equi-join on the frame."""
    a, b = frames.alias("a"), frames.alias("b")
    value = B.iou(B.columns("a."), B.columns("b."), pixel)
    return a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.det") < F.col("b.det"))).select("a.frame", F.col("a.det").alias("det_a"), F.col("b.det").alias("det_b"), value.alias("iou")).filter(F.col("iou") >= least)


def suppress(frames: DataFrame, score: str = "score", most: float = C.DETECTOR_NMS, least_score: float = C.DETECTOR_SCORE) -> DataFrame:
    """Greedy non-maximum suppression per frame as one fold over its boxes in order of score."""
    fields = ("x1", "y1", "x2", "y2", score, "det")
    listed = frames.filter(F.col(score) >= least_score).groupBy("frame").agg(F.collect_list(F.struct((-F.col(score)).alias("rank"), "det", *[F.col(c).alias(c) for c in fields if c != "det"])).alias("all"))
    kind = listed.schema["all"].dataType.simpleString()
    get = lambda s: {k: s[k] for k in ("x1", "y1", "x2", "y2")}
    kept = F.aggregate(F.array_sort("all"), F.array().cast(kind), lambda k, b: F.when(F.exists(k, lambda o: B.iou(get(o), get(b)) > most), k).otherwise(F.array_append(k, b)))
    return listed.select("frame", F.explode(kept).alias("b")).select("frame", "b.det", *[f"b.{c}" for c in ("x1", "y1", "x2", "y2")], f"b.{score}")


def detections_of(predictions: DataFrame, size: int = C.DETECTOR_SIZE) -> DataFrame:
    """Detector rows (frame, width, height, det, cx, cy, w, h, obj, cls) to boxes in picture pixels."""
    corners = predictions.select("frame", "width", "height", "det", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"), (F.col("obj") * F.col("cls")).alias("score"))
    kept = suppress(corners).join(corners.select("frame", "det", "width", "height"), ["frame", "det"])
    values = B.unletterbox(B.columns(), F.col("width"), F.col("height"), size)
    return kept.select("frame", "det", "score", *[v.alias(n) for v, n in zip(values, ("x1", "y1", "x2", "y2"))])


def trajectories(points: DataFrame) -> DataFrame:
    """(id, way): each id's points in order of their ordinal."""
    return points.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("way"))


def pair_gate(pairs: DataFrame, gate: float) -> DataFrame:
    """Pairs (track, vessel: ways) with end points nearer than the gate and headings less than 5/6 pi apart."""
    a, b = F.element_at("track", -1), F.element_at("vessel", -1)
    end = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    found = pairs.withColumn("end_distance", end).withColumn("angle", Tr.heading_angle(F.col("track"), F.col("vessel")))
    return found.filter((F.col("end_distance") < gate) & (F.col("angle") < C.MAX_HEADING_DIFF * 3.141592653589793))


def pair_costs(pairs: DataFrame, bound: DataFrame) -> DataFrame:
    """pairs (track_id, mmsi, score) with cost: bound pairs by their count, either side bound elsewhere unreachable."""
    held = bound.filter(F.col("matches") > C.BIND_AFTER)
    both = pairs.join(held.select("track_id", "mmsi", "matches"), ["track_id", "mmsi"], "left")
    both = both.join(held.select("track_id", F.lit(True).alias("t_held")).distinct(), "track_id", "left").join(held.select("mmsi", F.lit(True).alias("v_held")).distinct(), "mmsi", "left")
    cost = F.when(F.col("matches").isNotNull(), C.BOUND_FACTOR * F.col("matches")).when(F.col("t_held") | F.col("v_held"), F.lit(C.UNREACHABLE)).otherwise(F.coalesce("score", F.lit(C.UNREACHABLE)))
    return both.select("track_id", "mmsi", cost.alias("cost"))


def fused_rows(tracks: DataFrame, matches: DataFrame, outer: bool = True) -> DataFrame:
    """Tracks with their matched vessel: every track, or matched ones only."""
    return tracks.join(matches, ["frame", "track_id"], "left" if outer else "inner")


def panel_layout(panels: DataFrame, width: int, height: int) -> DataFrame:
    """Panels (frame, id, x, has_ais) side by side in order of x: (x1, x2) with a line's gap between."""
    gap = round(0.001 * (width + height)) + 2
    size = F.when(F.col("has_ais"), width // 12).otherwise(width // 15)
    before = F.coalesce(F.sum(size + gap).over(W.partitionBy("frame").orderBy("x", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return panels.withColumn("x1", before + gap).withColumn("x2", F.col("x1") + size)


def newest(rows: DataFrame, key: str, order: str, budget: int = C.DEEP_BUDGET) -> DataFrame:
    """The newest ``budget`` rows of each key."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= budget).drop("r")


def split_sets(images: DataFrame, trainval: float = C.SPLIT_TRAINVAL, train: float = C.SPLIT_TRAIN) -> DataFrame:
    """images (id) dealt to train, val and test by a fixed residue of the id."""
    part = F.pmod(F.col("id") * 7919, F.lit(10_000)) / 10_000.0
    return images.withColumn("part", F.when(part >= trainval, "test").when(part >= trainval * train, "val").otherwise("train"))


def trails(points: DataFrame, last: int = 10) -> DataFrame:
    """points (id, tick, x, y) with the number of the id's points so far and its last ones' sums."""
    w = W.partitionBy("id").orderBy("tick")
    tail = w.rowsBetween(1 - last, 0)
    return points.withColumn("n", F.count("*").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("last_x", F.sum("x").over(tail)).withColumn("last_y", F.sum("y").over(tail))


def nearest_in_gate(tracks: DataFrame, vessels: DataFrame, gate: float) -> DataFrame:
    """Each track's nearest vessel of its run and tick within the gate, claimed or not."""
    dx, dy = F.col("t.x") - F.col("v.x"), F.col("t.y") - F.col("v.y")
    both = tracks.alias("t").join(vessels.alias("v"), ["run_id", "tick_ms"]).select("run_id", "tick_ms", "t.track_id", "v.mmsi", F.sqrt(dx * dx + dy * dy).alias("d"))
    best = both.filter(F.col("d") <= gate).groupBy("run_id", "tick_ms", "track_id").agg(F.min(F.struct("d", "mmsi")).alias("m"))
    return best.select("run_id", "tick_ms", "track_id", F.col("m.mmsi").alias("mmsi"), F.col("m.d").alias("distance"))


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: the key and the order's columns."""
    return rows.groupBy(key).agg(F.min(F.struct(*order)).alias("m")).select(key, *[F.col(f"m.{c}") for c in order])


def suppress_covered(frames: DataFrame, score: str = "score", most: float = 0.5) -> DataFrame:
    """Suppression by cover: a box goes if one of higher score covers more than ``most`` of its own area, corners counted."""
    listed = frames.groupBy("frame").agg(F.collect_list(F.struct((-F.col(score)).alias("rank"), (-F.col("det")).alias("turn"), "x1", "y1", "x2", "y2", "det")).alias("all"))
    kind = listed.schema["all"].dataType.simpleString()
    get = lambda s: {k: s[k] for k in ("x1", "y1", "x2", "y2")}
    covers = lambda o, b: B.overlap_area(get(o), get(b), 1.0) / B.area(get(b), 1.0) > most
    kept = F.aggregate(F.array_sort("all"), F.array().cast(kind), lambda k, b: F.when(F.exists(k, lambda o: covers(o, b)), k).otherwise(F.array_append(k, b)))
    return listed.select("frame", F.explode(kept).alias("b")).select("frame", "b.det")


def active_only(galleries: DataFrame, active: DataFrame, key: str = "track_id") -> DataFrame:
    """Gallery rows of the tracks that are active."""
    return galleries.join(active.select(key).distinct(), key, "left_semi")
