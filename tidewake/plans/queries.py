"""Named queries over the test tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake import config as C
from tidewake.functions import boxes as B
from tidewake.functions import geo, vectors
from tidewake.functions import trajectory as Tr
from tidewake.functions import pictures
from tidewake.operators import evaluation, hosting, matching, motion, occlusion, vessels
from tidewake.plans import adapters as A
from tidewake.sources import exports, files

CAMERA = geo.SAMPLE_CAMERA
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with a tick per day instead of per hour."""
    return A.ais(spark, sf).withColumn("tick", F.floor(F.col("tick") / 24).cast("long"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """One integer point per vessel and day: (id, tick, x, y)."""
    d = _days(spark, sf).groupBy(F.col("mmsi").alias("id"), "tick").agg(F.min("event_id").alias("e"))
    return d.select("id", "tick", ((F.col("e") * 7919) % 1920).cast("int").alias("x"), ((F.col("e") * 104729) % 1080).cast("int").alias("y"))


# --- scans, projections and predicates of vessel messages ---------------------------------------


@query
def ais_valid_filter(spark, sf):
    return A.ais(spark, sf).filter(vessels.plausible()).select("event_id", "mmsi", "lon", "lat", "speed")


@query
def ais_bearing(spark, sf):
    b = geo.bearing_col(F.lit(CAMERA.lat), F.lit(CAMERA.lon), F.col("lat"), F.col("lon"))
    return A.ais(spark, sf).select("event_id", F.round(b, 4).alias("bearing"))


@query
def ais_distance_gate(spark, sf):
    valid = A.ais(spark, sf).filter(vessels.plausible())
    return vessels.in_range(vessels.from_camera(valid)).select("event_id", F.round("distance", 1).alias("distance"), F.round(geo.nautical(F.col("distance")), 3).alias("miles"))


@query
def ais_visibility_class(spark, sf):
    near = vessels.from_camera(A.ais(spark, sf))
    return near.select("event_id", geo.classify_col(CAMERA, F.col("distance"), F.col("bearing")).alias("class"))


@query
def ais_project_pixels(spark, sf):
    near = vessels.from_camera(A.ais(spark, sf)).withColumn("class", geo.classify_col(CAMERA, F.col("distance"), F.col("bearing"))).filter("class = 'Transform'")
    x, y = geo.project_col(CAMERA, F.col("distance"), F.col("bearing"))
    return near.select("event_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query
def ais_dead_reckoning(spark, sf):
    """Positions ten minutes on, along each message's course."""
    metres = F.col("speed") * (10 / 60) * C.NAUTICAL_MILE_M
    moved = A.ais(spark, sf).withColumn("to", geo.destination_col("lat", "lon", "course", metres))
    back = geo.distance_col(F.col("lat"), F.col("lon"), F.col("to.lat"), F.col("to.lon"))
    return moved.select("event_id", F.round(back - metres, 3).alias("error"), F.round(metres, 3).alias("metres"))


@query
def ais_sightings(spark, sf):
    """The whole second-by-second state machine, hourly, per vessel."""
    base = A.ais(spark, sf).withColumn("tick_ms", F.col("tick") * 3_600_000).withColumn("ord", F.col("event_id").cast("int"))
    first, last = base.agg(F.min("tick_ms"), F.max("tick_ms")).head()
    return hosting.sight_vessels(base, (first, int((last - first) // 3_600_000) + 1, 3_600_000), CAMERA)


# --- joins, windows and sets of vessel messages -------------------------------------------------


@query
def ais_last_per_vessel(spark, sf):
    return vessels.last_per_vessel(_days(spark, sf)).select("tick", "mmsi", "event_id", "speed")


@query
def ais_carry_anti(spark, sf):
    return vessels.carried(_days(spark, sf))


@query
def ais_asof_latest(spark, sf):
    days = _days(spark, sf)
    grid = days.select("mmsi").distinct().crossJoin(F.broadcast(days.select("tick").distinct()))
    return vessels.as_of(grid, days).select("tick", "mmsi", "event_id", "speed")


@query
def ais_jump_filter_pairwise(spark, sf):
    return vessels.without_jumps(A.ais(spark, sf)).select("event_id", "mmsi", "speed")


@query
def ais_history_window(spark, sf):
    return vessels.history(A.ais(spark, sf), 7200 * 6).select("event_id", "kept", "oldest")


@query
def ais_history_reset(spark, sf):
    base = A.ais(spark, sf).withColumn("class", F.when(F.col("event_id") % 7 == 0, "RemoveVisualTrack").otherwise("Transform"))
    return vessels.history_since_exit(base).select("event_id", "epoch", "points")


@query
def frame_second_gate(spark, sf):
    return vessels.second_gate(A.ais(spark, sf), 40).select("event_id", "ts_ms")


@query
def tick_tumbling_mean(spark, sf):
    """Means of days; numbers are added as their rows lie in the table, which is the order of the SQL."""
    e = A.table(spark, sf, "events").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place")).withColumn("ts", F.col("ts").cast("timestamp"))
    return vessels.tumbling_means(e, "user_id", ["value", "event_id"], "1 day", order="place").select("user_id", F.unix_seconds("start").alias("start"), "value", "event_id")


@query
def set_ops_ids(spark, sf):
    a = A.ais(spark, sf).filter("event_id % 2 = 0").select("mmsi").distinct()
    b = A.ais(spark, sf).filter("event_id % 3 = 0 AND speed > 20").select("mmsi").distinct()
    both = a.union(b).distinct().select("mmsi", F.lit("union").alias("op"))
    return both.union(a.exceptAll(b).select("mmsi", F.lit("except"))).union(a.join(b, "mmsi", "left_semi").select("mmsi", F.lit("semi"))).union(a.join(b, "mmsi", "left_anti").select("mmsi", F.lit("anti")))


@query
def process_time_stats(spark, sf):
    stats = exports.time_stats(A.table(spark, sf, "events"), "event_type", "value")
    return stats.select("event_type", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query
def vessel_trails(spark, sf):
    """Points of each vessel up to each day: count and last ten."""
    return motion.trails(_points(spark, sf)).select("id", "tick", "n", F.col("last_x").alias("last_ten_x"))


# --- boxes --------------------------------------------------------------------------------------


@query
def box_codecs(spark, sf):
    b = A.boxes(spark, sf)
    x, y, w, h = B.xyxy_to_tlwh(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    cx, cy, aspect, height = B.tlwh_to_xyah(x, y, w, h)
    left, top, right, bottom = B.xywh_to_xyxy_clamped(cx, cy, w, h, 640, 400)
    return b.select("frame", "det", w.alias("w"), h.alias("h"), cx.alias("cx"), cy.alias("cy"), F.round(aspect, 6).alias("aspect"), left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


@query
def letterbox_inverse(spark, sf):
    b = A.boxes(spark, sf).withColumn("pw", F.lit(1280)).withColumn("ph", F.lit(720))
    v = B.unletterbox(B.columns(), F.col("pw"), F.col("ph"))
    return b.select("frame", "det", *[c.alias(n) for c, n in zip(v, ("px1", "py1", "px2", "py2"))])


@query
def point_in_box(spark, sf):
    return A.boxes(spark, sf).filter(B.point_in_box(F.lit(300.0), F.lit(200.0), B.columns())).select("frame", "det")


@query
def iou_pairs(spark, sf):
    return motion.iou_pairs(A.boxes(spark, sf), 0.3).withColumn("iou", F.round("iou", 6))


@query
def iou_voc_pairs(spark, sf):
    return motion.iou_pairs(A.boxes(spark, sf), 0.3, 1.0).withColumn("iou", F.round("iou", 6))


@query
def giou_pairs(spark, sf):
    a, b = A.boxes(spark, sf).filter("det = 1").alias("a"), A.boxes(spark, sf).filter("det = 2").alias("b")
    return a.join(b, F.col("a.frame") == F.col("b.frame")).select("a.frame", F.round(B.giou(B.columns("a."), B.columns("b.")), 6).alias("giou"))


@query
def triangular_overlap_first(spark, sf):
    return motion.first_overlap(A.boxes(spark, sf), 0.2)


@query
def occlusion_anti_join(spark, sf):
    b = A.boxes(spark, sf)
    return motion.outside_areas(b.filter("det > 2"), b.filter("det <= 2")).select("frame", "det")


@query
def nms_greedy(spark, sf):
    return motion.suppress(A.boxes(spark, sf)).select("frame", "det", F.round("score", 4).alias("score"))


@query
def detector_postprocess(spark, sf):
    p = A.boxes(spark, sf).select("frame", F.lit(1280).alias("width"), F.lit(720).alias("height"), "det", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.col("score").alias("obj"), F.lit(1.0).alias("cls"))
    return motion.detections_of(p)


@query
def anchor_decode(spark, sf):
    b = A.boxes(spark, sf)
    cx, cy, w, h = B.anchor_decode(F.col("score"), F.col("score") / 2, F.col("score"), F.col("score") / 3, F.col("det"), F.col("frame") % 20, F.lit(8))
    return b.select("frame", "det", *[F.round(v, 4).alias(n) for v, n in ((cx, "cx"), (cy, "cy"), (w, "w"), (h, "h"))])


@query
def iou_tracker(spark, sf):
    b = A.boxes(spark, sf)
    ticks = b.select((F.col("frame") % 200).alias("run_id"), F.col("frame").alias("tick_ms"), "det", "x1", "y1", "x2", "y2")
    return hosting.track_boxes(ticks)


@query
def appearance_tracker(spark, sf):
    """The appearance tracker over short runs of jittered boxes, one-hot features by line."""
    b = A.boxes(spark, sf).withColumn("lines", F.max("det").over(W.partitionBy("frame")))
    steps = F.explode(F.sequence(F.lit(0), F.lit(5)))
    moved = b.select(F.col("frame").alias("run_id"), "det", "x1", "y1", "x2", "y2", "lines", steps.alias("t"))
    feature = F.transform(F.sequence(F.lit(1), F.greatest("lines", F.lit(3))), lambda i: F.when(F.col("det") == i, 1.0).otherwise(0.05))
    return hosting.track_appearances(moved.select("run_id", (F.col("t") * 1000).cast("long").alias("tick_ms"), "det", *[(F.col(c) + F.col("t") * 2).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0.9).alias("score"), feature.alias("feature")))


@query
def mot_detection_rows(spark, sf):
    b = A.boxes(spark, sf)
    return b.select((F.col("frame") + 1).alias("frame"), "det", F.lit(0).alias("id"), *B.mot_row(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], 640, 400))


@query
def mot_tracking_rows(spark, sf):
    b = A.boxes(spark, sf)
    return b.select((F.col("frame") + 1).alias("frame"), F.col("det").alias("id"), *B.mot_row(F.col("x1") - 40, F.col("y1") - 30, F.col("x2"), F.col("y2"), 640, 400))


def _matches(spark, sf):
    return A.boxes(spark, sf).filter("(frame + det) % 3 = 0").select("frame", F.col("det").alias("track_id"), (431000000 + F.col("frame") % 150).alias("mmsi"))


@query
def mot_fusion_rows(spark, sf):
    tracks = A.boxes(spark, sf).withColumnRenamed("det", "track_id")
    both = motion.fused_rows(tracks, _matches(spark, sf), outer=False)
    return both.select((F.col("frame") + 1).alias("frame"), "track_id", F.col("mmsi").alias("id"), *B.mot_row(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], 640, 400))


@query
def fused_left_outer(spark, sf):
    tracks = A.boxes(spark, sf).withColumnRenamed("det", "track_id")
    return motion.fused_rows(tracks, _matches(spark, sf)).select("frame", "track_id", F.coalesce("mmsi", F.lit(0)).cast("long").alias("mmsi"), "x1")


@query
def ignore_labels(spark, sf):
    b = A.boxes(spark, sf).withColumn("label", (F.col("det") % 7).cast("int"))
    return files.kept_labels(b, (1, 2, 3), (2,)).groupBy("label").agg(F.count("*").alias("n"))


# --- motion, trajectories and fusion ------------------------------------------------------------


@query
def speed_vector(spark, sf):
    return motion.speeds(_points(spark, sf)).select("id", "tick", F.round("vx", 4).alias("vx"), F.round("vy", 4).alias("vy"))


@query
def displacement_lag12(spark, sf):
    return motion.displacement(_points(spark, sf)).select("id", "tick", "dx", "dy")


@query
def stable_ids_5(spark, sf):
    return motion.stable_ids(_points(spark, sf)).select("id", "tick")


@query
def motion_shift(spark, sf):
    b = A.boxes(spark, sf)
    moved = motion.shifted(B.columns(), F.col("det").cast("double"), -F.col("det") / 2, F.lit(2.0))
    return b.select("frame", "det", *[v.alias(f"to_{k}") for k, v in moved.items()])


def _ways(spark, sf):
    return motion.trajectories(_points(spark, sf).select("id", F.col("tick").alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))


@query
def trajectory_collect(spark, sf):
    return _ways(spark, sf).select("id", F.size("way").alias("n"), F.element_at("way", 1)["x"].alias("first_x"), F.element_at("way", -1)["y"].alias("last_y"))


@query
def trajectory_halve(spark, sf):
    return _ways(spark, sf).select("id", F.posexplode(Tr.halve(F.col("way"))).alias("i", "p")).select("id", "i", "p.x", "p.y")


def _pairs(spark, sf):
    w = _ways(spark, sf)
    a, b = w.filter("id % 2 = 0"), w.filter("id % 2 = 1")
    return a.select(F.col("id").alias("track_id"), F.col("way").alias("track"), (F.col("id") + 1).alias("mmsi")).join(b.select(F.col("id").alias("mmsi"), F.col("way").alias("vessel")), "mmsi")


@query
def heading_angle(spark, sf):
    return _pairs(spark, sf).select("track_id", "mmsi", F.round(Tr.heading_angle(F.col("track"), F.col("vessel")), 6).alias("angle"))


@query
def pair_gate(spark, sf):
    return motion.pair_gate(_pairs(spark, sf), 540.0).select("track_id", "mmsi", F.round("end_distance", 4).alias("end_distance"))


@query
def dtw_distance(spark, sf):
    return _pairs(spark, sf).select("track_id", "mmsi", F.round(Tr.dtw_col("track", "vessel"), 4).alias("dtw"))


@query
def trajectory_score(spark, sf):
    return _pairs(spark, sf).select("track_id", "mmsi", F.round(Tr.similarity_col("track", "vessel"), 3).alias("score"))


@query
def pair_cost_case(spark, sf):
    o = A.table(spark, sf, "orders")
    pairs = o.groupBy((F.col("o_custkey") % 40).alias("track_id"), (F.col("o_orderkey") % 30).alias("mmsi")).agg(F.max("o_totalprice").alias("score"))
    bound = pairs.filter("(track_id * 7 + mmsi) % 97 = 0").select("track_id", "mmsi", (F.col("track_id") % 9).alias("matches"))
    return motion.pair_costs(pairs, bound)


@query
def assignment_min_cost(spark, sf):
    b = A.boxes(spark, sf)
    costs = b.alias("a").join(b.alias("b"), "frame").select((F.col("frame") * 0).alias("run_id"), F.col("frame").alias("tick_ms"), F.col("a.det").alias("i"), F.col("b.det").alias("j"), F.abs(F.col("a.x1") - F.col("b.y1")).alias("cost"))
    return hosting.assign(costs)


def _seen(spark, sf):
    p = _points(spark, sf).select((F.col("id") % 10).alias("run_id"), (F.col("tick") * 1000).alias("tick_ms"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return p.filter("id % 20 < 10").withColumn("track_id", (F.col("id") % 1000).cast("int")), p.filter("id % 20 >= 10").withColumnRenamed("id", "mmsi")


@query
def match_binding(spark, sf):
    tracks, seen = _seen(spark, sf)
    return hosting.fuse_tracks(tracks.drop("id"), seen, 540.0)


@query
def nearest_vessel_greedy(spark, sf):
    tracks, seen = _seen(spark, sf)
    return hosting.fuse_nearest(tracks.drop("id"), seen, 540.0)


@query
def nearest_within_gate(spark, sf):
    """Each track's nearest vessel of its tick, claimed or not."""
    tracks, seen = _seen(spark, sf)
    return motion.nearest_in_gate(tracks, seen, 540.0).withColumn("distance", F.round("distance", 4))


@query
def layout_running_offset(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("frame"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_mktsegment") < "C").alias("has_ais"))
    return motion.panel_layout(c, 1920, 1080).select("frame", "id", "x1", "x2")


# --- vectors and the filter ---------------------------------------------------------------------


@query
def cosine_nn(spark, sf):
    q, g = A.gallery(spark, sf)
    return vectors.nearest(q, g, "cosine", same_label=True).select("vec_id", F.round("distance", 5).alias("distance"))


@query
def euclid_nn(spark, sf):
    q, g = A.gallery(spark, sf)
    return vectors.nearest(q, g, "euclid", same_label=True).select("vec_id", F.round("distance", 4).alias("distance"))


@query
def reid_top1_accuracy(spark, sf):
    """Share of queries whose nearest gallery vector has their label; queries meet the gallery in blocks."""
    q, g = A.gallery(spark, sf)
    top = vectors.nearest(q, g, "dot")
    return top.agg(F.round(F.avg((F.col("label") == F.col("other_label")).cast("double")), 6).alias("top1"), F.count("*").alias("n"))


@query
def gallery_budget(spark, sf):
    e = A.table(spark, sf, "embeddings")
    return motion.newest(e.select("label", "vec_id"), "label", "vec_id", 10)


@query
def kalman_predict(spark, sf):
    b = A.boxes(spark, sf)
    moving = b.withColumn("vx", F.col("det").cast("double")).withColumn("vy", -F.col("det").cast("double"))
    return hosting.filter_rows(moving, ("vx", "vy"), ("vx", "vy")).select("frame", "det", "x", "y", F.round("var_x", 4).alias("var_x"))


@query
def chi2_gate(spark, sf):
    b = A.boxes(spark, sf)
    off = b.withColumn("dx", F.col("det") * 8.0).withColumn("dy", F.col("det") * 5.0)
    gated = hosting.filter_rows(off, ("dx", "dy"), ("dx", "dy"))
    return gated.select("frame", "det", F.round(F.when(F.col("d2") > C.CHI2_4, C.INFEASIBLE).otherwise(F.col("d2")), 4).alias("cost"))


# --- evaluation ---------------------------------------------------------------------------------


def _judged(spark, sf):
    truth, found = A.truth_and_found(spark, sf)
    return truth, evaluation.judge(truth, found)


@query
def voc_tp_fp(spark, sf):
    return _judged(spark, sf)[1].groupBy("cls").agg(F.count("*").alias("n_found"), F.sum("tp").cast("long").alias("tp"), F.count(F.when(F.col("tp") == 0, 1)).alias("fp"))


@query
def voc_pr_curve(spark, sf):
    return evaluation.curve(*_judged(spark, sf)).select("cls", F.col("rank").cast("int").alias("rank"), F.round("rec", 6).alias("rec"), F.round("prec", 6).alias("prec"))


@query
def voc_ap(spark, sf):
    return evaluation.average_precision(evaluation.curve(*_judged(spark, sf))).withColumn("ap", F.round("ap", 6))


@query
def map_mean(spark, sf):
    return evaluation.average_precision(evaluation.curve(*_judged(spark, sf))).agg(F.round(F.avg("ap"), 6).alias("map"))


@query
def scores_at_cut(spark, sf):
    s = evaluation.scores_at_cut(evaluation.curve(*_judged(spark, sf)))
    return s.select("cls", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query
def lamr(spark, sf):
    return evaluation.log_average_miss_rate(evaluation.curve(*_judged(spark, sf))).withColumn("lamr", F.round("lamr", 6))


@query
def gt_dr_anti(spark, sf):
    truth, found = A.truth_and_found(spark, sf)
    lone = truth.filter("cls = 'A'").select("frame").distinct().join(found.filter("conf > 0.9").select("frame").distinct(), "frame", "left_anti")
    return lone


def _events(spark, sf):
    b = A.boxes(spark, sf)
    truth = F.when(F.col("det") != 5, F.col("det"))
    found = F.when((F.col("frame") + F.col("det")) % 6 != 0, F.col("det") * 10 + F.floor(F.col("frame") / 400) % 2)
    return b.select((F.col("frame") % 5).alias("sequence"), "frame", truth.alias("truth_id"), found.cast("int").alias("found_id")).filter("truth_id IS NOT NULL OR found_id IS NOT NULL")


@query
def mot_summary(spark, sf):
    s = evaluation.mot_summary(_events(spark, sf))
    return s.select("sequence", "num_switches", *[F.round(c, 6).alias(c) for c in ("mota", "recall", "precision")])


@query
def identity_scores(spark, sf):
    e = _events(spark, sf)
    pairs = e.filter("truth_id IS NOT NULL AND found_id IS NOT NULL").groupBy("sequence", "truth_id", "found_id").agg(F.count("*").alias("n"))
    truths = e.filter("truth_id IS NOT NULL").groupBy("sequence").agg(F.count("*").alias("n"))
    founds = e.filter("found_id IS NOT NULL").groupBy("sequence").agg(F.count("*").alias("n"))
    return evaluation.identity_scores(pairs, truths, founds)


# --- exports and data sets ----------------------------------------------------------------------


@query
def json_log_nested(spark, sf):
    """Conversations as frames, boxes and labels, nested and read back flat."""
    c = A.table(spark, sf, "conversations").select(F.col("conv_id").alias("frame_id"), F.col("turn").alias("bbox_id"), F.struct(F.col("role").alias("category"), F.length("text").alias("confidence")).alias("l"))
    per_box = c.groupBy("frame_id", "bbox_id").agg(F.array_sort(F.collect_list("l")).alias("labels"))
    doc = per_box.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("bbox_id", "labels"))).alias("bboxes"))
    text = F.to_json(F.struct("frame_id", "bboxes"))
    kind = "struct<frame_id:bigint,bboxes:array<struct<bbox_id:bigint,labels:array<struct<category:string,confidence:int>>>>>"
    back = doc.select(F.from_json(text, kind).alias("d")).select("d.frame_id", F.explode("d.bboxes").alias("b")).select("frame_id", "b.bbox_id", F.explode("b.labels").alias("l"))
    return back.select("frame_id", "bbox_id", "l.category", "l.confidence")


@query
def coco_export(spark, sf):
    """Annotations with category numbers from 1 while the categories list counts from 0."""
    truth, _ = A.truth_and_found(spark, sf)
    names = truth.select("cls").distinct().select("cls", (F.row_number().over(W.orderBy("cls")) - 1).alias("listed"))
    return truth.join(F.broadcast(names), "cls").select(F.col("frame").alias("image_id"), "gt", "listed", (F.col("listed") + 1).alias("category_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))


@query
def train_val_split(spark, sf):
    return motion.split_sets(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))).groupBy("part").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query
def first_image_per_id(spark, sf):
    return motion.first_of_each(A.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "id"), "id", ["l_orderkey", "l_linenumber"])


@query
def stamp_names(spark, sf):
    """Seconds to file names and back, frame index by video time, colours by label."""
    e = A.table(spark, sf, "events").select("event_id", "user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("s"))
    name = F.concat(F.date_format("s", "yyyy_MM_dd_HH_mm_ss"), F.lit(".csv"))
    back = F.unix_seconds(F.to_timestamp(F.regexp_extract(name, r"(.*)\.csv", 1), "yyyy_MM_dd_HH_mm_ss"))
    index = F.greatest(F.lit(0), F.least(F.lit(500), F.floor(F.col("event_id") / 25.0 + 1e-6))).cast("int")
    return e.select("event_id", name.alias("name"), back.alias("second"), index.alias("frame_index"), F.pmod((431000000 + F.col("user_id")) * 47, F.lit(360)).alias("hue"))


# --- trackers against truth, occlusion, exports -------------------------------------------------


@query
def mot_near_pairs(spark, sf):
    """In how many frames a true and a found id are near."""
    truth, found, _ = A.sequences(spark, sf)
    return matching.near_pairs(truth, found)


@query
def mot_box_events(spark, sf):
    """Events of matching true and found boxes frame by frame."""
    return matching.match_boxes(*A.sequences(spark, sf))


@query
def mot_box_scores(spark, sf):
    return matching.mot_scores(matching.match_boxes(*A.sequences(spark, sf)))


@query
def occlusion_run(spark, sf):
    """Appearance tracking, prediction of occluded tracks and fusion over short runs of moving boxes."""
    b = A.boxes(spark, sf).withColumn("lines", F.max("det").over(W.partitionBy("frame")))
    moved = b.select(F.col("frame").alias("run_id"), "det", "x1", "y1", "x2", "y2", "lines", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    tick = (F.col("t") * 1000).cast("long").alias("tick_ms")
    feature = F.transform(F.sequence(F.lit(1), F.greatest("lines", F.lit(3))), lambda i: F.when(F.col("det") == i, 1.0).otherwise(0.05))
    detections = moved.select("run_id", tick, "det", *[(F.col(c) + F.col("t") * 2).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0.9).alias("score"), feature.alias("feature"))
    vessels_ = moved.select("run_id", tick, (431000000 + F.col("det")).cast("long").alias("mmsi"), ((F.col("x1") + F.col("x2")) / 2 + F.col("t") * 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2 + F.col("t") * 2).alias("y"))
    return occlusion.track_through_occlusion(detections, vessels_, 540.0)


@query
def nms_covered(spark, sf):
    return motion.suppress_covered(A.boxes(spark, sf))


@query
def coco_annotations(spark, sf):
    truth, _ = A.truth_and_found(spark, sf)
    rows = exports.coco_annotations(truth, ["A", "N", "R"])
    return rows.select("id", "image_id", "category_id", "iscrowd", F.element_at("bbox", 3).alias("w"), "area")


@query
def coco_results(spark, sf):
    _, found = A.truth_and_found(spark, sf)
    rows = exports.coco_results(found, ["A", "N", "R"])
    return rows.select("image_id", "category_id", F.element_at("bbox", 1).alias("x"), F.element_at("bbox", 4).alias("h"), "score")


@query
def image_lists(spark, sf):
    parts = motion.split_sets(A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))
    return exports.image_lists(parts).groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("name").cast("long")).alias("ids"))


@query
def mosaic_boxes(spark, sf):
    b = A.boxes(spark, sf).withColumn("quadrant", (F.col("frame") % 4).cast("int"))
    box, inside = pictures.mosaic_box(B.columns(), F.col("quadrant"), 300.0, 200.0)
    return b.filter(inside).select("frame", "det", *[v.alias(f"m{k}") for k, v in box.items()])


@query
def rescaled_boxes(spark, sf):
    """Boxes of 1280 x 720 pictures halved, moved and, in odd frames, mirrored into 640 x 400."""
    flip = F.col("frame") % 2 == 1
    box, left = pictures.rescaled_box(B.columns(), (F.lit(1280.0), F.lit(720.0)), (F.lit(640.0), F.lit(360.0)), (F.lit(-200.0), F.lit(20.0)), (640, 400), flip)
    return A.boxes(spark, sf).filter(left).select("frame", "det", *[v.alias(f"r{k}") for k, v in box.items()])


@query
def packed_vectors(spark, sf):
    """Speeds written as text and read back, colours by label."""
    p = motion.speeds(_points(spark, sf))
    text = F.concat(F.lit("["), F.round("vx", 3).cast("string"), F.lit(", "), F.round("vy", 3).cast("string"), F.lit("]"))
    back = pictures.vector(text)
    return p.select("id", "tick", F.get(back, F.lit(0)).alias("vx"), F.get(back, F.lit(1)).alias("vy"), F.element_at(pictures.label_colour(F.col("id") % 1000), 2).alias("green"))
