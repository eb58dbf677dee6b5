"""Detector and tracker evaluation as joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake import config as C
from tidewake.functions import boxes as B


def judge(truth: DataFrame, found: DataFrame, least: float = C.EVAL_MIN_IOU) -> DataFrame:
    """found with ``iou`` of its best truth and ``tp``: 1, 0, or null where that truth is difficult.

    The best truth of a detection does not depend on other detections, so of those that pass the
    overlap with one truth the most confident is the hit and the others are false.
    """
    both = found.alias("f").join(truth.alias("t"), (F.col("f.frame") == F.col("t.frame")) & (F.col("f.cls") == F.col("t.cls")), "left")
    value = F.coalesce(B.iou(B.columns("f."), B.columns("t."), 1.0), F.lit(0.0))
    first = W.partitionBy("frame", "det").orderBy(F.desc("iou"), "gt")
    best = both.select("f.frame", "f.det", "f.cls", "f.conf", "t.gt", "t.difficult", value.alias("iou")).withColumn("r", F.row_number().over(first)).filter("r = 1")
    hit = F.col("iou") >= least
    turn = W.partitionBy("frame", "cls", "gt", hit).orderBy(F.desc("conf"), "det")
    tp = F.when(hit & F.col("difficult"), F.lit(None)).when(hit & (F.row_number().over(turn) == 1), 1).otherwise(0)
    return best.select("frame", "det", "cls", "conf", "iou", tp.alias("tp"))


def curve(truth: DataFrame, judged: DataFrame, slices: int = 4096) -> DataFrame:
    """Recall and precision by confidence rank of each class, with cumulative false positives.

    A class is ranked in slices of confidence (0 to 1; others fall into the end slices), which
    are numbered from the most confident and start from the totals of the slices above them, so that no task holds a whole class.
    """
    counts = truth.groupBy("cls").agg(F.count(F.when(~F.col("difficult"), 1)).alias("n_gt"), F.countDistinct("frame").alias("n_images"))
    at = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(slices), F.floor((1 - F.col("conf")) * slices))), F.lit(slices + 1)).cast("int")
    w = W.partitionBy("cls", "slice").orderBy(F.desc("conf"), "frame", "det").rowsBetween(W.unboundedPreceding, 0)
    false = F.when(F.col("tp") == 0, 1).otherwise(0)
    inner = judged.withColumn("slice", at).select("cls", "slice", "conf", F.count(F.lit(1)).over(w).alias("rank"), F.sum(F.coalesce("tp", F.lit(0))).over(w).alias("cum_tp"), F.sum(false).over(w).alias("cum_fp"))
    sums = ("rank", "cum_tp", "cum_fp")
    above = W.partitionBy("cls").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    totals = inner.groupBy("cls", "slice").agg(*[F.max(c).alias(c) for c in sums])
    before = totals.select("cls", "slice", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in sums])
    ranked = inner.join(before, ["cls", "slice"]).select("cls", "slice", "conf", *[(F.col(c) + F.col(f"{c}_above")).alias(c) for c in sums])
    return ranked.join(F.broadcast(counts), "cls").select("cls", "slice", "rank", "conf", (F.col("cum_tp") / F.greatest("n_gt", F.lit(1))).alias("rec"), (F.col("cum_tp") / F.greatest(F.col("cum_tp") + F.col("cum_fp"), F.lit(1))).alias("prec"), "cum_fp", "n_images")


def average_precision(points: DataFrame) -> DataFrame:
    """AP per class: recall steps times the precision envelope, slice by slice of curve().

    A slice starts from the last recall of the slice before and the best precision of those behind.
    """
    order = W.partitionBy("cls").orderBy("slice")
    ends = points.groupBy("cls", "slice").agg(F.max("rec").alias("rec"), F.max("prec").alias("prec"))
    # The maximum from a place on, run from the last place back: linear, unlike a frame that looks ahead.
    behind = W.partitionBy("cls").orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("cls", "slice", F.coalesce(F.lag("rec").over(order), F.lit(0.0)).alias("rec_before"), F.coalesce(F.max("prec").over(behind), F.lit(0.0)).alias("prec_behind"))
    own = W.partitionBy("cls", "slice")
    step = points.select("cls", "slice", F.col("rec") - F.lag("rec").over(own.orderBy("rank")), "rec", F.max("prec").over(own.orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0))).toDF("cls", "slice", "step", "rec", "top")
    parts = step.join(ends, ["cls", "slice"]).select("cls", (F.coalesce("step", F.col("rec") - F.col("rec_before")) * F.greatest("top", "prec_behind")).alias("part"))
    return parts.groupBy("cls").agg(F.sum("part").alias("ap"))


def scores_at_cut(points: DataFrame, cut: float = C.EVAL_SCORE_CUT) -> DataFrame:
    """Recall, precision and F1 of each class at its last rank with a confidence above the cut (else the first)."""
    at = F.coalesce(F.max_by(F.struct("rec", "prec"), F.when(F.col("conf") > cut, F.col("rank"))), F.min_by(F.struct("rec", "prec"), "rank"))
    rec, prec = F.col("at.rec"), F.col("at.prec")
    return points.groupBy("cls").agg(at.alias("at")).select("cls", rec.alias("recall"), prec.alias("precision"), F.coalesce(F.try_divide(2 * rec * prec, rec + prec), F.lit(0.0)).alias("f1"))


def log_average_miss_rate(points: DataFrame) -> DataFrame:
    """Geometric mean of 1 - recall at nine false-positive rates per image, evenly spaced in the logarithm."""
    fppi = F.col("cum_fp") / F.col("n_images")
    at = [F.coalesce(F.max_by(1 - F.col("rec"), F.when(fppi <= 10 ** (-2 + i / 4), F.col("rank"))), F.lit(1.0)) for i in range(9)]
    misses = points.groupBy("cls").agg(*[F.log(F.greatest(m, F.lit(1e-10))).alias(f"m{i}") for i, m in enumerate(at)])
    return misses.select("cls", F.exp(sum(F.col(f"m{i}") for i in range(9)) / 9).alias("lamr"))


def mot_summary(events: DataFrame) -> DataFrame:
    """Per sequence and overall: MOTA, precision, recall and identity switches.

    events: sequence, frame, truth_id (null: false positive), found_id (null: miss), match ordinal.
    """
    kept = events.filter("truth_id IS NOT NULL AND found_id IS NOT NULL")
    w = W.partitionBy("sequence", "truth_id").orderBy("frame")
    switches = kept.withColumn("last", F.lag("found_id").over(w)).filter("last <> found_id").select("sequence", F.lit(1).alias("switch"), F.lit(0).alias("t"), F.lit(0).alias("f"), F.lit(0).alias("m"))
    rows = events.select("sequence", F.lit(0).alias("switch"), F.col("truth_id").isNotNull().cast("int").alias("t"), F.col("found_id").isNotNull().cast("int").alias("f"), (F.col("truth_id").isNotNull() & F.col("found_id").isNotNull()).cast("int").alias("m"))
    total = rows.union(switches).rollup("sequence").agg(F.sum("switch").alias("num_switches"), F.sum("t").alias("t"), F.sum("f").alias("f"), F.sum("m").alias("m"))
    mota = 1 - (F.col("t") - F.col("m") + F.col("f") - F.col("m") + F.col("num_switches")) / F.col("t")
    return total.select(F.coalesce("sequence", F.lit(-1)).alias("sequence"), "num_switches", mota.alias("mota"), (F.col("m") / F.col("t")).alias("recall"), (F.col("m") / F.col("f")).alias("precision"))


def identity_scores(pairs: DataFrame, truths: DataFrame, founds: DataFrame) -> DataFrame:
    """IDP, IDR and IDF1 per sequence, by the assignment of identities with most common frames.

    pairs: sequence, truth_id, found_id, n; truths and founds: sequence and n (all their boxes).
    """
    import pandas as pd

    from tidewake.functions.assignment import solve

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="truth_id", columns="found_id", values="n", fill_value=0).to_numpy()
        return pd.DataFrame({"sequence": pdf["sequence"].iloc[:1], "idtp": [float(sum(m[i, j] for i, j in enumerate(solve(-m)) if j >= 0))]})

    hits = pairs.groupBy("sequence").applyInPandas(fold, "sequence long, idtp double")
    both = truths.withColumnRenamed("n", "t").join(founds.withColumnRenamed("n", "f"), "sequence").join(hits, "sequence", "left").fillna(0.0, ["idtp"])
    return both.select("sequence", (F.col("idtp") / F.col("f")).alias("idp"), (F.col("idtp") / F.col("t")).alias("idr"), (2 * F.col("idtp") / (F.col("t") + F.col("f"))).alias("idf1"))
