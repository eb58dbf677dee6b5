"""Domain tables made from the test tables, by the same arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel messages from events: one run, hourly ticks."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.lit(1).cast("long").alias("run_id"), "event_id", F.floor(us / HOUR_US).cast("long").alias("tick"), (431000000 + F.col("user_id")).cast("long").alias("mmsi"),
        (F.lit(121.5) + 5e-4 + ((F.col("event_id") * 7919) % 20000) / 1e6).alias("lon"), (F.lit(29.87) + (((F.col("event_id") * 104729) % 12000) - 6000) / 1e6).alias("lat"),
        (F.col("value") / 10.0).alias("speed"), ((F.col("event_id") * 37) % 360).cast("double").alias("course"),
        F.when(F.col("event_id") % 3 == 0, 511.0).otherwise(((F.col("event_id") * 11) % 360).cast("double")).alias("heading"),
        F.lit(70).alias("ship_type"), F.floor(us / 1000).cast("long").alias("ts_ms"),
    )


AIS_SQL = """ais AS (SELECT CAST(1 AS BIGINT) AS run_id, event_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS tick, CAST(431000000 + user_id AS BIGINT) AS mmsi,
  121.5e0 + 5e-4 + ((event_id * 7919) % 20000) / 1e6 AS lon, 29.87e0 + (((event_id * 104729) % 12000) - 6000) / 1e6 AS lat,
  value / 1e1 AS speed, CAST((event_id * 37) % 360 AS DOUBLE) AS course,
  CASE WHEN event_id % 3 = 0 THEN 511e0 ELSE CAST((event_id * 11) % 360 AS DOUBLE) END AS heading, 70 AS ship_type, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms FROM events)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector boxes from line items: a frame per order."""
    li = table(spark, sf_dir, "lineitem")
    x, y = ((F.col("l_partkey") * 37) % 500).cast("double"), ((F.col("l_suppkey") * 53) % 300).cast("double")
    det = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax"))
    return li.select(
        F.col("l_orderkey").alias("frame"), det.alias("det"), x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity") * 6 + 40).alias("x2"), (y + F.col("l_quantity") * 4 + 30).alias("y2"),
        (1.0 - F.col("l_discount") * 5).alias("score"), F.col("l_returnflag").alias("cls"),
    )


BOX_SQL = """boxes AS (SELECT l_orderkey AS frame, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) AS INTEGER) AS det, CAST((l_partkey * 37) % 500 AS DOUBLE) AS x1, CAST((l_suppkey * 53) % 300 AS DOUBLE) AS y1,
  CAST((l_partkey * 37) % 500 AS DOUBLE) + l_quantity * 6 + 40 AS x2, CAST((l_suppkey * 53) % 300 AS DOUBLE) + l_quantity * 4 + 30 AS y2, 1e0 - l_discount * 5 AS score, l_returnflag AS cls FROM lineitem)"""


def truth_and_found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ground truth (a box per line item) and detections (the same boxes, shifted; some without a truth)."""
    b = boxes(spark, sf_dir)
    truth = b.select("frame", F.col("det").alias("gt"), "cls", "x1", "y1", "x2", "y2", (F.col("det") == 4).alias("difficult"))
    dx = ((F.col("frame") * 7 + F.col("det") * 13) % 41).cast("double")
    conf = F.round(((F.col("frame") * 31 + F.col("det") * 17) % 997) / 997.0, 6)
    found = b.select("frame", "det", "cls", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dx / 2).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dx / 2).alias("y2"), conf.alias("conf"))
    return truth, found


EVAL_SQL = BOX_SQL + """,
truth AS (SELECT frame, det AS gt, cls, x1, y1, x2, y2, det = 4 AS difficult FROM boxes),
found AS (SELECT frame, det, cls, x1 + d AS x1, y1 + d / 2 AS y1, x2 + d AS x2, y2 + d / 2 AS y2, conf FROM (
  SELECT *, CAST((frame * 7 + det * 13) % 41 AS DOUBLE) AS d, round(((frame * 31 + det * 17) % 997) / 997e0, 6) AS conf FROM boxes)),
pairs AS (SELECT f.frame, f.det, f.cls, f.conf, t.gt, t.difficult,
  greatest(least(f.x2, t.x2) - greatest(f.x1, t.x1) + 1, 0) * greatest(least(f.y2, t.y2) - greatest(f.y1, t.y1) + 1, 0) AS common,
  (f.x2 - f.x1 + 1) * (f.y2 - f.y1 + 1) + (t.x2 - t.x1 + 1) * (t.y2 - t.y1 + 1) AS areas
  FROM found f LEFT JOIN truth t ON f.frame = t.frame AND f.cls = t.cls),
best AS (SELECT *, CASE WHEN common > 0 THEN common / (areas - common) ELSE 0 END AS iou FROM pairs
  QUALIFY row_number() OVER (PARTITION BY frame, det ORDER BY CASE WHEN common > 0 THEN common / (areas - common) ELSE 0 END DESC, gt) = 1),
judged AS (SELECT frame, det, cls, conf, iou, CASE WHEN iou >= 0.5 AND difficult THEN NULL
  WHEN iou >= 0.5 AND row_number() OVER (PARTITION BY frame, cls, gt, iou >= 0.5 ORDER BY conf DESC, det) = 1 THEN 1 ELSE 0 END AS tp FROM best),
counts AS (SELECT cls, count(*) FILTER (NOT difficult) AS n_gt, count(DISTINCT frame) AS n_images FROM truth GROUP BY cls),
ranked AS (SELECT cls, frame, det, conf, row_number() OVER w AS rank, sum(coalesce(tp, 0)) OVER w AS cum_tp, sum(CASE WHEN tp = 0 THEN 1 ELSE 0 END) OVER w AS cum_fp
  FROM judged WINDOW w AS (PARTITION BY cls ORDER BY conf DESC, frame, det ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT r.cls, rank, conf, cum_tp / greatest(n_gt, 1) AS rec, cum_tp / greatest(cum_tp + cum_fp, 1) AS prec, cum_fp, n_images FROM ranked r JOIN counts USING (cls))"""


def gallery(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query vectors (every tenth) and the gallery, which is all vectors; a query does not meet itself."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return e.filter("vec_id % 10 = 0"), e


def sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """True, found and ignored boxes (sequence, frame, id, x, y, w, h): every box, found ones shifted, some ignored."""
    b = boxes(spark, sf_dir)
    size = ((F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    name = (F.col("frame") % 5).alias("sequence")
    shift = ((F.col("frame") * 7 + F.col("det") * 13) % 41).cast("double")
    swapped = F.col("det") * 10 + F.floor(F.col("frame") / 400) % 2
    truth = b.filter("det <> 3").select(name, "frame", F.col("det").cast("long").alias("id"), "x1", "y1", *size)
    found = b.filter("(frame + det) % 6 <> 0").select(name, "frame", swapped.cast("long").alias("id"), (F.col("x1") + shift).alias("x1"), (F.col("y1") + shift / 2).alias("y1"), *size)
    ignored = b.filter("det = 3").select(name, "frame", F.col("det").cast("long").alias("id"), "x1", "y1", *size)
    return tuple(t.withColumnsRenamed({"x1": "x", "y1": "y"}) for t in (truth, found, ignored))


SEQUENCE_SQL = BOX_SQL + """,
t AS (SELECT frame % 5 AS sequence, frame, CAST(det AS BIGINT) AS id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM boxes WHERE det <> 3),
f AS (SELECT frame % 5 AS sequence, frame, CAST(det * 10 + (frame // 400) % 2 AS BIGINT) AS id, x1 + d AS x, y1 + d / 2 AS y, x2 - x1 AS w, y2 - y1 AS h
  FROM (SELECT *, CAST((frame * 7 + det * 13) % 41 AS DOUBLE) AS d FROM boxes) WHERE (frame + det) % 6 <> 0)"""
