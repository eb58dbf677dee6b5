"""Vessel messages: predicates, joins and windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake import config as C
from tidewake.functions import geo


def plausible() -> Column:
    """Ranges of all fields; NaN never passes, heading 511 does."""
    ranges = F.col("mmsi").between(100_000_000, 999_999_999) & F.col("lon").between(0, 180) & F.col("lat").between(0, 90)
    moving = (F.col("course") >= 0) & (F.col("course") < 360) & (F.col("heading") >= 0) & (F.col("speed") > C.MIN_SPEED_KN)
    numbers = ~(F.isnan("lon") | F.isnan("lat") | F.isnan("course") | F.isnan("heading") | F.isnan("speed"))
    return F.coalesce(ranges & moving & numbers, F.lit(False))


def from_camera(messages: DataFrame, camera: geo.Camera = geo.SAMPLE_CAMERA) -> DataFrame:
    """messages with ``distance`` (metres, ellipsoid) and ``bearing`` (degrees, sphere) from the camera."""
    lat, lon = F.lit(camera.lat), F.lit(camera.lon)
    return messages.withColumn("distance", geo.distance_col(lat, lon, F.col("lat"), F.col("lon"))).withColumn("bearing", geo.bearing_col(lat, lon, F.col("lat"), F.col("lon")))


def in_range(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("distance") <= C.RANGE_GATE_M)


def last_per_vessel(messages: DataFrame) -> DataFrame:
    """Of each (run, tick, vessel) the last message by its ordinal."""
    rest = [c for c in messages.columns if c not in ("run_id", "tick", "mmsi")]
    return messages.groupBy("run_id", "tick", "mmsi").agg(F.max_by(F.struct(*rest), "event_id").alias("m")).select("run_id", "tick", "mmsi", "m.*")


def carried(messages: DataFrame) -> DataFrame:
    """(tick, mmsi) of vessels heard at the tick before and not at this one."""
    heard = messages.select("tick", "mmsi").distinct()
    expected = heard.select((F.col("tick") + 1).alias("tick"), "mmsi")
    return expected.join(heard.select("tick").distinct(), "tick", "left_semi").join(heard, ["tick", "mmsi"], "left_anti")


def as_of(ticks: DataFrame, messages: DataFrame) -> DataFrame:
    """The latest message at or before each tick and vessel: ticks and messages in one ordered pass."""
    asked = ticks.select("tick", "mmsi", F.lit(None).cast("struct<event_id:bigint,ts_ms:bigint,speed:double>").alias("m"), F.lit(1).alias("kind"))
    told = messages.select("tick", "mmsi", F.struct("event_id", "ts_ms", "speed").alias("m"), F.lit(0).alias("kind"))
    w = W.partitionBy("mmsi").orderBy("tick", "kind", F.col("m.event_id")).rowsBetween(W.unboundedPreceding, 0)
    seen = asked.union(told).withColumn("latest", F.last("m", ignorenulls=True).over(w)).filter("kind = 1 AND latest IS NOT NULL")
    return seen.select("tick", "mmsi", "latest.*")


def without_jumps(messages: DataFrame) -> DataFrame:
    """Messages that do not jump from the vessel's message before (the pairwise form of the check)."""
    w = W.partitionBy("run_id", "mmsi").orderBy("ts_ms", "event_id")
    near = [(F.abs(F.col(c) - F.lag(c).over(w)) < limit) for c, limit in (("lon", C.JUMP_LON_DEG), ("lat", C.JUMP_LAT_DEG), ("speed", C.JUMP_SPEED_KN))]
    return messages.withColumn("near", near[0] & near[1] & near[2]).filter(F.coalesce("near", F.lit(True))).drop("near")


def history(messages: DataFrame, seconds: int = C.HISTORY_SECONDS) -> DataFrame:
    """messages with the number and the first key of the vessel's messages in the trailing window, bounds included."""
    w = W.partitionBy("run_id", "mmsi").orderBy("ts_ms").rangeBetween(-seconds * 1000, 0)
    return messages.withColumn("kept", F.count("*").over(w)).withColumn("oldest", F.min("ts_ms").over(w))


def history_since_exit(messages: DataFrame) -> DataFrame:
    """Points kept of each vessel since it last left sideways; removal precedes the tick's own point."""
    order = W.partitionBy("run_id", "mmsi").orderBy("tick", "event_id").rowsBetween(W.unboundedPreceding, 0)
    epoch = F.sum((F.col("class") == "RemoveVisualTrack").cast("int")).over(order)
    kept = F.count(F.when(F.col("class") == "Transform", 1)).over(W.partitionBy("run_id", "mmsi", "epoch").orderBy("tick", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return messages.withColumn("epoch", epoch).withColumn("points", kept)


def second_gate(messages: DataFrame, frame_ms: int) -> DataFrame:
    """Rows of the first frame of each second."""
    return messages.filter(F.pmod(F.col("ts_ms"), F.lit(1000)) < frame_ms)


def tumbling_means(points: DataFrame, key: str, values: list[str], width: str = "1 second", order: str | None = None) -> DataFrame:
    """Per key and window the means of values, truncated to integers; points without a time are a window of their own.

    Sums of doubles depend on the order of addition, which decides a mean that is whole: with ``order``
    numbers are added in that column's order, by a window that holds no group in memory.
    """
    timed = points.withColumn("start", F.window("ts", width)["start"])
    timed = timed.unionByName(points.filter("ts IS NULL").withColumn("start", F.lit(None).cast(timed.schema["start"].dataType)))
    if order is None:
        return timed.groupBy(key, "start").agg(*[F.avg(v).cast("int").alias(v) for v in values])
    w = W.partitionBy(key, "start").orderBy(order)
    rows = w.rowsBetween(W.unboundedPreceding, 0)
    whole = {f.name for f in points.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    sums = [F.sum(F.col(v).cast("decimal(20,0)") if v in whole else F.col(v)).over(rows).cast("double") for v in values]
    means = [F.try_divide(s, F.count(v).over(rows)).cast("int").alias(f"mean_{v}") for v, s in zip(values, sums)]
    last = timed.select(key, "start", *means, F.lead(F.lit(1)).over(w).alias("more")).filter("more IS NULL")
    return last.select(key, "start", *[F.col(f"mean_{v}").alias(v) for v in values])
