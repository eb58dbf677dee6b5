"""Equi-joins whose hot keys are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.workspace import Workspace

#: A key is hot from so many rows on, or from this part of all rows: so there are at most HOT_KEYS hot keys, 12 bytes each.
HOT_ROWS = 256
HOT_KEYS = 1_000_000


def hot_keys(rows: DataFrame, key: str, work: Workspace, name: str) -> DataFrame | None:
    """(__hot, __salts) of the keys that hold many of a stored table's rows, at most HOT_KEYS; None without any."""
    total = rows.count()
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = rows.groupBy(key).count().filter(F.col("count") >= limit).select(F.col(key).alias("__hot"), F.ceil(F.col("count") / limit).cast("int").alias("__salts"))
    hot = work.save(hot.coalesce(1), name)
    return None if hot.isEmpty() else hot


def salted_join(rows: DataFrame, few: DataFrame, key: str, by: str, hot: DataFrame | None) -> DataFrame:
    """rows joined with ``few`` on ``key``, where few holds far fewer rows of a hot key than rows does.

    A row of a hot key goes to one of several salts, by the hash of its column ``by``; the rows of
    few go to all salts of their key.  The hot keys are broadcast: by their definition there are at
    most HOT_KEYS.  Null keys meet nothing.
    """
    if hot is None:
        return rows.join(few, key)
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__hot", "__salts")
    spread = few.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    spread = spread.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__hot", "__salts")
    return salted.join(spread, [key, "__salt"]).drop("__salt")
