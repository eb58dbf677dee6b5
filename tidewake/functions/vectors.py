"""Vector distances as array expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / (norm(a) * norm(b))


def squared_euclid(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def nearest(queries: DataFrame, gallery: DataFrame, metric: str = "cosine", same_label: bool = False, block: int = 4096) -> DataFrame:
    """(vec_id, label, other, other_label, distance): each query's nearest gallery vector, never itself.

    Both sides: vec_id, vector, label.  Queries are taken in blocks of bounded size; each block is
    held by the tasks that read the gallery, whose batches meet it as matrices, and only the best of
    a batch goes on.  metric: cosine, euclid (squared) or dot (less is farther, so negated).
    """
    spark = queries.sparkSession
    names = queries.select("vec_id", "label", "vector").orderBy("vec_id")
    total = queries.count()
    blocks = max(1, -(-total // block))
    schema = "vec_id long, label int, distance double, other long, other_label int"
    out = None
    for b in range(blocks):
        part = names if blocks == 1 else names.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = part.collect()
        if not rows:
            continue
        held = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["vector"] for r in rows], float)))

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, labels, q = held.value
            for batch in batches:
                if not len(batch):
                    continue
                g = np.array(batch["vector"].tolist(), float)
                other, other_label = batch["vec_id"].to_numpy(), batch["label"].to_numpy()
                inner = q @ g.T
                if metric == "cosine":
                    far = 1 - inner / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(g, axis=1)[None])
                elif metric == "euclid":
                    far = np.maximum(0, np.square(q).sum(1)[:, None] - 2 * inner + np.square(g).sum(1)[None])
                else:
                    far = -inner
                far = np.round(far, 9)
                far[ids[:, None] == other[None]] = np.inf
                if same_label:
                    far[labels[:, None] != other_label[None]] = np.inf
                order = np.lexsort((other,))
                at = order[far[:, order].argmin(axis=1)]
                near = far[np.arange(len(ids)), at]
                keep = np.isfinite(near)
                yield pd.DataFrame({"vec_id": ids[keep], "label": labels[keep].astype("int32"), "distance": near[keep], "other": other[at][keep], "other_label": other_label[at][keep].astype("int32")})

        found = gallery.select("vec_id", "vector", "label").mapInPandas(best, schema)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "vec_id long, label int, other long, other_label int, distance double")
    least = out.groupBy("vec_id", "label").agg(F.min(F.struct("distance", "other", "other_label")).alias("m"))
    return least.select("vec_id", "label", "m.other", "m.other_label", "m.distance")
