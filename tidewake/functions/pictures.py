"""Pictures and their boxes: byte checks, normalisation, rescaling and mosaic clipping, display values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Channel means and deviations of the training pictures; the palette of label colours.
MEAN = (0.485, 0.456, 0.406)
DEVIATION = (0.229, 0.224, 0.225)
PALETTE = (2**11 - 1, 2**15 - 1, 2**20 - 1)


def checked_rgb(width: Column, height: Column, rgb: Column) -> Column:
    """rgb, or an error where the sides are not positive or the bytes are not three per pixel."""
    good = (width > 0) & (height > 0) & (F.octet_length(rgb) == width * height * 3)
    wrong = F.raise_error(F.concat_ws(" ", F.lit("a picture of"), width, F.lit("x"), height, F.lit("has bytes:"), F.octet_length(rgb)))
    return F.when(good, rgb).otherwise(wrong.cast("binary"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def normalised(width: pd.Series, height: pd.Series, rgb: pd.Series) -> pd.Series:
    """Pixels by channel, row and column, scaled to 0..1, less the mean, over the deviation."""
    mean, deviation = np.array(MEAN, np.float32), np.array(DEVIATION, np.float32)

    def one(w: int, h: int, raw: bytes) -> np.ndarray:
        pixels = np.frombuffer(raw, np.uint8).reshape(h, w, 3).astype(np.float32) / 255
        return ((pixels - mean) / deviation).transpose(2, 0, 1).ravel()

    return pd.Series([one(*row) for row in zip(width, height, rgb)])


def rescaled_box(box: dict, from_size: tuple[Column, Column], to_size: tuple[Column, Column], offset: tuple[Column, Column], picture: tuple[int, int], flip: Column | None = None) -> tuple[dict, Column]:
    """A box of a picture that is resized, moved, perhaps mirrored and cropped; and whether more than a pixel is left."""
    sx, sy = to_size[0] / from_size[0], to_size[1] / from_size[1]
    x1, x2 = box["x1"] * sx + offset[0], box["x2"] * sx + offset[0]
    y1, y2 = box["y1"] * sy + offset[1], box["y2"] * sy + offset[1]
    if flip is not None:
        x1, x2 = F.when(flip, picture[0] - x2).otherwise(x1), F.when(flip, picture[0] - x1).otherwise(x2)
    out = {"x1": F.greatest(x1, F.lit(0.0)), "y1": F.greatest(y1, F.lit(0.0)), "x2": F.least(x2, F.lit(float(picture[0]))), "y2": F.least(y2, F.lit(float(picture[1])))}
    return out, (out["x2"] - out["x1"] > 1) & (out["y2"] - out["y1"] > 1)


def mosaic_box(box: dict, quadrant: Column, cut_x: float, cut_y: float) -> tuple[dict, Column]:
    """A box clipped to its quadrant of a mosaic (0 top left, 1 bottom left, 2 bottom right, 3 top right), and whether it reaches in."""
    left, top = quadrant.isin(0, 1), quadrant.isin(0, 3)
    across_x, across_y = (box["x2"] >= cut_x) & (box["x1"] <= cut_x), (box["y2"] >= cut_y) & (box["y1"] <= cut_y)
    inside = F.when(left, box["x1"] <= cut_x).otherwise(box["x2"] >= cut_x) & F.when(top, box["y1"] <= cut_y).otherwise(box["y2"] >= cut_y)
    x, y = F.lit(float(cut_x)), F.lit(float(cut_y))
    return {
        "x1": F.when(~left & across_x, x).otherwise(box["x1"]), "y1": F.when(~top & across_y, y).otherwise(box["y1"]),
        "x2": F.when(left & across_x, x).otherwise(box["x2"]), "y2": F.when(top & across_y, y).otherwise(box["y2"]),
    }, inside


def vector(text: Column) -> Column:
    """``"[vx, vy]"`` as an array of doubles; null where it does not parse."""
    return F.from_json(text, "array<double>")


def label_colour(label: Column) -> Column:
    """Three channel values of a label."""
    return F.array(*[F.pmod(F.lit(p).cast("long") * (label.cast("long") * label - label + 1), F.lit(255)).cast("int") for p in PALETTE])


def vessel_hue(mmsi: Column) -> Column:
    return F.pmod(mmsi.cast("long") * 47, F.lit(360)).cast("int")


def shown(value: Column) -> Column:
    """A coordinate as it is shown: five decimals."""
    return F.round(value, 5)
