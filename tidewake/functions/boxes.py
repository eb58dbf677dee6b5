"""Box geometry as plain column expressions; a box is a struct or columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def xyxy_to_tlwh(x1, y1, x2, y2):
    return x1, y1, x2 - x1, y2 - y1


def tlwh_to_xyxy(x, y, w, h):
    return x, y, x + w, y + h


def tlwh_to_xyah(x, y, w, h):
    """Centre, aspect ratio (null for no height) and height."""
    return x + w / 2, y + h / 2, F.try_divide(w, h), h


def xywh_to_xyxy_clamped(x, y, w, h, width: int, height: int):
    """Centre form to corners, truncated and held inside the picture."""
    left = F.greatest((x - w / 2).cast("int"), F.lit(0))
    right = F.least((x + w / 2).cast("int"), F.lit(width - 1))
    top = F.greatest((y - h / 2).cast("int"), F.lit(0))
    bottom = F.least((y + h / 2).cast("int"), F.lit(height - 1))
    return left, top, right, bottom


def overlap_area(a: dict, b: dict, pixel: float = 0.0) -> Column:
    """Common area of two boxes given as column dicts; ``pixel`` 1 counts corners inclusively."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + pixel
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + pixel
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def area(a: dict, pixel: float = 0.0) -> Column:
    return (a["x2"] - a["x1"] + pixel) * (a["y2"] - a["y1"] + pixel)


def iou(a: dict, b: dict, pixel: float = 0.0) -> Column:
    """Intersection over union; 0 where boxes only touch or have no area."""
    common = overlap_area(a, b, pixel)
    return F.when(common > 0, common / (area(a, pixel) + area(b, pixel) - common)).otherwise(F.lit(0.0))


def giou(a: dict, b: dict) -> Column:
    """IoU less the share of the common hull that neither box covers."""
    hull = (F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"])) * (F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"]))
    union = area(a) + area(b) - overlap_area(a, b)
    return iou(a, b) - F.coalesce(F.try_divide(hull - union, hull), F.lit(0.0))


def overlaps_either(a: dict, b: dict, rate: float) -> Column:
    """Whether the common area passes ``rate`` of either box's area; boxes without area never do."""
    common = overlap_area(a, b)
    return F.coalesce(F.try_divide(common, area(a)) > rate, F.lit(False)) | F.coalesce(F.try_divide(common, area(b)) > rate, F.lit(False))


def point_in_box(x: Column, y: Column, box: dict) -> Column:
    return x.between(box["x1"], box["x2"]) & y.between(box["y1"], box["y2"])


def columns(prefix: str = "") -> dict:
    return {k: F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2")}


def letterbox(width: Column, height: Column, size: int = 640) -> tuple[Column, Column, Column]:
    """Scale and offsets that fit a picture into a square."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    dx = F.floor((F.lit(size) - (width * scale).cast("int")) / 2)
    dy = F.floor((F.lit(size) - (height * scale).cast("int")) / 2)
    return scale, dx, dy


def unletterbox(box: dict, width: Column, height: Column, size: int = 640) -> tuple[Column, Column, Column, Column]:
    """Boxes of the square back in the picture, floored and clipped."""
    scale, dx, dy = letterbox(width, height, size)
    x1 = F.greatest(F.floor((box["x1"] - dx) / scale).cast("double"), F.lit(0.0))
    y1 = F.greatest(F.floor((box["y1"] - dy) / scale).cast("double"), F.lit(0.0))
    x2 = F.least(F.floor((box["x2"] - dx) / scale).cast("double"), width.cast("double"))
    y2 = F.least(F.floor((box["y2"] - dy) / scale).cast("double"), height.cast("double"))
    return x1, y1, x2, y2


def anchor_decode(cx, cy, w, h, grid_x, grid_y, stride):
    """Raw detector outputs of a grid cell to a centre and a size in input pixels."""
    return (cx + grid_x) * stride, (cy + grid_y) * stride, F.exp(w) * stride, F.exp(h) * stride


def mot_row(x1, y1, x2, y2, width: float, height: float) -> list[Column]:
    """x, y, w, h of a MOT row: corners clamped to the picture, sizes as absolute values, truncated."""
    left, top = F.greatest(x1, F.lit(0.0)), F.greatest(y1, F.lit(0.0))
    right, bottom = F.least(x2, F.lit(float(width))), F.least(y2, F.lit(float(height)))
    return [left.cast("int").alias("x"), top.cast("int").alias("y"), F.abs(right - left).cast("int").alias("w"), F.abs(bottom - top).cast("int").alias("h")]
