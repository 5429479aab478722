"""Box arithmetic as Column expressions. A box is a tuple of four Columns (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
_FIELDS = ("x_min", "y_min", "x_max", "y_max")


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + name) for name in _FIELDS)  # type: ignore[return-value]


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, zero when the boxes do not overlap."""
    left, top = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    right, bottom = F.least(a[2], b[2]), F.least(a[3], b[3])
    inter = (right - left) * (bottom - top)
    return F.when((right <= left) | (bottom <= top), F.lit(0.0)).otherwise(
        inter / (area(a) + area(b) - inter)
    )


def iou_scaled(a: Box, b: Box) -> Column:
    """IoU with every extent divided by the largest extent of its axis, so tiny boxes do not underflow."""
    wa, wb, ha, hb = a[2] - a[0], b[2] - b[0], a[3] - a[1], b[3] - b[1]
    sx, sy = F.greatest(wa, wb), F.greatest(ha, hb)
    iw = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    ih = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = (iw / sx) * (ih / sy)
    union = (wa / sx) * (ha / sy) + (wb / sx) * (hb / sy) - inter
    return F.when((iw <= 0) | (ih <= 0), F.lit(0.0)).otherwise(inter / union)


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def clamped(b: Box) -> Box:
    return tuple(clamp01(c) for c in b)  # type: ignore[return-value]


def has_area(b: Box) -> Column:
    return (b[2] > b[0]) & (b[3] > b[1])


def to_pixels(b: Box, width: Column, height: Column) -> Box:
    return b[0] * width, b[1] * height, b[2] * width, b[3] * height


def to_normalised(b: Box, width: Column, height: Column) -> Box:
    return b[0] / width, b[1] / height, b[2] / width, b[3] / height


def snap_to_pixel(norm: Column, extent: Column) -> Column:
    """The whole pixel only where it reproduces the normalised value exactly, else the raw product."""
    scaled = norm * extent
    nearest = F.rint(scaled)
    return F.when(norm == nearest / extent, nearest).otherwise(scaled)


def crop_bounds(b: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Integer crop (left, top, right, bottom) of a pixel box: floor/ceil, inside the image, at least 1 px."""
    left = F.greatest(F.lit(0), F.least(width - 1, F.floor(b[0])))
    top = F.greatest(F.lit(0), F.least(height - 1, F.floor(b[1])))
    right = F.greatest(left + 1, F.least(width, F.ceil(b[2])))
    bottom = F.greatest(top + 1, F.least(height, F.ceil(b[3])))
    return tuple(c.cast("long") for c in (left, top, right, bottom))  # type: ignore[return-value]


def unrotate(b: Box, turn: Column) -> Box:
    """Map a box seen in a quarter-turned view (+1 counter-clockwise, -1 clockwise) to the source frame."""
    one = F.lit(1.0)
    ccw = (one - b[3], b[0], one - b[1], b[2])
    cw = (b[1], one - b[2], b[3], one - b[0])
    return tuple(F.when(turn == 1, p).when(turn == -1, q) for p, q in zip(ccw, cw))  # type: ignore


def pose_vs_selection(pose: Box, sel: Box) -> dict[str, Column]:
    """Distances and size ratios of a pose box against the selected box, in selection diagonals."""
    sw, sh = sel[2] - sel[0], sel[3] - sel[1]
    diag = F.hypot(sw, sh)
    dx = (pose[0] + pose[2]) / 2.0 - (sel[0] + sel[2]) / 2.0
    dy = (pose[1] + pose[3]) / 2.0 - (sel[1] + sel[3]) / 2.0
    gx = F.greatest(sel[0] - pose[2], pose[0] - sel[2], F.lit(0.0))
    gy = F.greatest(sel[1] - pose[3], pose[1] - sel[3], F.lit(0.0))
    return {
        "center_distance_norm": F.hypot(dx, dy) / diag,
        "edge_gap_norm": F.hypot(gx, gy) / diag,
        "pose_width_ratio": (pose[2] - pose[0]) / sw,
        "pose_height_ratio": (pose[3] - pose[1]) / sh,
        "pose_area_ratio": area(pose) / (sw * sh),
    }


def full_frame_iou(b: Box) -> Column:
    return clamp01(F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1]))


def redaction_bounds(b: Box, width: Column, height: Column, ratio: float):
    """Pixel region to redact: the box grown by ``ratio`` of its own size on every side."""
    px = to_pixels(b, width, height)
    pad_x, pad_y = (px[2] - px[0]) * ratio, (px[3] - px[1]) * ratio
    return crop_bounds((px[0] - pad_x, px[1] - pad_y, px[2] + pad_x, px[3] + pad_y), width, height)


# Fixed value: widest Gaussian applied without first shrinking the region.
MAX_DIRECT_SIGMA = 32.0


def blur_plan(width: Column, height: Column, sigma: Column) -> dict[str, Column]:
    """Working size and per-axis sigma; wide blurs run on a proportionally smaller image."""
    direct = sigma <= MAX_DIRECT_SIGMA
    scale = F.lit(MAX_DIRECT_SIGMA) / sigma
    tw = F.greatest(F.lit(1), F.floor(width * scale)).cast("long")
    th = F.greatest(F.lit(1), F.floor(height * scale)).cast("long")
    return {
        "blur_width": F.when(direct, width).otherwise(tw).cast("long"),
        "blur_height": F.when(direct, height).otherwise(th).cast("long"),
        "sigma_x": F.when(direct, sigma).otherwise(sigma * (tw / width)),
        "sigma_y": F.when(direct, sigma).otherwise(sigma * (th / height)),
    }
