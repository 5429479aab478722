"""Face redaction plans and the decision per frame. Pixels are not touched here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .detections import Screened


def redaction_plan(faces: DataFrame, expand_ratio: float = 0.12, sigma_ratio: float = 0.16,
                   min_sigma: float = 5.0) -> DataFrame:
    """Pixel region and blur per face; needs a normalised box and the frame's ``width`` and ``height``."""
    bounds = g.redaction_bounds(g.box(), F.col("width"), F.col("height"), expand_ratio)
    df = faces.withColumns(dict(zip(("left_px", "top_px", "right_px", "bottom_px"), bounds)))
    w, h = F.col("right_px") - F.col("left_px"), F.col("bottom_px") - F.col("top_px")
    sigma = F.greatest(F.lit(min_sigma), F.least(w, h) * F.lit(sigma_ratio))
    return df.withColumns({**g.blur_plan(w, h, sigma), "sigma": sigma})


def privacy_actions(frames: DataFrame, faces: DataFrame, frame: Sequence[str] = ("source_id", "session_id", "frame_index"),
                    default_blur: bool = True, allow_unblur: bool = True, max_faces: int = 64) -> Screened:
    """What happens to every frame; frames with more faces than the bound are withheld, not shown.

    ``frames`` carries request_unblur and authorized_unblur.
    """
    counts = faces.groupBy(*frame).agg(F.count(F.lit(1)).alias("face_count"))
    action = (
        F.when(F.col("request_unblur") & F.col("authorized_unblur") & F.lit(allow_unblur), "unblur")
        .when(F.col("request_unblur"), "unblur_denied")
        .otherwise("blur" if default_blur else "policy_passthrough"))
    both = frames.join(counts, list(frame), "left").na.fill(0, ["face_count"]).withColumn("action", action)
    return Screened(
        both.filter(F.col("face_count") <= max_faces),
        both.filter(F.col("face_count") > max_faces).select(*frame, F.lit("withheld").alias("reason")))
