"""Parameters per video: defaults, permitted ranges, derived values (A3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default, least and largest permitted value of each number.
NUMBERS = {
    "thr_pause": (0.7, 0.1, 1.0),
    "thr_1x": (0.7, 0.1, 1.0),
    "thr_2x": (0.7, 0.1, 1.0),
    "thr_02x": (0.7, 0.1, 1.0),
    "still_time": (0.1, 0.01, 2.0),
    "motion_thresh": (2.0, 0.1, 50.0),
    "boundary_thresh": (5.0, 0.0, 50.0),
    "factor_02": (10.0, 2.0, 20.0),
    "proc_w": (400.0, 100.0, 1920.0),
    "proc_h": (225.0, 100.0, 1080.0),
}
FLAGS = {"speedup_1x": True, "speedup_02": True, "split_by_speed": False, "merge_pause": True}
FPS = 30.0
WHOLE = ("factor_02", "proc_w", "proc_h")


def still_frames(fps: Column, still_time: Column) -> Column:
    """Frames to keep: the product is cut in double, at least 2."""
    return F.greatest(F.lit(2), (fps.cast("double") * still_time.cast("double")).cast("int"))


def resolve_params(params: DataFrame) -> DataFrame:
    """One row per row of `params`: defaults where a column is null or missing, `still_frames`, and
    `in_range`, false where a given number is outside what is permitted (it is kept as given)."""
    have = set(params.columns)
    col = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    out = params.select(
        "video_id",
        F.when(col("fps", "double") > 0, col("fps", "double")).otherwise(F.lit(FPS)).alias("fps"),
        *[F.coalesce(col(n, "double"), F.lit(d[0])).alias(n) for n, d in NUMBERS.items()],
        *[F.coalesce(col(n, "boolean"), F.lit(d)).alias(n) for n, d in FLAGS.items()],
    )
    inside = F.lit(True)
    for name, (_, low, high) in NUMBERS.items():
        inside &= F.col(name).between(low, high)
    out = out.withColumn("in_range", inside)
    for name in WHOLE:
        out = out.withColumn(name, F.col(name).cast("int"))
    return out.withColumn("still_frames", still_frames(F.col("fps"), F.col("still_time")))
