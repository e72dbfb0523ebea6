"""Constants and column functions on frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of a frame, pause modes, mask values.
NORMAL, PAUSE, SPEED_1X, SPEED_2X, SPEED_02X = range(5)
AUTO_KEEP, AUTO_DELETE, MANUAL_DELETE, MANUAL_KEEP = range(4)


def value(x: object, kind: str) -> Column:
    """A parameter as a column: one for all, or a column where it differs by video."""
    return (x if isinstance(x, Column) else F.lit(x)).cast(kind)


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two pixel arrays; null where either is missing, empty or of another size."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def speed_label(state: Column) -> Column:
    return F.when(state == SPEED_2X, "2x").when(state == SPEED_1X, "1x").when(state == SPEED_02X, "0.2x").otherwise("other")


def clock_label(frame_idx: Column, fps: Column) -> Column:
    """`mm:ss` of a frame; minutes aren't wrapped at the hour, and no frame rate counts as second 0."""
    seconds = F.when(fps > 0, F.floor(frame_idx.cast("double") / fps)).otherwise(F.lit(0)).cast("long")
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), F.pmod(seconds, F.lit(60)))


def proc_height(w: Column, h: Column, proc_w: Column, proc_h: Column) -> Column:
    """Height from the aspect ratio where it was left at its default of 225."""
    derived = F.floor(proc_w.cast("double") * h.cast("double") / w.cast("double")).cast("int")
    return F.when((proc_h == 225) & (w > 0), derived).otherwise(proc_h.cast("int"))
