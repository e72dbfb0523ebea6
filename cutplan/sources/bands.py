"""Frames whose one-byte pixels are stored in bands of rows, so that a scan reads only the rows it needs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"gray_(\d+)_(\d+)")


def banded(frames: DataFrame, rows: int, tallest: int) -> DataFrame:
    """`gray`, one byte a pixel, as columns `gray_0_<rows>`, `gray_<rows>_<2 rows>`, ... up to `tallest` rows.

    Regions at the top of a picture leave the columns below unread.  Bands below a picture's end are empty; a
    null picture has null bands.  Rows beyond the last band raise an error.
    """
    size, n = F.col("w") * rows, -(-tallest // rows)
    fits = F.coalesce(F.octet_length("gray") <= size.cast("long") * n, F.lit(True))
    gray = F.when(fits, F.col("gray")).otherwise(F.raise_error(F.lit(f"a picture has more than {n * rows} rows")))
    cut = {f"gray_{k * rows}_{(k + 1) * rows}": F.substring(gray, (size * k + 1).cast("int"), size.cast("int")) for k in range(n)}
    return frames.withColumns(cut).drop("gray")


def band_columns(frames: DataFrame) -> list[str]:
    """The columns of the bands from the top, none for frames with whole pictures."""
    return sorted((c for c in frames.columns if NAME.fullmatch(c)), key=lambda c: int(NAME.fullmatch(c)[1]))


def band_rows(names: list[str]) -> int:
    return int(NAME.fullmatch(names[0])[2])


def whole(frames: DataFrame) -> DataFrame:
    """The pictures of `banded` frames as `gray` again."""
    names = band_columns(frames)
    return frames.withColumn("gray", F.concat(*names)).drop(*names)
