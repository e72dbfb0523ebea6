"""A1: a store of frames that is dealt once, so that work along a video needs no exchange of frames.

Frames lie in a table bucketed by (video, block) and sorted by frame.  A block also holds the frame before
it and the one after it, marked as not its own, so differences to the frame before, runs, activity and the
pixels beside a pause are found where the block lies; what is exchanged is the far smaller table of runs.
A bucket is one file and one task's work: choose `buckets` so that a bucket is a few hundred MB.

A store is a folder: the table, under a name of its own, and one row that says how it is dealt, written
last.  A folder without that row is a store that was not finished and can't be opened.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutplan.functions.frames import mean_abs_diff
from cutplan.operators.segments import BLOCK, blocked, runs_in_blocks
from cutplan.plans.runs import runs_of_blocks

#: How a store is dealt: the table's folder and columns, frames a block, number of buckets.
DEALT = T.StructType(
    [
        T.StructField("folder", T.StringType()),
        T.StructField("columns", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("buckets", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class FrameStore:
    """`dealt`: all columns of the frames, `_block` and `_own`; edge frames are in it more than once."""

    dealt: DataFrame
    block: int
    buckets: int

    @property
    def frames(self) -> DataFrame:
        """The frames as they were written, each once."""
        return self.dealt.where("_own").drop("_block", "_own")

    def frame_diff(self) -> DataFrame:
        """B1 without an exchange: the frames with `diff`, in place of a stored one."""
        return _with_diff(self.dealt).where("_own").drop("_block", "_own")

    def state_runs(self) -> DataFrame:
        """C1 by one exchange of runs, none of frames."""
        return runs_in_blocks(self.dealt.where("_own").select("video_id", "frame_idx", "state", "_block"))

    def frame_runs(self, motion_thresh: float | Column, keep: tuple[str, ...] = ()) -> DataFrame:
        """`plans.runs.frame_runs` of the frames by one exchange of runs, none of frames; differences are
        taken from the pixels, so a stored `diff` isn't read.  C5 and C7 follow from its rows."""
        return runs_of_blocks(_with_diff(self.dealt), motion_thresh, keep)


def _with_diff(dealt: DataFrame) -> DataFrame:
    """Adds `diff`; that of the frame before a block has no predecessor there, and no own frame looks at it."""
    before = F.lag("gray").over(W.partitionBy("video_id", "_block").orderBy("frame_idx"))
    return dealt.withColumn("diff", F.coalesce(mean_abs_diff(F.col("gray"), before), F.lit(0.0)).cast("float"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write_store(frames: DataFrame, path: str, block: int = BLOCK, buckets: int | None = None) -> FrameStore:
    """Writes frames (video_id, frame_idx dense from 0, more) to `path`, a new folder that all executors share.

    Frames are exchanged once.  Numbers that are missing or repeat stay as they are (`audit_frames` finds
    them).  The names `_block` and `_own` are the store's.
    """
    if block < 1:
        raise ValueError("a block has at least one frame")
    if taken := {"_block", "_own"} & {c.lower() for c in frames.columns}:
        raise ValueError(f"columns of the store's own: {sorted(taken)}")
    spark = frames.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"frames_{uuid.uuid4().hex}"
    # the writer's buckets go by the same hash as the exchange, so each bucket is one file
    rows = blocked(frames, block).repartition(buckets, "video_id", "_block")
    table = rows.write.bucketBy(buckets, "video_id", "_block").sortBy("video_id", "_block", "frame_idx").format("parquet")
    try:
        table.option("path", f"{path}/{name}").saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.createDataFrame([(name, rows.schema.json(), block, buckets)], DEALT).coalesce(1).write.parquet(f"{path}/dealt")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> FrameStore:
    """A store of this or another session.  The catalog holds the table only until its plan is made."""
    row = spark.read.schema(DEALT).parquet(f"{path}/dealt").first()
    folder = f"{path}/{row.folder}"
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(row["columns"])))
    name = f"frames_{uuid.uuid4().hex}"
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (video_id, _block) SORTED BY (video_id, _block, frame_idx)"
        f" INTO {row.buckets} BUCKETS LOCATION '{place}'"
    )
    try:
        dealt = spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return FrameStore(dealt, row.block, row.buckets)
