"""Running the boundary stream over stored frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cutplan.sources.work import stored, work_dir
from cutplan.streaming.boundaries import OUT, track

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"


def stateful(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set(SETTING, ROCKSDB)
    return own


def start(spark: SparkSession, frames: str, schema: str, folder: str, trigger: dict, max_files: int | None = None, **limits: int) -> StreamingQuery:
    """Starts `track` over the files of a folder of frames; records go to `folder`/records, and a later start goes on from its checkpoint."""
    reader = stateful(spark).readStream.schema(schema)
    stream = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(frames)
    return (
        track(stream, **limits)
        .writeStream.queryName(f"boundaries_{uuid.uuid4().hex}")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(**trigger)
        .format("parquet")
        .option("path", f"{folder}/records")
        .start()
    )


def records_of_table(frames: DataFrame, batches: int = 3, **limits: int) -> DataFrame:
    """Writes the frames as `batches` groups of files, each the next part of every video, and streams them, about a group a
    micro-batch; the records of `track`.  So no frame has to be held, however long a video is; frames that come early or
    late are what other sources have."""
    spark = frames.sparkSession
    folder = work_dir(spark, "boundaries")
    last = F.max("frame_idx").over(W.partitionBy("video_id"))
    part = F.floor(F.col("frame_idx") * batches / (last + 1))
    rows = stored(frames.select("video_id", "frame_idx", "state", "gray", (last == F.col("frame_idx")).alias("is_last"), part.alias("part")), "stream-frames")
    for k in range(batches):
        rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{folder}/frames")
    found = spark.read.parquet(f"{folder}/frames")
    files = max(1, len(found.inputFiles()) // batches)
    start(spark, f"{folder}/frames", found.schema, folder, {"availableNow": True}, files, **limits).awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/records")


def boundaries_of_table(frames: DataFrame, batches: int = 3) -> DataFrame:
    """The records of pauses that a stream over the frames gives."""
    return records_of_table(frames, batches).where("kind = 'pause'").drop("kind")
