"""Frame sources and checks (A1, A2), template preparation (A4-A6), and the driver tables as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutplan.functions.frames import mean_abs_diff, proc_height
from cutplan.operators.prefix import numbered
from cutplan.operators.segments import BLOCK

FRAMES = T.StructType(
    [
        T.StructField("video_id", T.LongType()),
        T.StructField("frame_idx", T.LongType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("gray", T.ArrayType(T.ShortType())),
    ]
)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A1: stored frames, one row each; the schema is stated, so no file is read to infer it."""
    return spark.read.schema(FRAMES).parquet(path)


def number_frames(rows: DataFrame, video: str, order: list[str]) -> DataFrame:
    """A1 where there is no frame number: `video_id` and 0-based `frame_idx` in the given order.  One task has a whole video."""
    w = W.partitionBy(video).orderBy(*order)
    return rows.withColumn("video_id", F.col(video)).withColumn("frame_idx", F.row_number().over(w).cast("long") - 1)


def number_long_frames(rows: DataFrame, video: str, order: list[str], block: int = BLOCK) -> DataFrame:
    """The same for videos of any length: a prefix scan over range partitions of about `block` rows, which are written once."""
    return numbered(rows.withColumn("video_id", F.col(video)), ["video_id"], order, "frame_idx", block)


def audit_frames(frames: DataFrame, manifest: DataFrame) -> DataFrame:
    """A2: declared and decoded counts, frames with a bad payload, holes and repeats of frame_idx, a status.

    One row for each video of the manifest or the frames.  Holes are numbers from 0 to the last frame that no
    row has, repeats are rows beyond one of a number.  `unlisted` (no manifest row), `empty`, `bad_payload`,
    `not_dense` (holes or repeats), `short` (fewer than declared, accepted), `understated` (more), else `ok`.
    """
    bad = F.coalesce(F.size("gray") != F.col("w") * F.col("h"), F.lit(True))
    # counted by frame number first, so that rows of a long video meet partly aggregated
    numbers = frames.groupBy("video_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    got = numbers.groupBy("video_id").agg(
        F.sum("n").alias("decoded"), F.sum("bad").alias("n_bad"), (F.max("frame_idx") + 1 - F.count_if(F.col("frame_idx") >= 0)).alias("holes"), F.sum(F.col("n") - 1).alias("repeats")
    )
    both = manifest.select("video_id", F.col("declared_frames").alias("declared"), F.lit(True).alias("listed")).join(got, "video_id", "full")
    decoded, n_bad, holes, repeats = (F.coalesce(c, F.lit(0)) for c in ("decoded", "n_bad", "holes", "repeats"))
    status = (
        F.when(F.col("listed").isNull(), "unlisted")
        .when(decoded == 0, "empty")
        .when(n_bad > 0, "bad_payload")
        .when((holes > 0) | (repeats > 0), "not_dense")
        .when(decoded < F.col("declared"), "short")
        .when(decoded > F.col("declared"), "understated")
        .otherwise("ok")
    )
    return both.select(
        "video_id", F.coalesce("declared", F.lit(0)).alias("declared"), decoded.alias("decoded"), n_bad.alias("n_bad"), holes.alias("holes"), repeats.alias("repeats"), status.alias("status")
    )


def template_geometry(templates: DataFrame, proc_w: Column, proc_h: Column, extend: float = 2.0) -> DataFrame:
    """A4: search region and size of templates at processing size.

    Adds roi_x, roi_y, roi_w, roi_h, tw, th from x, y, w, h in a source picture of source_w x source_h.
    """
    sx, sy = proc_w.cast("double") / F.col("source_w"), proc_h.cast("double") / F.col("source_h")
    corner = lambda at, size, s: F.greatest(F.lit(0), (F.col(at) * s - F.col(size) * s * ((extend - 1) / 2)).cast("int"))
    return (
        templates.withColumn("roi_x", corner("x", "w", sx))
        .withColumn("roi_y", corner("y", "h", sy))
        .withColumn("roi_w", (F.col("w") * sx * extend).cast("int"))
        .withColumn("roi_h", (F.col("h") * sy * extend).cast("int"))
        .withColumn("tw", F.greatest(F.lit(1), (F.col("w") * sx).cast("int")))
        .withColumn("th", F.greatest(F.lit(1), (F.col("h") * sy).cast("int")))
    )


def processing_size(manifest: DataFrame, params: DataFrame) -> DataFrame:
    """A5: (video_id, proc_w, proc_h) with the height from the aspect ratio where it is the default."""
    return manifest.join(params.select("video_id", "proc_w", "proc_h"), "video_id").select(
        "video_id", "proc_w", proc_height(F.col("src_w"), F.col("src_h"), F.col("proc_w"), F.col("proc_h")).alias("proc_h")
    )


def usable_templates(templates: DataFrame, sources: DataFrame) -> DataFrame:
    """Templates of categories that also have a source picture."""
    return templates.join(sources.select("ctype").distinct(), "ctype", "left_semi")


# The driver's tables as frames


def _with_diff(rows: DataFrame, block: int) -> DataFrame:
    before = F.lag("gray").over(W.partitionBy("video_id").orderBy("frame_idx"))
    state = F.pmod(F.col("video_id") * 7 + F.floor(F.col("frame_idx") / block), F.lit(5)).cast("int")
    return rows.select(
        "video_id",
        "frame_idx",
        state.alias("state"),
        "gray",
        F.coalesce(mean_abs_diff(F.col("gray"), before), F.lit(0.0)).cast("float").alias("diff"),
    )


def events_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as frames: a video is a user, the one pixel is the value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    rows = number_frames(events, "user_id", ["ts", "event_id"])
    return _with_diff(rows.select("video_id", "frame_idx", F.array("value").alias("gray")), 12)


def lineitem_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as frames: a video is a supplier, the one pixel is the quantity."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_quantity", *keys)
    rows = number_frames(items, "l_suppkey", keys)
    return _with_diff(rows.select("video_id", "frame_idx", F.array("l_quantity").alias("gray")), 40)


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as strips of 64 pixels, 100 to a video."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return vectors.select(
        F.expr("vec_id div 100").alias("video_id"),
        (F.col("vec_id") % 100).alias("frame_idx"),
        F.lit(64).alias("w"),
        F.lit(1).alias("h"),
        F.col("embedding").cast("array<double>").alias("gray"),
        "label",
        "vec_id",
    )


# Template categories by embedding label.
CATEGORIES = {0: "pause", 1: "speed_1x", 2: "speed_2x", 3: "speed_0_2x"}


def embedding_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template per label 0-3: elements 16..47 of its vector with the smallest id; the region is the strip."""
    rows = embedding_frames(spark, sf_dir).where(F.col("label").between(0, 3))
    first = rows.groupBy("label").agg(F.min_by("gray", "vec_id").alias("gray"), F.min("vec_id").alias("vec_id"))
    name = F.element_at(F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))]), F.col("label"))
    t = F.slice("gray", 17, 32)
    return first.select(
        name.alias("ctype"),
        F.lit(0).alias("template_id"),
        "vec_id",
        F.lit(0).alias("roi_x"),
        F.lit(0).alias("roi_y"),
        F.lit(64).alias("roi_w"),
        F.lit(1).alias("roi_h"),
        F.lit(32).alias("tw"),
        F.lit(1).alias("th"),
        t.alias("t"),
        F.transform(t, lambda x: F.lit(True)).alias("m"),
    )
