"""Counts of states along a video at halving resolutions, so that a viewport of any zoom reads few of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutplan.operators.lookup import bin_number, shown_bins

BASE, LEVELS = 64, 20


@dataclass(frozen=True)
class Pyramid:
    """`leaves` (video_id, block, a, b, state, deleted): runs of equal frames, a to b, cut at blocks of `base` frames.
    `nodes` (video_id, level, node, state, n, d): frames and deleted frames of each state in the
    `base` * 2^level frames from `node` times that many on.  Level `levels` is the last.
    """

    leaves: DataFrame
    nodes: DataFrame
    base: int = BASE
    levels: int = LEVELS


def build_pyramid(frames: DataFrame, base: int = BASE, levels: int = LEVELS) -> Pyramid:
    """From frames (video_id, frame_idx, state, deleted), whose indices don't repeat.

    A block's runs are found within the block, so no task has a whole video.  Nodes are sums of runs: each
    goes to its node of every level and is summed before the one shuffle, in which upper levels have few rows.
    """
    if base < 1 or levels < 1:
        raise ValueError("base and levels are at least 1")
    key = ["video_id", "block", "state", "deleted"]
    placed = frames.select("video_id", "frame_idx", "state", "deleted", F.floor(F.col("frame_idx") / base).alias("block"))
    group = F.col("frame_idx") - F.row_number().over(W.partitionBy(*key).orderBy("frame_idx"))
    runs = placed.withColumn("_g", group).groupBy(*key, "_g").agg(F.min("frame_idx").cast("long").alias("a"), F.max("frame_idx").cast("long").alias("b"))
    leaves = runs.select("video_id", "block", "a", "b", "state", "deleted")
    return Pyramid(leaves, _nodes(leaves, levels), base, levels)


def _nodes(leaves: DataFrame, levels: int) -> DataFrame:
    n = F.col("b") - F.col("a") + 1
    sums = [F.sum("n").alias("n"), F.sum("d").alias("d")]
    blocks = leaves.select("video_id", "block", "state", n.alias("n"), F.when(F.col("deleted"), n).otherwise(0).alias("d"))
    blocks = blocks.groupBy("video_id", "block", "state").agg(*sums)
    raised = blocks.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", F.call_function("shiftright", "block", "level"))
    return raised.groupBy("video_id", "level", "node", "state").agg(*sums)


def write_pyramid(pyramid: Pyramid, path: str) -> Pyramid:
    """Writes both tables below `path`, a folder a level, rows of a video together, and goes on from the files.
    Nodes are made from the written leaves, so frames are read once."""
    spark = pyramid.leaves.sparkSession
    order = ["video_id", "block"]
    pyramid.leaves.sortWithinPartitions(*order).write.parquet(f"{path}/leaves")
    nodes = _nodes(spark.read.parquet(f"{path}/leaves"), pyramid.levels)
    nodes.sortWithinPartitions("level", "video_id", "node").write.partitionBy("level").parquet(f"{path}/nodes")
    return read_pyramid(spark, path, pyramid.base, pyramid.levels)


def read_pyramid(spark: SparkSession, path: str, base: int = BASE, levels: int = LEVELS) -> Pyramid:
    """What `write_pyramid` wrote; `base` and `levels` as they were then."""
    nodes = spark.read.schema("video_id long, node long, state int, n long, d long, level int").parquet(f"{path}/nodes")
    return Pyramid(spark.read.parquet(f"{path}/leaves"), nodes, base, levels)


def _first_frame(bin_no: Column, width: int, zoom: float, scroll: float) -> Column:
    """The first frame that is in bin `bin_no` or after it, by the arithmetic that places single frames.

    The inverse is rounded, so the frames beside it are tried by the forward formula, which never falls.
    """
    total = F.col("total")
    near = F.ceil((bin_no.cast("double") / F.lit(float(zoom) * float(width)) + F.lit(float(scroll))) * total.cast("double")).cast("long")
    tried = [F.when(bin_number(near + k, total, width, zoom, scroll) >= bin_no, near + k) for k in (-2, -1, 0, 1)]
    return F.greatest(F.lit(0), F.least(F.coalesce(*tried, near + 2), total))


def viewport_pieces(pyramid: Pyramid, lengths: DataFrame, width: int, zoom: float = 1.0, scroll: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """What a viewport reads: (video_id, bin, level, node) of whole nodes and (video_id, bin, block, lo, hi) of parts of blocks.

    A bin has at most two nodes a level, below the last, and two parts of blocks.
    """
    base, top = pyramid.base, pyramid.levels
    pixel = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))
    bins = lengths.select("video_id", "total", pixel.alias("bin")).select(
        "video_id",
        "bin",
        _first_frame(F.col("bin"), width, zoom, scroll).alias("lo"),
        _first_frame(F.col("bin") + 1, width, zoom, scroll).alias("hi"),
    )
    bins = bins.where("lo < hi").withColumns({"a": F.ceil(F.col("lo") / base).cast("long"), "z": F.floor(F.col("hi") / base).cast("long")})
    a, z = F.col("a"), F.col("z")

    def ends(level: Column) -> tuple[Column, Column]:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        return F.call_function("shiftright", a + size - 1, level), F.call_function("shiftright", z, level)

    def at_level(level: Column) -> Column:
        lo, hi = ends(level)
        return F.array(
            F.struct(level.alias("level"), lo.alias("node"), ((lo < hi) & (lo % 2 == 1)).alias("taken")),
            F.struct(level.alias("level"), (hi - 1).alias("node"), ((lo < hi) & (hi % 2 == 1)).alias("taken")),
        )

    below = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top - 1)), at_level)), lambda x: x["taken"])
    lo, hi = ends(F.lit(top))
    rest = F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda k: F.struct(F.lit(top).alias("level"), k.alias("node"), F.lit(True).alias("taken"))))
    whole = bins.select("video_id", "bin", F.explode(F.concat(below, F.coalesce(rest, F.array().cast("array<struct<level:int,node:bigint,taken:boolean>>")))).alias("x"))

    def part(block: Column, first: Column | str, past: Column | str) -> Column:
        return F.struct(block.alias("block"), first.alias("lo"), past.alias("hi"))

    inside = F.array(part(a - 1, F.col("lo"), F.col("hi")))
    edges = F.array(part(a - 1, F.col("lo"), a * base), part(z, z * base, F.col("hi")))
    parts = bins.select("video_id", "bin", F.explode(F.filter(F.when(a > z, inside).otherwise(edges), lambda x: x["lo"] < x["hi"])).alias("x"))
    return whole.select("video_id", "bin", "x.level", "x.node"), parts.select("video_id", "bin", "x.*")


def viewport_bins(pyramid: Pyramid, lengths: DataFrame, width: int, zoom: float = 1.0, scroll: float = 0.0) -> DataFrame:
    """G4 from the pyramid, the rows of `timeline_bins`: no frames are read."""
    whole, parts = viewport_pieces(pyramid, lengths, width, zoom, scroll)
    key = ["video_id", "bin", "state", "n", "d"]
    n = F.least(F.col("b") + 1, F.col("hi")) - F.greatest("a", "lo")
    cut = parts.join(pyramid.leaves, ["video_id", "block"]).withColumn("n", n).where("n > 0")
    cut = cut.withColumn("d", F.when(F.col("deleted"), F.col("n")).otherwise(0))
    return shown_bins(whole.join(pyramid.nodes, ["video_id", "level", "node"]).select(*key).unionByName(cut.select(*key)))
