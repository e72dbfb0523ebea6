"""Numbers and sums along an order, over range partitions of rows instead of one task a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutplan.operators.segments import BLOCK
from cutplan.sources.work import work_dir


def ranged(rows: DataFrame, keys: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """`rows` with `_part` and `_row`, written: sorted by keys and order over all partitions, of about `block` rows each.

    Range bounds are sampled, so the partitions are written before they're counted: what is read again has the same bounds.
    Rows equal in keys and order meet in one partition; everything else is spread whatever a key's share.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // block))
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    folder = f"{work_dir(spark, 'ranged')}/rows"
    # the identifier holds the partition above 33 bits and the place in it below
    dealt.withColumn("_id", F.monotonically_increasing_id()).write.parquet(folder)
    stored = spark.read.parquet(folder)
    return stored.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def _before(totals: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Totals (keys, _part, name) with `_before`, the sum of name over the parts before.  There is a row a key and part."""
    along = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum(name).over(along), F.lit(0)))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, block: int = BLOCK) -> DataFrame:
    """Adds `name`, a row's number from 0 among those of its keys in the given order.  Keys may be null."""
    placed = ranged(rows, keys, order, block)
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    starts = _before(counts, keys, "_n").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before", "_first")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")]
    number = F.col("_before") + F.col("_row") - F.col("_first")
    return placed.join(starts, on).withColumn(name, number).select(*rows.columns, name)


def running_sum(rows: DataFrame, keys: list[str], order: list[str], what: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds `name`, the sum of `what` over a row and those before it in its keys by the given order; equal rows in some order."""
    placed = ranged(rows.withColumn("_what", what), keys, order, block)
    own = F.sum("_what").over(W.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(W.unboundedPreceding, 0))
    totals = placed.groupBy(*keys, "_part").agg(F.sum("_what").alias("_n"))
    starts = _before(totals, keys, "_n").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")]
    return placed.withColumn("_own", own).join(starts, on).withColumn(name, F.col("_before") + F.coalesce("_own", F.lit(0))).select(*rows.columns, name)
