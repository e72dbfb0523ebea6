"""Small helpers that the training-data operators share: tables, work folders, digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: `[\x20\x09-\x0D]`, the white space of every text contract here.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for tables that cut lineage, below `spark.checkpoint.dir`.

    That folder is shared by all executors, so what is written there outlives a lost one.
    Where the setting is missing on one machine (tests) a temporary folder is used; a cluster must have it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: a query's shuffle files are deleted from all executors as soon as it ends.
CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, folder: str, clear: bool = False) -> DataFrame:
    """Write `df` once and go on from the files: lineage ends here.

    With `clear` the shuffle files of the write go when it ends; else they stay on the executors' disks until
    the driver's heap happens to be collected.  The setting is the session's and is put back, also after an
    error; a query that runs beside the write at worst makes its own shuffles anew.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEAR, "false")
    try:
        if clear:
            conf.set(CLEAR, "true")
        df.write.parquet(folder)
    finally:
        if clear:
            conf.set(CLEAR, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spare(taken: list[str], stem: str) -> str:
    """A column name that isn't taken, whatever the case of letters."""
    used = {t.lower() for t in taken}
    return next(n for k in range(len(taken) + 1) if (n := f"{stem}{k or ''}").lower() not in used)


def once(value: Column) -> Column:
    """The value made once a row: a generator is a barrier that projections aren't merged across, so a
    lambda that uses the column doesn't make it anew for every element."""
    return F.explode(F.array(value))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; `lower` does that for pure ASCII and is faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % F.lit(n)


def with_column(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of `df` and one more column, of a type in DDL."""
    return T.StructType([*df.schema.fields, T.StructField(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType)])


#: A table of DuckDB SQL, the steps of CRC-32 for every byte, and the checksum of a text's UTF-8 by it.
CRC_TABLE = """
crc_step AS (
  SELECT b, 0 AS k, CAST(b AS UBIGINT) AS c FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END FROM crc_step WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY b) AS steps FROM crc_step WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """Unsigned crc32 of a text expression, in a query from `crc_table` too; needs `CRC_TABLE` among the recursive tables."""
    digits = f"hex(encode({text}))"
    byte = f"CAST('0x' || substr({digits}, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT)"
    codes = f"list_transform(range(0, length({digits}) // 2), lambda i: {byte})"
    step = "xor(c // 256, steps[CAST(xor(c % 256, b) AS BIGINT) + 1])"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"
