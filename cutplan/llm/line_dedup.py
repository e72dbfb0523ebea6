"""Operator 1, native: line dedup over levelled sorted runs of line hashes.

Lines are hashed once, into a table of (batch, d, tag, pos, h1, h2); batches are ranges of doc_id.  They
are added from the largest ids down, so the first batch that has a line has its largest doc_id.  The
store holds runs: tables of distinct 128-bit line hashes with the doc_id that owns them, bucketed and
sorted by the hash.  Each batch is grouped by hash and merge-anti-joins the runs: hashes that no run
holds are the batch's own run, owned by the batch's largest doc_id that has the line; for the others the
join brings the owner along.  Runs are disjoint, so `fanout` runs of one level merge into one of the next
without any summing, and a hash is rewritten log(batches) times in all.

Only lines that are met again can go, and only they are counted: every batch leaves the hashes that it
repeats, with the number of documents besides the owner.  `min_docs` counts over the whole table, so no
batch can decide it alone; one aggregate over these repeats does, and one pass over the hashed lines
finds the places that go.  Only hashes and places move, never line texts, but for the texts that lose
a line's place in the last join.

Defined results: null or empty text is one empty line; rows with the same doc_id are one document
when documents are counted, and each row gets its own result; a null doc_id is one document, smaller
than every other; an empty table gives an empty table; extra columns are passed through, and the
result column replaces one of the same name.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutplan.llm.shared import SPACE, ascii_lower, once, saved, work_dir

#: Stands for a null doc_id where ids are compared.
LEAST = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _rank(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LEAST))


def hashed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(d, tag, pos, h1, h2) for each line whose key is long enough; tag tells apart rows of one id."""
    lines = docs.select(
        _rank(F.col(doc_id)).alias("d"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"),
    ).where(F.char_length("line") >= min_chars)
    keyed = lines.select("d", "tag", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    return keyed.select("d", "tag", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2"))


class LineRuns:
    """The levelled store.  `add` takes batches of `hashed_lines`, each of smaller doc_ids than those before."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 2):
        self.spark, self.fanout, self.folder = spark, fanout, folder
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.repeats: list[DataFrame] = []
        self.names: list[str] = []

    def _write(self, rows: DataFrame, *parts: str) -> DataFrame:
        """A table that Spark knows as bucketed and sorted by the hash, so that joins on it don't exchange it."""
        self.names.append(f"line_runs_{uuid.uuid4().hex}")
        dealt = rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        (dealt.partitionBy(*parts) if parts else dealt).option("path", f"{self.folder}/{self.names[-1]}").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def _compact(self) -> None:
        """Full levels are merged into a run of the next; runs share no hash."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(reduce(DataFrame.unionByName, self.levels[level]).repartition(self.buckets, "h1", "h2")))
                self.levels[level] = []
            level += 1

    def add(self, lines: DataFrame) -> None:
        self._compact()
        held = [run for level in self.levels for run in level]
        batch = lines.select("h1", "h2", "d").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("top"))
        owner = F.lit(None).cast("long")
        for k, run in enumerate(held):
            batch = batch.join(run.select("h1", "h2", F.col("owner").alias(f"o{k}")).hint("merge"), ["h1", "h2"], "left")
            owner = F.coalesce(owner, F.col(f"o{k}"))
        fresh = owner.isNull()
        marked = batch.select("h1", "h2", F.coalesce(owner, F.col("top")).alias("owner"), (F.col("n") - F.when(fresh, 1).otherwise(0)).alias("again"), fresh.alias("fresh"))
        done = self._write(marked, "fresh")
        self.levels[0].append(done.where("fresh").select("h1", "h2", "owner"))
        self.repeats.append(done.where("again > 0").select("h1", "h2", "owner", "again"))

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, owner) of lines that at least `min_docs` documents hold, the owner among them."""
        total = reduce(DataFrame.unionByName, self.repeats).groupBy("h1", "h2").agg(F.sum("again").alias("n"), F.max("owner").alias("owner"))
        return total.where(F.col("n") + 1 >= min_docs).select("h1", "h2", "owner")

    def forget(self) -> None:
        """Takes the tables' names out of the session's catalog; their files stay in the folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def batch_bounds(docs: DataFrame, doc_id: str, text: str, batches: int, batch_bytes: int) -> list[int]:
    """Least doc_ids of all but the last batch, falling; as many batches as texts of `batch_bytes` each need."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    batches = max(batches, -(-total // batch_bytes))
    if batches < 2:
        return []
    cuts = docs.select(F.percentile_approx(F.col(doc_id).cast("long"), [i / batches for i in range(1, batches)], 10 * batches)).first()[0]
    return sorted(set(cuts or []), reverse=True)


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    out: str = "line_dedup",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 3,
    batch_bytes: int = 1 << 40,
    fanout: int = 2,
) -> DataFrame:
    """All columns of `docs` plus `out`: struct<n_lines, n_dropped: bigint, kept: string>.

    There are at least `batches` batches, and more where a batch would have more than about `batch_bytes` of text.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "line-runs")
    bounds = batch_bounds(docs, doc_id, text, batches, batch_bytes)
    number = F.lit(0)
    for low in bounds:
        number = number + F.when(F.col("d") < low, 1).otherwise(0)
    hashed_lines(docs, doc_id, text, min_chars).withColumn("batch", number).write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema("d long, tag long, pos int, h1 long, h2 long, batch int").parquet(f"{folder}/lines")
    runs = LineRuns(spark, folder, fanout)
    try:
        for k in range(len(bounds) + 1):
            runs.add(lines.where(F.col("batch") == k))
        frequent = saved(runs.frequent(min_docs), f"{folder}/frequent")
    finally:
        runs.forget()
    gone = lines.join(frequent, ["h1", "h2"]).where(F.col("owner") > F.col("d"))
    gone = gone.groupBy("d", "tag").agg(F.array_sort(F.collect_set("pos")).alias("_gone"))

    names = docs.columns
    held = [f"_c{i}" for i in range(len(names))]
    body = F.coalesce(F.col(held[names.index(text)]), F.lit(""))
    pieces = docs.toDF(*held).withColumn("d", _rank(F.col(held[names.index(doc_id)]))).withColumn("tag", F.xxhash64(body))
    joined = pieces.join(gone, ["d", "tag"], "left")
    lined = joined.select(*held, F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"), once(F.split(body, "\n")).alias("_lines"))
    numbers = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.when(F.size("_gone") == 0, body).otherwise(
        F.array_join(F.transform(F.array_except(numbers, F.col("_gone")), lambda i: F.get("_lines", i)), "\n")
    )
    result = F.struct(
        F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"), kept.alias("kept")
    )
    done = lined.select(*held, once(result).alias("_out"))
    columns = [F.col("_out").alias(out) if n == out else F.col(h).alias(n) for n, h in zip(names, held, strict=True)]
    return done.select(*columns, *([] if out in names else [F.col("_out").alias(out)]))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: doc_id, n_lines, n_dropped, kept_sha256."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("line_dedup.n_lines").alias("n_lines"),
        F.col("line_dedup.n_dropped").alias("n_dropped"),
        F.sha2(F.col("line_dedup.kept").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = """
WITH body AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM body),
line AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM split
),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
),
hot AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
),
marked AS (SELECT y.doc_id, y.i, y.line, h.k IS NOT NULL AND h.top <> y.doc_id AS gone FROM keyed y LEFT JOIN hot h ON y.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
