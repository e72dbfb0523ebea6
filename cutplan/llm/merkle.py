"""Operator 11: a Merkle manifest of a table, with checkpoint-and-recompute proofs.

Rows are leaves; each group of rows (a source) has a tree over its leaves in order, and the groups' roots
have a tree of the same kind.  A run of `FANOUT` neighbours becomes their parent.

1. Leaves are hashed in one pass over the texts and written; no text moves.  Their places come from range
   partitions: rows are sorted by (group, order), written, counted by partition, and the counts before a
   partition are added, so a group of any size is numbered without a task that sees all of it.
2. Only every `stride`-th level is stored.  A stored level is cut into aligned subtrees of at most
   `FANOUT ** stride` nodes; each gives its root to the next stored level and drops the levels between.
3. Proofs come from the top down.  A stored level's subtrees are read again, the levels between are made
   anew from the stored nodes, the siblings of every node are emitted and the levels dropped; what lies above
   a subtree's root is the path of that node, which the stored level above has just given.

A lost executor costs a stored level at most.  Work is a hash a node in both directions.

Defined results: a null field is `-`; a null group is a group of its own and the first; null ids come first
in their group; rows with equal ids are ordered by their leaf, so equal rows are neighbours and each has
its own proof; an empty table has no rows and no root; extra columns aren't used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutplan.llm.shared import CRC_TABLE, crc_sql, saved, work_dir

FANOUT = 3
#: Rows of a range partition when leaves are put in order.
PART_ROWS = 200_000
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def combined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def levels(digests: list[str], steps: int) -> list[list[str]]:
    """The nodes of a subtree: its leaves, and `steps` levels of parents."""
    out = [digests]
    for _ in range(steps):
        below = out[-1]
        out.append([combined(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def numbered(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """Adds `pos`, a row's place in its group `g` by `order` from 0, and `n`, the group's rows."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    dealt = rows.repartitionByRange(tasks, "g", *order).sortWithinPartitions("g", *order)
    # the number of a row holds its partition above 33 bits and its place in the partition below
    dealt = saved(dealt.withColumn("_id", F.monotonically_increasing_id()), folder)
    part, row = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy("g", part).agg(F.count(F.lit(1)).alias("_k"), F.min(row).alias("_first"))
    group = W.partitionBy("g")
    before = F.coalesce(F.sum("_k").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_k").over(group).alias("n"))
    placed = dealt.withColumn("_part", part).withColumn("_row", row).join(starts, ["g", "_part"])
    return placed.withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift", "_id")


def subtrees(nodes: DataFrame, span: int, *payload: str) -> DataFrame:
    """(g, block, n, nodes): the aligned runs of `span` nodes of a stored level, in order."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "digest", *payload)))
    return nodes.groupBy("g", F.floor(F.col("pos") / span).cast("long").alias("block")).agg(F.first("n").alias("n"), cells.alias("nodes"))


def _digests(column: pa.Array) -> Iterator[list[str]]:
    """The digests of each block of a column of arrays of them."""
    flat, at = column.flatten().to_pylist(), 0
    for size in column.value_lengths().to_pylist():
        yield flat[at : at + size]
        at += size


def subtree_roots(nodes: DataFrame, stride: int) -> DataFrame:
    """The next stored level: (g, pos, n, digest) of the roots of a level's subtrees."""
    span = FANOUT**stride

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_pylist()
            roots = [levels(d, min(stride, height(size)))[-1][0] for size, d in zip(n, _digests(batch.column(3)), strict=True)]
            above = pa.array([-(-size // span) for size in n], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), above, pa.array(roots, pa.string())], names=["g", "pos", "n", "digest"])

    cut = subtrees(nodes, span).select("g", "block", "n", F.transform("nodes", lambda x: x["digest"]).alias("digests"))
    return cut.mapInArrow(run, "g string, pos long, n long, digest string")


def sibling_lists(blocks: list[list[str]], steps: list[int]) -> pa.Array:
    """For every node of every block, and each level inside the block, the siblings left and right of it or of its ancestor."""
    left: list[str] = []
    right: list[str] = []
    depth: list[int] = []
    for digests, climb in zip(blocks, steps, strict=True):
        tree = levels(digests, climb)[:-1]
        for i in range(len(digests)):
            at = i
            for nodes in tree:
                lo = at - at % FANOUT
                left.append("".join(nodes[lo:at]))
                right.append("".join(nodes[at + 1 : lo + FANOUT]))
                at //= FANOUT
            depth.append(len(tree))
    pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *depth]), pa.int32()), pairs)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, blocks)]), pa.int32()), inner)


#: Subtrees whose paths leave a worker together.
EMIT = 32


def subtree_paths(nodes: DataFrame, stride: int, *payload: str) -> DataFrame:
    """(g, block, pos, digest, payload, path): every node of a level with its path to its subtree's root."""
    cut = subtrees(nodes, FANOUT**stride, *payload).withColumn("digests", F.transform("nodes", lambda x: x["digest"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, EMIT):
                part = batch.slice(lo, EMIT)
                blocks = list(_digests(part.column(4)))
                paths = sibling_lists(blocks, [min(stride, height(n)) for n in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 1, 3)), paths], names=["g", "block", "nodes", "paths"])

    kind = cut.schema["nodes"].dataType.simpleString()
    made = cut.select("g", "block", "n", "nodes", "digests").mapInArrow(run, f"g string, block long, nodes {kind}, paths array<{PATH}>")
    each = made.select("g", "block", F.explode(F.arrays_zip("nodes", "paths")).alias("x"))
    return each.select("g", "block", "x.nodes.*", F.col("x.paths").alias("path"))


@dataclass
class Tree:
    """The stored levels of the trees of all groups: (g, pos, n, digest, and the payload in the first)."""

    stored: list[DataFrame]
    payload: tuple[str, ...]
    stride: int
    folder: str

    def roots(self) -> DataFrame:
        """(g, digest, leaves) of each group."""
        tops = [level.where("n = 1").select("g", "digest") for level in self.stored]
        out = tops[0]
        for top in tops[1:]:
            out = out.union(top)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """(digest, payload, path, tops) of every leaf.  `above` (g, path, tops) is what lies above the groups' roots.

        A level's paths are written before the level below is read, all but the leaves'.
        """
        upper = None
        for k in range(len(self.stored) - 1, -1, -1):
            level, payload = self.stored[k], self.payload if k == 0 else ()
            columns = ["g", "pos", "digest", *payload, "path", "tops"]
            done = level.where("n = 1").join(above, "g").select(*columns)
            if upper is not None:
                inner = subtree_paths(level.where("n > 1"), self.stride, *payload)
                over = upper.select("g", F.col("pos").alias("block"), F.col("path").alias("_over"), "tops")
                inner = inner.join(over, ["g", "block"]).withColumn("path", F.concat("path", "_over"))
                done = done.union(inner.select(*columns))
            upper = saved(done, f"{self.folder}/paths-{k}") if k else done
        return upper.drop("g", "pos")


def tree(leaves: DataFrame, order: list[str], payload: tuple[str, ...], stride: int, folder: str) -> Tree:
    """Trees of leaves (g, digest, payload), whose order in their group is by `order`."""
    placed = numbered(leaves, order, f"{folder}/ordered").select("g", "pos", "n", "digest", *payload)
    stored = [saved(placed, f"{folder}/level-0")]
    most = stored[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        stored.append(saved(subtree_roots(stored[-1].where("n > 1"), stride), f"{folder}/level-{stride * len(stored)}"))
        most = -(-most // FANOUT**stride)
    return Tree(stored, payload, stride, folder)


@dataclass
class Manifest:
    """The stored levels over a table's rows and over the groups' roots, and the root of all (null for an empty table)."""

    rows: Tree
    groups: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """(doc_id, other, leaf, subroot, root, path) of every row; `path` holds the siblings left and right at each level up to the root."""
        nothing = F.array().cast(PATH)
        top = self.groups.paths(self.groups.roots().select("g", nothing.alias("path"), F.array("digest").alias("tops")))
        above = saved(top.select(F.col("key").alias("g"), "path", F.concat(F.array("digest"), "tops").alias("tops")), f"{self.groups.folder}/above")
        found = self.rows.paths(above)
        return found.select("doc_id", "other", F.col("digest").alias("leaf"), F.get("tops", F.lit(0)).alias("subroot"), F.get("tops", F.lit(1)).alias("root"), "path")


def group_key(source: Column) -> Column:
    """A text that sorts as the source does, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    doc_id: str = "doc_id",
    source: str = "source",
    other: Column | None = None,
    stride: int = 4,
    folder: str | None = None,
) -> Manifest:
    """Builds and stores the manifest of the given fields of `docs`, below `folder`.

    `other` is a further text carried with each row to its proof, such as the leaf of another copy of the row.
    """
    folder = folder or work_dir(docs.sparkSession, "merkle")
    made = docs.select(
        group_key(F.col(source)).alias("g"),
        F.col(doc_id).alias("doc_id"),
        leaf(*[F.col(f) for f in fields]).alias("digest"),
        (F.lit(None).cast("string") if other is None else other).alias("other"),
    )
    rows = tree(saved(made, f"{folder}/leaves"), ["doc_id", "digest"], ("doc_id", "other"), stride, f"{folder}/rows")
    tops = rows.roots().select(F.lit("").alias("g"), F.col("g").alias("key"), "digest")
    groups = tree(saved(tops, f"{folder}/subroots"), ["key"], ("key",), stride, f"{folder}/groups")
    root = groups.roots().first()
    return Manifest(rows, groups, root and root.digest)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda x, p: F.sha2(F.concat(p["left"], x, p["right"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def verify(held: DataFrame, proofs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, verified) of each held row: whether a proof (doc_id, leaf, root, path) of its id starts from the row's own leaf and folds to its root."""
    mine = held.select(F.col(doc_id).alias("doc_id"), leaf(*[F.col(f) for f in fields]).alias("_leaf"))
    sound = proofs.where(folded(F.col("leaf"), F.col("path")) == F.col("root"))
    sound = sound.select(F.col("doc_id").alias("_id"), F.col("leaf").alias("_leaf"), F.lit(True).alias("_sound")).distinct()
    joined = mine.join(sound, (mine["_leaf"] == sound["_leaf"]) & mine["doc_id"].eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", F.coalesce("_sound", F.lit(False)).alias("verified"))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row whose doc_id is null isn't tampered with.
    """
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(struck & F.col("text").contains("\n"), leaf(*rest, F.translate("text", "\n", "")))
    proofs = manifest(docs.select("doc_id", "source", "lang", "n_chars", "text"), other=tampered).proofs()
    root = folded(F.coalesce("other", "leaf"), F.col("path"))
    done = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
parts AS (
  SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    doc_id IS NOT NULL AND {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 AS struck
  FROM documents CROSS JOIN crc_table
),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN struck THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other
  FROM parts
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) AS s FROM leaves
),
low AS (
  SELECT s, 0 AS level, CAST(pos AS BIGINT) AS i, CAST(n AS BIGINT) AS n, leaf AS digest FROM numbered
  UNION ALL
  SELECT s, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY s, level, i // 3, n
),
subroots AS (SELECT s, digest, max(level) AS h FROM low WHERE n = 1 GROUP BY s, digest),
high AS (
  SELECT 0 AS level, CAST(s - 1 AS BIGINT) AS i, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 3, n
),
root AS (SELECT digest AS root FROM high WHERE n = 1),
own AS (
  SELECT d.s, d.pos, l.level, sum(1) OVER (PARTITION BY d.s, d.pos ORDER BY l.level) AS step,
    (SELECT coalesce(string_agg(x.digest, '' ORDER BY x.i), '') FROM low x WHERE x.s = d.s AND x.level = l.level AND x.i // 3 = l.i // 3 AND x.i < l.i) AS lft,
    (SELECT coalesce(string_agg(x.digest, '' ORDER BY x.i), '') FROM low x WHERE x.s = d.s AND x.level = l.level AND x.i // 3 = l.i // 3 AND x.i > l.i) AS rgt
  FROM numbered d JOIN low l ON l.s = d.s AND l.n > 1 AND l.i = d.pos // CAST(pow(3, l.level) AS BIGINT)
),
over AS (
  SELECT d.s, d.pos, b.h + l.level + 1 AS step,
    (SELECT coalesce(string_agg(x.digest, '' ORDER BY x.i), '') FROM high x WHERE x.level = l.level AND x.i // 3 = l.i // 3 AND x.i < l.i) AS lft,
    (SELECT coalesce(string_agg(x.digest, '' ORDER BY x.i), '') FROM high x WHERE x.level = l.level AND x.i // 3 = l.i // 3 AND x.i > l.i) AS rgt
  FROM numbered d JOIN subroots b USING (s) JOIN high l ON l.n > 1 AND l.i = (d.s - 1) // CAST(pow(3, l.level) AS BIGINT)
),
path AS (SELECT s, pos, step, lft, rgt FROM own UNION ALL SELECT s, pos, step, lft, rgt FROM over),
proof AS (
  SELECT s, pos, string_agg(lft || rgt, '' ORDER BY step) AS chain, list(lft ORDER BY step) AS ls, list(rgt ORDER BY step) AS rs FROM path GROUP BY s, pos
),
fold AS (
  SELECT d.s, d.pos, 0 AS step, coalesce(d.other, d.leaf) AS x, coalesce(len(p.ls), 0) AS steps, p.ls, p.rs FROM numbered d LEFT JOIN proof p USING (s, pos)
  UNION ALL
  SELECT s, pos, step + 1, sha256(ls[step + 1] || x || rs[step + 1]), steps, ls, rs FROM fold WHERE step < steps
)
SELECT d.doc_id, d.leaf, b.digest AS subroot, root.root, sha256(coalesce(p.chain, '')) AS proof_sha256, f.x AS folded_root, f.x = root.root AS verified
FROM numbered d JOIN subroots b USING (s) LEFT JOIN proof p USING (s, pos) JOIN fold f ON f.s = d.s AND f.pos = d.pos AND f.step = f.steps CROSS JOIN root
"""
