"""Operator 3: near-duplicate documents by MinHash bands with sequential Bayesian verification.

1. One pass gives each document its shingle set's digest, MinHash signature and band keys.  Documents
   of one set are one class, which its smallest doc_id stands for; only classes go on.
2. A band's bucket links each member with the bucket's first member only (a star, so a bucket of m
   gives m-1 pairs).  Signatures of a pair are compared in batches; after each batch the pair is
   dropped once the posterior probability of a similarity at the threshold is below `miss`.
   Survivors are verified on full sets.  A sixth of the bands comes first; stars of the others are
   needed only where the components found by then still differ.
3. Components follow by minimum labels with pointer jumping.  A bucket with members in several
   components isn't settled: its members are compared across components in blocks of bounded size.
   Signatures go first; members of pairs that they leave meet again, now with their texts, and are
   verified on full sets within the task, so every pair in a bucket is decided and only links leave it.

Texts of classes that share a bucket are written once, by set, and read from there; no other text is
shuffled.

Bands follow from `threshold`: with r rows, the least b with (1 - threshold**r)**b <= `band_miss`.
Hot keys: copies collapse to a class before banding, stars and labels are pre-aggregated, pairs are
joined by equality with sides that Spark may split.

Defined results: null or wordless text is an empty set, its own component and kept; equal rows share a
class; null doc_ids come last, so a null stands for others only where all of its component are null
(component_id is null then); one row of each component is kept, of rows with its smallest doc_id one of
the least set and text, also where ids are null or repeat; an empty table gives an empty table; extra
columns aren't used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutplan.llm import kernels as K
from cutplan.llm.shared import saved, spare, work_dir

U32 = np.uint32
#: Shingles that the members of one block of a bucket may have together.
BLOCK_SHINGLES = 2_000_000


def band_count(threshold: float, rows: int, band_miss: float) -> int:
    return math.ceil(math.log(band_miss) / math.log1p(-(threshold**rows)))


def least_matches(threshold: float, steps: list[int], miss: float) -> list[int]:
    """For each number n of compared hashes the least number of matches that isn't pruned.

    With a uniform prior the posterior after m matches of n is Beta(m+1, n-m+1), and
    P(similarity >= t) = P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in steps:
        total, m = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return out


class Scheme:
    """Numbers of hashes, bands and rows, and the pruning table, all from threshold and miss."""

    def __init__(self, words: int, threshold: float, rows: int, band_miss: float, miss: float):
        self.words, self.rows = words, rows
        self.percent = round(threshold * 100)
        self.bands = band_count(threshold, rows, band_miss)
        self.hashes = self.bands * rows
        self.steps = list(range(16, self.hashes + 1, 16))
        self.least = least_matches(threshold, self.steps, miss)

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sequential pruning of rows of signatures a, b: True where a pair is left after all batches."""
        left = np.arange(len(a))
        seen = np.zeros(len(a), np.int32)
        low = 0
        for n, least in zip(self.steps, self.least, strict=True):
            seen[left] += (a[left, low:n] == b[left, low:n]).sum(1, dtype=np.int32)
            left = left[seen[left] >= least]
            low = n
        keep = np.zeros(len(a), bool)
        keep[left] = True
        return keep


def _signatures(scheme: Scheme, sets: list[np.ndarray]) -> np.ndarray:
    """uint32[len(sets), hashes], minima of affine permutations; sets aren't empty."""
    x = (np.concatenate(sets) >> K.U(32)).astype(U32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    a = (K.randoms(scheme.hashes, 2) >> K.U(32)).astype(U32) | U32(1)
    b = (K.randoms(scheme.hashes, 3) >> K.U(32)).astype(U32)
    out = np.empty((len(sets), scheme.hashes), U32)
    for k in range(scheme.hashes):
        out[:, k] = np.minimum.reduceat(x * a[k] + b[k], starts)
    return out


SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("text_id", pa.binary()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("sig", pa.binary()), ("bands", pa.binary())]
)
SIGNED_DDL = "doc_id long, text_id binary, n_shingles long, set_id binary, sig binary, bands binary"


def _sign(scheme: Scheme, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = K.randoms(scheme.rows, 4) | K.U(1)
    for batch in batches:
        texts, ids = K.as_bytes(batch.column(1)), batch.column(0)
        for lo, hi in K.blocks(texts):
            hashed, _, _, bounds = K.words(texts[lo:hi], K.NOT_SPACE)
            sets = [K.shingles(hashed[bounds[i] : bounds[i + 1]], scheme.words) for i in range(hi - lo)]
            full = [s for s in sets if len(s)]
            sigs, bands = [None] * len(sets), [None] * len(sets)
            if full:
                signature = _signatures(scheme, full)
                parts = signature.astype(K.U).reshape(len(full), scheme.bands, scheme.rows)
                keys = K.mix((parts * factors).sum(2, dtype=K.U)).view(np.int64)
                short = (K.mix(signature.astype(K.U)) >> K.U(48)).astype(np.uint16)
                for j, i in enumerate(i for i, s in enumerate(sets) if len(s)):
                    sigs[i], bands[i] = short[j].tobytes(), keys[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo).cast(pa.int64()),
                    batch.column(2).slice(lo, hi - lo).cast(pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([K.digest16(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(sigs, pa.binary()),
                    pa.array(bands, pa.binary()),
                ],
                schema=SIGNED,
            )


def text_key(text: str) -> Column:
    """Digest of a text as it is written; with the doc_id it is a row's key."""
    return F.unhex(F.md5(F.col(text).cast("string")))


def keyed_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), text_key(text).alias("text_id"))


def signed(docs: DataFrame, scheme: Scheme, doc_id: str, text: str) -> DataFrame:
    """Sets, signatures and bands of the rows; `row` numbers them and holds once this is written."""
    rows = keyed_texts(docs, doc_id, text)
    return rows.mapInArrow(lambda it: _sign(scheme, it), SIGNED_DDL).withColumn("row", F.monotonically_increasing_id())


def class_texts(docs: DataFrame, needed: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(set_id, text) of `needed` classes (set_id, rep, rep_text); rows without an id are met once a text."""
    rows = keyed_texts(docs, doc_id, text)
    rows = rows.where(F.col("doc_id").isNotNull()).union(rows.where(F.col("doc_id").isNull()).dropDuplicates(["text_id"]))
    met = rows.join(needed, rows.doc_id.eqNullSafe(needed.rep) & (rows.text_id == needed.rep_text))
    return met.select("set_id", "text")


def ranked() -> Column:
    """What classes are ordered by: doc_ids, those that are null last, then sets."""
    return F.struct(F.col("rep").isNull().alias("none"), "rep", "set_id")


def prune(pairs: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b) that the sequential comparison of their signatures leaves."""
    sig = classes.select("set_id", "sig")
    both = pairs.join(sig.select(F.col("set_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sig.select(F.col("set_id").alias("b"), F.col("sig").alias("sig_b")), "b"
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            left, right = (
                np.frombuffer(b"".join(table[c].to_pylist()), np.uint16).reshape(table.num_rows, scheme.hashes) for c in ("sig_a", "sig_b")
            )
            if table.num_rows:
                yield from table.filter(pa.array(scheme.alike(left, right))).select(["a", "b"]).to_batches()

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a binary, b binary")


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    for lo, hi in K.blocks(texts):
        hashed, _, _, bounds = K.words(texts[lo:hi], K.NOT_SPACE)
        for i in range(hi - lo):
            yield K.shingles(hashed[bounds[i] : bounds[i + 1]], words)


def verify(pairs: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs whose full sets reach the threshold.  texts (set_id, text)."""
    full = (
        pairs.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, ok = pa.table(batch), []
            sets = (shingle_sets(K.as_bytes(batch.column(i)), scheme.words) for i in (2, 3))
            for x, y in zip(*sets, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= scheme.percent * (len(x) + len(y) - common))
            if table.num_rows:
                yield from table.filter(pa.array(ok, pa.bool_())).select(["a", "b"]).to_batches()

    return full.mapInArrow(test, "a binary, b binary")


def components(nodes: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """(set_id, label): label is the least `ranked` that links reach.  Minimum labels over both
    directions of the links, then each node takes its label's label; ends when nothing changes."""
    both = saved(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/links")
    touched = both.select(F.col("a").alias("set_id")).distinct()
    own = ranked().alias("label")
    labels = saved(nodes.join(touched, "set_id").select("set_id", own), f"{folder}/labels-0")
    step = 0
    while True:
        step += 1
        spread = both.join(labels.withColumnRenamed("set_id", "a"), "a").select(F.col("b").alias("set_id"), "label", F.lit(None).alias("old"))
        known = labels.select("set_id", "label", F.col("label").alias("old"))
        least = known.union(spread).groupBy("set_id").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("set_id").alias("t"), F.col("label").alias("far"))
        moved = (
            least.join(jump, F.col("label.set_id") == F.col("t"), "left")
            .select("set_id", F.least("label", F.coalesce("far", "label")).alias("label"), "old")
            .select("set_id", "label", (F.col("label") != F.col("old")).alias("moved"))
        )
        new = saved(moved, f"{folder}/labels-{step}")
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels


def shared_counts(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets, for rows (i, j) of `pairs`."""
    if len(pairs) < 2000:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    used = np.unique(pairs)
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(used), len(used)), np.float32)
    for low in range(0, int(column[-1]) + 1, 4096):  # columns of the membership matrix, a slice at a time
        part = slice(*np.searchsorted(column, [low, low + 4096]))
        member = np.zeros((len(used), 4096), np.float32)
        member[owner[part], column[part] - low] = 1
        common += member @ member.T
    at = np.searchsorted(used, pairs)
    return common[at[:, 0], at[:, 1]].astype(np.int64)


class Bundle:
    """Rows of many blocks of buckets as arrays; `blocks` gives each block's row numbers."""

    def __init__(self, group: pd.DataFrame, scheme: Scheme):
        self.scheme, n = scheme, len(group)
        self.band, self.slot, self.size = (group[c].to_numpy(np.int64) for c in ("band", "slot", "n"))
        self.key = [group[c].to_numpy(np.int64) for c in ("bucket", "s0", "s1")]
        self.root = pd.factorize(group["root"])[0]
        self.sigs = np.frombuffer(b"".join(group["sig"]), np.uint16).reshape(n, scheme.hashes)
        self.keys = np.frombuffer(b"".join(group["bands"]), np.int64).reshape(n, scheme.bands)

    def blocks(self) -> Iterator[np.ndarray]:
        order = np.lexsort(self.key[::-1])
        new = np.zeros(len(order), bool)
        for k in self.key:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        yield from np.split(order, np.flatnonzero(new))

    def pairs(self, block: np.ndarray) -> np.ndarray:
        """Row pairs of a block, across components, that sizes and signatures leave; of two different
        slots of a bucket only pairs across them, and none that a bucket of an earlier band decides."""
        if self.root[block].min() == self.root[block].max():
            return np.zeros((0, 2), np.int64)
        apart, band, found = self.key[1][block[0]] != self.key[2][block[0]], self.band[block[0]], []
        for k, i in enumerate(block[:-1].tolist()):
            rest = block[k + 1 :]
            rest = rest[(self.root[rest] != self.root[i]) & ((self.slot[rest] != self.slot[i]) if apart else True)]
            small, large = np.minimum(self.size[rest], self.size[i]), np.maximum(self.size[rest], self.size[i])
            rest = rest[100 * small >= self.scheme.percent * large]
            rest = rest[~(self.keys[rest, :band] == self.keys[i, :band]).any(1)]
            if len(rest):
                rest = rest[self.scheme.alike(np.broadcast_to(self.sigs[i], (len(rest), self.scheme.hashes)), self.sigs[rest])]
                found.append(np.stack([np.full(len(rest), i), rest], 1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


DEALT = ["bucket", "s0", "s1", "slots", "band", "slot", "set_id", "root", "n", "sig", "bands"]
DEALT_DDL = "bucket long, s0 int, s1 int, slots int, band int, slot int, set_id binary, root binary, n long, sig binary, bands binary"
#: Rows that one call compares; small blocks share a call.
CALL_ROWS = 2048


def bundled(rows: DataFrame, total: int) -> DataFrame:
    """Rows with `bundle`: blocks of buckets of one slot are dealt by hash to calls of about `CALL_ROWS`."""
    calls = F.lit(max(1, -(-total // CALL_ROWS)))
    return rows.withColumn("bundle", F.when(F.col("slots") == 1, F.pmod(F.xxhash64("bucket"), calls)).otherwise(F.xxhash64("bucket", "s0", "s1")))


def open_links(buckets: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, scheme: Scheme, block: int, folder: str) -> DataFrame:
    """Links across components within a bucket, found and verified block by block.

    Members of a bucket get a slot by hash, `block` members or `BLOCK_SHINGLES` shingles to a slot; each
    two slots are one block, so a block's size doesn't grow with its bucket.
    """
    marked = buckets.join(labels.select("set_id", F.col("label.set_id").alias("root")), "set_id", "left").withColumn(
        "root", F.coalesce("root", "set_id")
    )
    slots = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    unsettled = saved(
        marked.groupBy("bucket")
        .agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
        .where((F.col("r0") != F.col("r1")) & (F.col("m") > 2))
        .select("bucket", slots.alias("slots"), "m"),
        f"{folder}/unsettled",
    )
    small = unsettled.where("slots = 1").agg(F.sum("m")).first()[0] or 0
    members = marked.join(unsettled.select("bucket", "slots"), "bucket").withColumn("slot", F.pmod(F.xxhash64("set_id"), "slots").cast("int"))
    dealt = (
        members.join(classes.select("set_id", "sig", "bands"), "set_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        .withColumns({"s0": F.least("slot", "other"), "s1": F.greatest("slot", "other")})
    )

    def left(group: pd.DataFrame) -> pd.DataFrame:
        bundle = Bundle(group, scheme)
        rows = [np.unique(bundle.pairs(b)) for b in bundle.blocks()]
        return group.iloc[np.concatenate(rows)][DEALT]

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        bundle, ids, found = Bundle(group, scheme), group["set_id"].to_numpy(), []
        for rows in bundle.blocks():
            if not len(pairs := bundle.pairs(rows)):
                continue
            used, at = np.unique(pairs, return_inverse=True)
            sets = list(shingle_sets([t.encode() for t in group["text"].iloc[used]], scheme.words))
            at = at.reshape(pairs.shape)
            common, sizes = shared_counts(sets, at), np.array([len(x) for x in sets])
            ok = 100 * common >= scheme.percent * (sizes[at].sum(1) - common)
            found += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in pairs[ok]]
        return pd.DataFrame(found, columns=["a", "b"])

    some = saved(bundled(dealt.select(*DEALT), small).groupBy("bundle").applyInPandas(left, DEALT_DDL), f"{folder}/open-left")
    full = bundled(some.join(texts, "set_id"), some.where("slots = 1").count())
    return full.select("bundle", *DEALT, "text").groupBy("bundle").applyInPandas(linked, "a binary, b binary").distinct()


def decided(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    rows: int = 5,
    band_miss: float = 1e-6,
    miss: float = 1e-7,
    block: int = 1024,
) -> DataFrame:
    """(doc_id, text_id, n_shingles, component_id, kept), one row per row of `docs`; one is kept of each component."""
    spark = docs.sparkSession
    scheme = Scheme(words, threshold, rows, band_miss, miss)
    folder = work_dir(spark, "near-dedup")
    signs = saved(signed(docs, scheme, doc_id, text), f"{folder}/signed")
    classes = saved(
        signs.where(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id", "row")).alias("least"),
            F.first("n_shingles").alias("n"),
            F.first("sig").alias("sig"),
            F.first("bands").alias("bands"),
        )
        .select("set_id", F.col("least.doc_id").alias("rep"), F.col("least.text_id").alias("rep_text"), F.col("least.row").alias("rep_row"), "n", "sig", "bands"),
        f"{folder}/classes",
    )
    numbers = F.explode(F.sequence(F.lit(0), F.lit(scheme.bands - 1)))
    keyed = classes.select("set_id", "rep", "n", "bands", numbers.alias("band")).select(
        "set_id", "rep", "n", "band", F.xxhash64("band", F.substring("bands", F.col("band") * 8 + 1, F.lit(8))).alias("bucket")
    )
    firsts = (
        keyed.groupBy("bucket")
        .agg(F.min(ranked()).alias("first"), F.count(F.lit(1)).alias("m"))
        .where("m > 1")
        .select("bucket", F.col("first.set_id").alias("a"))
    )
    buckets = saved(keyed.join(firsts, "bucket").select("bucket", "band", "set_id", "n", "a"), f"{folder}/buckets")
    nodes = classes.select("set_id", "rep")
    met = buckets.select("set_id").distinct().join(classes.select("set_id", "rep", "rep_text"), "set_id")
    texts = saved(class_texts(docs, met, doc_id, text), f"{folder}/texts")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        left = saved(prune(pairs, classes, scheme), f"{folder}/{name}")
        return saved(verify(left, texts, scheme), f"{folder}/{name}-links")

    early = max(1, scheme.bands // 6)
    stars = buckets.where(F.col("a") != F.col("set_id")).select("band", "a", F.col("set_id").alias("b"))
    links = checked(stars.where(F.col("band") < early).select("a", "b").distinct(), "early")
    labels = components(nodes, links, f"{folder}/first")
    root = labels.select("set_id", F.col("label.set_id").alias("root"))
    apart = (
        stars.where(F.col("band") >= early)
        .select("a", "b")
        .distinct()
        .join(root.select(F.col("set_id").alias("a"), F.col("root").alias("root_a")), "a", "left")
        .join(root.select(F.col("set_id").alias("b"), F.col("root").alias("root_b")), "b", "left")
        .where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
        .select("a", "b")
    )
    late = checked(apart, "late")
    if not late.isEmpty():
        links = links.union(late)
        labels = components(nodes, links, f"{folder}/second")
    members = buckets.select("bucket", "band", "set_id", "n")
    more = saved(open_links(members, labels, classes, texts, scheme, block, folder), f"{folder}/open")
    if not more.isEmpty():
        labels = components(nodes, links.union(more), f"{folder}/third")
    roots = classes.select("set_id", "rep", "rep_row").join(labels, "set_id", "left")
    roots = roots.select(
        "set_id",
        F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("label.rep")).alias("root"),
        F.when(F.coalesce("label.set_id", "set_id") == F.col("set_id"), F.col("rep_row")).otherwise(-1).alias("kept_row"),
    )
    # a plain table, so that Spark can split the join where one set has very many rows
    roots = saved(roots, f"{folder}/roots")
    done = signs.select("doc_id", "text_id", "n_shingles", "set_id", "row").join(roots, "set_id", "left")
    component = F.when(F.col("kept_row").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    kept = F.coalesce(F.col("row") == F.col("kept_row"), F.lit(True))
    return done.select("doc_id", "text_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, *args, **more) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs`; arguments as for `decided`."""
    return decided(docs, *args, **more).drop("text_id")


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of `docs` that are kept.  Rows are met by doc_id and text; of rows that are equal in both
    at most one is kept, the one with the least other columns, which must be sortable."""
    names = docs.columns
    keys = decided(docs, doc_id, text, **more).where("n_shingles > 0").groupBy("doc_id", "text_id")
    keys = keys.agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("n > 1 OR NOT kept")
    keys = saved(keys, f"{work_dir(docs.sparkSession, 'near-dedup')}/keys")

    def met(given: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        d, t = spare(names, "_doc_id"), spare(names, "_text_id")
        keys = keys.select(F.col("doc_id").alias(d), F.col("text_id").alias(t))
        same = F.col(doc_id).cast("long").eqNullSafe(F.col(d)) & text_key(text).eqNullSafe(F.col(t))
        return given.join(keys, same, how)

    repeated = met(docs, keys.where("kept"), "left_semi").select(F.col(doc_id).cast("long").alias("d"), text_key(text).alias("t"), F.struct(*names).alias("row"))
    return met(docs, keys, "left_anti").union(repeated.groupBy("d", "t").agg(F.min("row").alias("row")).select("row.*"))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: three-word shingles, similarity at least 0.85."""
    return near_duplicates(docs, words=3, threshold=0.85, rows=6)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ \x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
),
link AS (
  SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
),
reach(x, y) AS (
  SELECT a, b FROM link UNION SELECT reach.x, link.b FROM reach JOIN link ON reach.y = link.a
),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.y, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(least.y, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.x = w.doc_id
"""
