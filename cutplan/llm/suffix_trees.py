"""Operator 13: removal of repeated passages of words, by suffix trees over groups of suffixes with equal prefixes.

A tree over the suffixes at all words would need `length` words beside every word.  The suffixes are therefore
sampled first: every window of `length` words has an anchor, its run of `gram` words with the least hash
(leftmost of equals), and equal windows have equal anchors at equal places.  Neighbouring windows with one anchor
form a context, the words from the first window's start to the last one's end.

1. One pass gives a digest row for each context.  Contexts whose digest occurs more than once are repeated
   from end to end and are one from here on; no text moves for them.
2. Groups: contexts with one anchor share that prefix of `gram` words.  A group of one context holds no repeat
   and is dropped; a group of at most `max_contexts` fits into memory.  The windows of a larger one are taken
   apart: each is a suffix of its own under its own first `gram` words, then under twice as many where that
   prefix is too frequent, and so on.  A suffix that is alone under its prefix is dropped, and one whose
   prefix has grown to `length` words is decided by its count.
3. Groups are dealt to shards, and a shard builds the subtrees of its groups from the top: a node's suffixes are
   split by their next word, and a branch with one suffix left is a leaf and isn't followed.  Nodes that reach `length`
   words with several suffixes are the deep internal nodes; their paths are the maximal repeats' first `length`
   words, and every suffix below them starts a repeated window.
4. Spans come together by document and are cut out.

Words are compared by 64-bit hashes in steps 1 and 2 and as words in 3.  Windows never cross documents.
Defined results: null and empty texts have no words; a row is a place of its own, also if its doc_id or text
repeats; an empty table gives an empty table; extra columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutplan.llm import kernels as K
from cutplan.llm.shared import saved, work_dir
from cutplan.llm.substring_dedup import CONTEXT_DDL, whole_spans

#: A second base of polynomial hashes and its inverse modulo 2**64.
OTHER = 0xD1342543DE82EF95
OTHER_INVERSE = pow(OTHER, -1, 2**64)
WIDE, PLACE = K.U(2**64 - 1), K.U(0xFFFFFF)
#: Words taken at a time: places must fit into 24 bits.
PIECE = 1 << 20


class Hashes:
    """Polynomial hashes of runs of words."""

    def __init__(self, words: np.ndarray):
        self.sums = {}
        for base, inverse in ((K.BASE, K.INVERSE), (OTHER, OTHER_INVERSE)):
            sums = np.zeros(len(words) + 1, K.U)
            np.cumsum(words * K.powers(base, len(words)), dtype=K.U, out=sums[1:])
            self.sums[base] = sums, K.powers(inverse, len(words) + 1)

    def of(self, first: np.ndarray, past: np.ndarray, base: int = K.BASE) -> np.ndarray:
        sums, inverse = self.sums[base]
        return K.mix((sums[past] - sums[first]) * inverse[first])


def anchors(hashes: Hashes, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of a window among n words the place of its anchor, and the hash of every run of `gram` words."""
    at = np.arange(n - gram + 1)
    hashed = hashes.of(at, at + gram)
    size = length - gram + 1
    padded = np.full(-(-len(at) // size) * size, WIDE, K.U)
    padded[: len(at)] = (hashed & ~PLACE) | at.astype(K.U)
    grid = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    starts = n - length + 1
    least = np.minimum(ahead[:starts], behind[size - 1 : size - 1 + starts])
    return (least & PLACE).astype(np.int64), hashed


def contexts(words: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, two hashes) of each context of texts; text i has the words from bounds[i] to bounds[i + 1]."""
    if len(words) >= PIECE + length and len(bounds) == 2:
        parts = []
        for at in range(0, max(1, len(words) - length + 1), PIECE):
            cut = words[at : at + PIECE + length - 1]
            text, start, *rest = contexts(cut, np.array([0, len(cut)]), length, gram)
            parts.append((text, start + at, *rest))
        return tuple(np.concatenate(column) for column in zip(*parts, strict=True))
    valid = np.zeros(len(words) + 1, np.int64)
    fits = np.diff(bounds) >= length
    valid[bounds[:-1][fits]] += 1
    valid[bounds[1:][fits] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(valid))
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes = Hashes(words)
    place, grams = anchors(hashes, len(words), length, gram)
    place = place[starts]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(place) != 0)]))
    first, m = starts[edge], np.diff(np.append(edge, len(starts)))
    text = np.searchsorted(bounds, first, "right") - 1
    past = first + m - 1 + length
    h1, h2 = (hashes.of(first, past, base).view(np.int64) for base in (K.BASE, OTHER))
    return text, first - bounds[text], m, grams[place[edge]].view(np.int64), h1, h2


def scan(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """A digest row (d, tag, start, m, anchor, h1, h2) for each context of rows (d, tag, text); starts count words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.as_bytes(batch.column(2))
            for lo, hi in K.blocks(texts):
                words, _, _, bounds = K.words(texts[lo:hi], K.NOT_SPACE, K.UNCHANGED)
                text, *found = contexts(words, bounds, length, gram)
                at = pa.array(text + lo)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, kind) for c, kind in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *columns], names=["d", "tag", "start", "m", "anchor", "h1", "h2"]
                )

    return rows.mapInArrow(run, CONTEXT_DDL.replace("tag int", "tag long"))


PIECES = "key long, d long, tag long, n long, start long, m int, body string"


def pieces(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, d, tag, n, start, m, body): the words of wanted contexts (key, d, tag, n, start, m), joined by one blank."""
    cuts = wanted.groupBy("d", "tag").agg(F.collect_list(F.struct("start", "m", "n", "key")).alias("cuts"))
    joined = rows.join(cuts, ["d", "tag"]).select("d", "tag", "text", "cuts")
    names = [part.split(" ")[0] for part in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.as_bytes(batch.column(2))
            for lo, hi in K.blocks(texts):
                part = batch.slice(lo, hi - lo)
                found = []
                for d, tag, text, cuts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts[lo:hi], part.column(3).to_pylist(), strict=True):
                    words = text.split()
                    for c in cuts:
                        body = b" ".join(words[c["start"] : c["start"] + c["m"] - 1 + length])
                        found.append((c["key"], d, tag, c["n"], c["start"], c["m"], body.decode()))
                kinds = (*[pa.int64()] * 5, pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(run, PIECES)


def prefix_lengths(length: int, gram: int) -> list[int]:
    """`gram`, twice as much, and so on up to `length`."""
    out = [gram]
    while out[-1] < length:
        out.append(min(length, 2 * out[-1]))
    return out


def suffixes(large: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, tag, at, o, n, p0, p1, ..., h): the windows of pieces, each with the hashes of its prefixes; h is a second hash of the whole window.

    `at` is the piece's start and `o` the window's place in it.
    """
    lengths = prefix_lengths(length, gram)
    names = ["d", "tag", "at", "o", "n", *(f"p{k}" for k in range(len(lengths))), "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = K.as_bytes(batch.column(4))
            for lo, hi in K.blocks(bodies):
                words, _, _, bounds = K.words(bodies[lo:hi], K.NOT_SPACE, K.UNCHANGED)
                sizes = np.diff(bounds) - length + 1
                piece = np.repeat(np.arange(len(sizes)), sizes)
                o = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first, hashes, at = bounds[piece] + o, Hashes(words), pa.array(piece + lo)
                found = [hashes.of(first, first + p) for p in lengths] + [hashes.of(first, first + length, OTHER)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in (0, 1, 2)), pa.array(o, pa.int32()), batch.column(3).take(at), *(pa.array(h.view(np.int64)) for h in found)],
                    names=names,
                )

    kinds = ", ".join(f"p{k} long" for k in range(len(lengths)))
    return large.select("d", "tag", "start", "n", "body").mapInArrow(run, f"d long, tag long, at long, o int, n long, {kinds}, h long")


def by_prefix(large: DataFrame, length: int, gram: int, max_suffixes: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """The windows of very large groups, by prefixes of growing length: spans decided by counts, and pieces of one window each in groups for trees."""
    left = saved(suffixes(large, length, gram), f"{folder}/suffixes")
    lengths, small = prefix_lengths(length, gram), None
    for k in range(len(lengths) - 1):
        prefix = f"p{k}"
        counts = left.groupBy(prefix).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).where("c > 1 AND least = 1")
        counts = saved(counts, f"{folder}/prefixes-{k}")
        kept = left.join(counts.where(F.col("c") <= max_suffixes).select(prefix), prefix).select(F.col(prefix).alias("key"), "d", "tag", "at", "o", "n")
        small = kept if small is None else small.unionByName(kept)
        left = left.join(counts.where(F.col("c") > max_suffixes).select(prefix), prefix, "left_semi")
    whole = [f"p{len(lengths) - 1}", "h"]
    again = left.groupBy(*whole).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*whole)
    hit = left.where("n = 1").join(again, whole, "left_semi")
    spans = hit.select("d", "tag", (F.col("at") + F.col("o")).alias("first"), (F.col("at") + F.col("o") + length).alias("past"))
    bodies = small.join(large.select("d", "tag", F.col("start").alias("at"), "body"), ["d", "tag", "at"])
    body = F.array_join(F.slice(F.split("body", " "), F.col("o") + 1, length), " ")
    single = bodies.select("key", "d", "tag", "n", (F.col("at") + F.col("o")).alias("start"), F.lit(1).alias("m"), body.alias("body"))
    return spans, single


def deep_nodes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of `words` that starts at `starts` the number of its node of `length` words if other suffixes are below it too, else -1.

    The tree is made from the top: at each depth the suffixes of every node are sorted by their next word.
    """
    node = np.full(len(starts), -1, np.int64)
    live, owner = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for d in range(length):
        branch = (owner << 32) | words[starts[live] + d]
        turn = np.argsort(branch)
        branch, live = branch[turn], live[turn]
        fresh = np.concatenate([[True], branch[1:] != branch[:-1]])
        several = ~(fresh & np.concatenate([fresh[1:], [True]]))
        live, owner = live[several], np.cumsum(fresh)[several]
        if not len(live):
            return node
    node[live] = owner
    return node


def repeated_windows(bodies: list[str], length: int) -> list[np.ndarray]:
    """For each piece a mask of its windows that start elsewhere in the pieces too."""
    number: dict[str, int] = {}
    split = [body.split(" ") for body in bodies]
    words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    windows = np.maximum(sizes - length + 1, 0)
    base = np.repeat(np.cumsum(sizes) - sizes, windows)
    ends = np.cumsum(windows)
    starts = base + np.arange(len(base)) - np.repeat(ends - windows, windows)
    hit = deep_nodes(words, starts, length) >= 0
    return np.split(hit, ends[:-1]) if len(bodies) else []


SPANS = "d long, tag long, first long, past long"


def tree_spans(groups: DataFrame, length: int, shards: int) -> DataFrame:
    """Spans of windows that the trees of groups of pieces (key, d, tag, n, start, m, body) find repeated, for pieces that occur once."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for d, tag, n, start, mask in zip(part["d"], part["tag"], part["n"], part["start"], repeated_windows(part["body"].tolist(), length), strict=True):
            if n == 1 and mask.any():
                edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
                found += [(d, tag, start + a, start + b - 1 + length) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]
        return pd.DataFrame(found, columns=["d", "tag", "first", "past"])

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    return groups.select(shard, "d", "tag", "n", "start", "body").groupBy("shard").applyInPandas(run, SPANS)


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by one blank) of a text and word spans in any order."""
    words = text.split()
    at, kept = 0, []
    for first, past in sorted(spans):
        if first > at:
            kept += words[at:first]
        at = max(at, past)
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def repeated_spans(rows: DataFrame, length: int, gram: int, shard_words: int, max_contexts: int, folder: str) -> DataFrame:
    """(d, tag, first, past): word spans of rows (d, tag, text) that repeated windows cover; spans of one row may overlap."""
    every = saved(scan(rows, length, gram), f"{folder}/contexts")
    place = F.min(F.struct("d", "tag", "start", "m")).alias("at")
    distinct = saved(every.groupBy("anchor", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), place), f"{folder}/distinct")
    shared = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1")
    wanted = distinct.join(shared.select("anchor", (F.col("k") > max_contexts).alias("large")), "anchor")
    key = F.when(F.col("large"), F.lit(None)).otherwise(F.col("anchor")).alias("key")
    found = saved(pieces(rows, wanted.select(key, "at.*", "n"), length), f"{folder}/pieces")
    spans, groups = whole_spans(every, distinct, length), found.where("key IS NOT NULL")
    if not (large := found.where("key IS NULL")).isEmpty():
        decided, single = by_prefix(large, length, gram, 16 * max_contexts, folder)
        spans, groups = spans.unionByName(decided), groups.unionByName(saved(single, f"{folder}/single"))
    total = groups.agg(F.sum(F.col("m") + length - 1)).first()[0] or 0
    return spans.unionByName(tree_spans(groups, length, max(1, -(-total // shard_words))))


def remove_passages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 35,
    gram: int = 10,
    shard_words: int = 400_000,
    max_contexts: int = 4000,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row per row of `docs`; kept words are joined by one blank.

    Words covered by a window of `length` words that also starts elsewhere go.
    """
    folder = work_dir(docs.sparkSession, "passages")
    body = F.col(text).cast("string")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("d"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("tag"),
        body.alias("text"),
    )
    spans = repeated_spans(rows.select("d", "tag", "text"), length, gram, shard_words, max_contexts, folder)
    lists = saved(spans.groupBy("d", "tag").agg(F.collect_set(F.struct("first", "past")).alias("spans")), f"{folder}/spans")
    joined = rows.join(lists, ["d", "tag"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.as_bytes(batch.column(1))
            for lo, hi in K.blocks(texts):
                part = batch.slice(lo, hi - lo)
                done = [cut(t, [(s["first"], s["past"]) for s in spans or ()]) for t, spans in zip(texts[lo:hi], part.column(2).to_pylist(), strict=True)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns[:2], columns[2].cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: doc_id, n_words, n_removed, kept_sha256."""
    done = remove_passages(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
),
word AS (SELECT r, i, ws[i] AS w, i + 34 <= len(ws) AS fits FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM doc)),
windowed AS (
  SELECT r, i, w, CASE WHEN fits THEN md5_number(string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM word
),
again AS (SELECT h FROM windowed WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
marked AS (SELECT r, i, w, again.h IS NOT NULL AS hit FROM windowed LEFT JOIN again USING (h)),
covered AS (SELECT r, i, w, coalesce(max(CASE WHEN hit THEN i END) OVER (PARTITION BY r ORDER BY i), -99) > i - 35 AS gone FROM marked),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS k FROM covered GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (r)
"""
