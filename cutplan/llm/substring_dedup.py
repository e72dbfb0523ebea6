"""Operator 10: removal of repeated byte strings, by interval expansion on a Burrows-Wheeler transform.

Every string of `length` bytes has one anchor, its least gram by hash (leftmost of equals), so equal
strings have equal anchors at equal offsets.  Neighbouring starts with one anchor form a context, the
bytes from the first start to the end of the last string.

1. One pass over the texts gives a digest row for each context.  Contexts whose digest occurs more
   than once are repeated from end to end; no text moves for them.
2. What is left to decide is contexts that occur once but share their anchor with a different one.
   One text of each distinct context of such an anchor goes to a shard by anchor.  Anchors' bytes are
   measured: one that makes up a good part of a shard is a shard of its own, the others are dealt by
   hash, so shards are near `shard_bytes` each.
3. A shard sorts its suffixes to a sufficient depth and runs the breadth-first expansion: intervals
   of strings of length 0, 1, 2, ... are extended backwards by one byte on the transform; the right
   end of a new interval is a place where neighbouring suffixes have exactly that many bytes in
   common.  The search ends at `length`: ends not met have longer common prefixes, so their suffixes
   start repeated strings.
4. An anchor with more than `max_contexts` distinct contexts is split before it goes to a shard, by the
   bytes beside it: strings that have at least half of their other bytes before the anchor go by that half,
   the others by the half behind it.  Equal strings stay together, since the anchor is at one place in them.
   Parts are counted and marked like contexts and split again while there are too many; the bytes that a
   part shares grow to whole strings, so eight rounds at most end it.
5. Digests are looked up by a join in which very frequent ones are dealt over several keys.

Strings never cross documents.  Defined results: null text is empty; a row is a place of its own,
also if its doc_id or text repeats; an empty table gives an empty table; extra columns aren't used.
Kept bytes are binary, since a cut may split a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutplan.llm import kernels as K
from cutplan.llm.shared import saved, work_dir

WIDE = K.U(2**64 - 1)
POSITION = K.U(0xFFFFFF)
#: No UTF-8 text has this byte; it stands between contexts.
SEPARATOR = 255
#: Bytes hashed at a time: positions must fit into 24 bits.
PIECE = 4 << 20
#: No join key of a digest holds more than this part of the rows (one in PARTS).
PARTS = 1000


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of `length` bytes the position of its anchor, and the hash of every gram."""
    sums = np.zeros(len(data) + 1, K.U)
    np.cumsum(K.BYTE[data] * K.powers(K.BASE, len(data)), dtype=K.U, out=sums[1:])
    n = len(data) - gram + 1
    hashed = K.mix((sums[gram:] - sums[:n]) * K.powers(K.INVERSE, n))
    window = length - gram + 1
    padded = np.full(-(-n // window) * window, WIDE, K.U)
    padded[:n] = (hashed & ~POSITION) | np.arange(n, dtype=K.U)
    grid = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    starts = len(data) - length + 1
    least = np.minimum(ahead[:starts], behind[window - 1 : window - 1 + starts])
    return (least & POSITION).astype(np.int64), hashed


def contexts(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(text number, first start, number of starts, anchor hash, bytes) of each context."""
    if len(texts) == 1 and len(texts[0]) >= PIECE + length:
        whole = texts[0]
        for at in range(0, len(whole) - length + 1, PIECE):
            for _, s, m, h, b in contexts([whole[at : at + PIECE + length - 1]], length, gram):
                yield 0, s + at, m, h, b
        return
    joined = b"".join(texts)
    if len(joined) < length:
        return
    place, hashed = anchors(np.frombuffer(joined, np.uint8), length, gram)
    offset = np.cumsum([0, *map(len, texts)])
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        lo, hi = int(offset[i]), int(offset[i + 1]) - length + 1
        edge = np.flatnonzero(place[lo + 1 : hi] != place[lo : hi - 1]) + lo + 1
        first = [lo, *edge.tolist()]
        for s, e, h in zip(first, [*first[1:], hi], hashed[place[first]].view(np.int64).tolist(), strict=True):
            yield i, s - lo, e - s, h, joined[s : e - 1 + length]


CONTEXT = pa.schema(
    [("d", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()), ("m", pa.int32()), ("anchor", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]
)
CONTEXT_DDL = "d long, tag int, start long, m int, anchor long, h1 long, h2 long"


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def scan(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """A digest row for each context of rows (d, tag, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.as_bytes(batch.column(2))
            d, tag = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in K.blocks(texts):
                found = [(i, s, m, h, K.digest16(b)) for i, s, m, h, b in contexts(texts[lo:hi], length, gram)]
                if not found:
                    continue
                row, start, m, anchor, digests = zip(*found, strict=True)
                h1, h2 = _halves(digests)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d[lo + i] for i in row], pa.int64()),
                        pa.array([tag[lo + i] for i in row], pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(m, pa.int32()),
                        pa.array(anchor, pa.int64()),
                        pa.array(h1),
                        pa.array(h2),
                    ],
                    schema=CONTEXT,
                )

    return rows.mapInArrow(run, CONTEXT_DDL)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first `depth` bytes, by doubling; ties stay in any order."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << K.U(8)) | padded[i : i + n]
    order = np.argsort(key)
    ranked = key[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h = 8
    while h < depth:
        last = np.concatenate([first[1:], [True]])
        open_ = np.flatnonzero(~(first & last))
        if not len(open_):
            break
        at = order[open_]
        ahead = at + h
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        combined = rank[at] * (n + 1) + follow
        turn = np.argsort(combined)
        at, combined = at[turn], combined[turn]
        order[open_] = at
        fresh = np.concatenate([[True], combined[1:] != combined[:-1]])
        first[open_] = fresh
        rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        h *= 2
    return order


def far_ends(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """bool[n+1]: at j whether the suffixes at j-1 and j of `order` have `length` bytes in common.

    Holds for suffixes whose first `length` bytes have no separator.
    """
    n = len(text)
    bwt = text[order - 1]
    turn = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[turn] = np.arange(n)
    after = np.full(n, n, np.int64)
    same = bwt[turn[1:]] == bwt[turn[:-1]]
    after[turn[:-1][same]] = turn[1:][same]
    after[bwt == SEPARATOR] = -1
    keyed = (bwt[turn].astype(np.int64) << 40) | turn
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        total = int(size.sum())
        if not total:
            break
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(low)), size)
        p = np.arange(total) + np.repeat(low - (ends - size), size)
        kept = np.flatnonzero(after[p] >= high[owner])
        p, owner = p[kept], owner[kept]
        stop = step[p] + 1
        new = np.flatnonzero(~met[stop])
        p, owner, stop = p[new], owner[new], stop[new]
        met[stop] = True
        start = stop - 1
        wide = np.flatnonzero(size[owner] > 1)
        start[wide] = np.searchsorted(keyed, (bwt[p[wide]].astype(np.int64) << 40) | low[owner[wide]])
        low, high = start, stop
    return ~met


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece a mask of its starts whose string of `length` bytes starts elsewhere in the pieces too."""
    text = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]), np.uint8)
    order = suffix_order(text, length)
    far = far_ends(text, order, length)
    hit = np.zeros(len(text), bool)
    hit[order[far[1:]]] = True
    hit[order[far[:-1]]] = True
    offset = np.cumsum([0, *(len(p) + 1 for p in pieces)])
    return [hit[o : o + max(0, len(p) - length + 1)] for o, p in zip(offset, pieces, strict=False)]


SPAN_DDL = "d long, tag int, first long, past long"


def _spans(mask: np.ndarray, start: int, length: int) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        yield start + a, start + b - 1 + length


def shard_spans(pieces: DataFrame, length: int, shards: int, tasks: int) -> DataFrame:
    """Byte spans repeated elsewhere in contexts that occur once, shard by shard, dealt to `tasks` tasks."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        masks = repeated_starts(group["body"].tolist(), length)
        found = [
            (d, tag, a, b)
            for d, tag, n, s, mask in zip(group["d"], group["tag"], group["n"], group["start"], masks, strict=True)
            if n == 1
            for a, b in _spans(mask, s, length)
        ]
        return pd.DataFrame(found, columns=["d", "tag", "first", "past"])

    shard = F.when(F.col("wide"), F.xxhash64(F.lit("wide"), "anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    dealt = pieces.select(shard.alias("shard"), "d", "tag", "n", "start", "body").repartition(tasks, "shard")
    return dealt.groupBy("shard").applyInPandas(run, SPAN_DDL)


def repeated(rows: DataFrame, counts: DataFrame, total: int, place: list[str]) -> DataFrame:
    """Rows (h1, h2, ...) whose digest `counts` (h1, h2, n) holds with n > 1; `total` is the sum of all n.

    A digest of more than one in PARTS rows is dealt over several keys by the columns of its `place`, as many as
    it has such parts.  There are fewer than PARTS such digests, which bounds what is broadcast and repeated.
    """
    parts = F.ceil(F.col("n") * PARTS / F.lit(max(1, total)))
    often = counts.where(F.col("n") * PARTS > total).select("h1", "h2", parts.alias("parts"))
    dealt = rows.join(F.broadcast(often), ["h1", "h2"], "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64(*place), F.col("parts")), F.lit(0)))
    keys = counts.where("n > 1").select("h1", "h2", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return dealt.join(keys, ["h1", "h2", "part"], "left_semi")


def halves(m: int, core: int, width: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first start, number of starts, place of the new core after that start, its width) of a context's parts.

    Each of the context's m strings holds the `width` bytes from `core` on.  Of the bytes that a string has
    beside them, half lie before or behind the core; the new core has that half too.
    """
    step = -(-(length - width) // 2)
    before = min(m, max(0, core - step + 1))
    if before:
        yield 0, before, core - step, width + step
    if before < m:
        yield before, m - before, core - before, width + step


PART_DDL = "d long, tag int, n long, start long, m int, anchor long, h1 long, h2 long, core int, width int, body binary"


def parts(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """Contexts of very frequent anchors in two parts each, under new anchors: the old one, the side and the new core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                body, old = r["body"], r["anchor"].to_bytes(8, "little", signed=True)
                core, width = r["core"], r["width"]
                if core is None:
                    core, width = int(anchors(np.frombuffer(body, np.uint8), length, gram)[0][0]), gram
                for first, m, at, w in halves(len(body) - length + 1, core, width, length):
                    part = body[first : first + m - 1 + length]
                    key = K.digest16(old + (b"<" if first + at < core else b">") + part[at : at + w])
                    anchor, h = int.from_bytes(key[:8], "little", signed=True), K.digest16(part)
                    h1, h2 = (int.from_bytes(x, "little", signed=True) for x in (h[:8], h[8:]))
                    found.append((r["d"], r["tag"], r["n"], r["start"] + first, m, anchor, h1, h2, at, w, part))
            if found:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int32(), pa.binary())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in PART_DDL.split(", ")])

    return pieces.select("d", "tag", "n", "start", "anchor", "core", "width", "body").mapInArrow(run, PART_DDL)


def undecided(distinct: DataFrame, size: Column, max_contexts: int, shard_bytes: int) -> DataFrame:
    """(anchor, hot, wide) of anchors with several contexts of which some occur once."""
    grouped = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.sum(size).alias("size"))
    hot, wide = (F.col("k") > max_contexts).alias("hot"), (F.col("size") > shard_bytes // 8).alias("wide")
    return grouped.where("k > 1 AND least = 1").select("anchor", hot, wide)


def whole_spans(rows: DataFrame, counts: DataFrame, length: int) -> DataFrame:
    """Byte spans of rows (d, tag, start, m, h1, h2) whose digest occurs more than once by `counts` (h1, h2, n)."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    met = repeated(rows.select("d", "tag", "start", "m", "h1", "h2"), counts.select("h1", "h2", "n"), total, ["d", "tag", "start"])
    return met.select("d", "tag", F.col("start").alias("first"), (F.col("start") + F.col("m") - 1 + length).alias("past"))


PIECE_COLUMNS = ["d", "tag", "n", "start", "m", "anchor", "hot", "wide", "core", "width", "body"]


def split(hot: DataFrame, length: int, gram: int, max_contexts: int, shard_bytes: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """One round of splitting: spans of parts that occur more than once, and the pieces that are left to decide."""
    made = saved(parts(hot, length, gram), f"{folder}-parts", clear=True)
    once = F.struct("d", "tag", "start")
    same = [F.first(c).alias(c) for c in ("m", "core", "width", "body")]
    alike = saved(made.groupBy("anchor", "h1", "h2").agg(F.sum("n").alias("n"), F.min(once).alias("at"), *same), f"{folder}-distinct", clear=True)
    left = alike.join(undecided(alike, F.octet_length("body"), max_contexts, shard_bytes), "anchor")
    left = saved(left.select("at.*", *[c for c in PIECE_COLUMNS if c not in ("d", "tag", "start")]).select(*PIECE_COLUMNS), f"{folder}-left", clear=True)
    return whole_spans(made.where("n = 1"), alike, length), left


def bodies(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Adds the bytes of each wanted context (d, tag, start, m, ...), cut from its text."""
    lists = wanted.groupBy("d", "tag").agg(F.collect_list(F.struct("start", "m", "n", "anchor", "hot", "wide")).alias("cuts"))
    joined = rows.join(lists, ["d", "tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.as_bytes(batch.column(2))
            for lo, hi in K.blocks(texts):
                part = batch.slice(lo, hi - lo)
                cuts = [
                    {"d": d, "tag": tag} | c | {"body": t[c["start"] : c["start"] + c["m"] - 1 + length]}
                    for d, tag, t, cs in zip(*(part.column(i).to_pylist() for i in (0, 1)), texts[lo:hi], part.column(3).to_pylist(), strict=True)
                    for c in cs
                ]
                yield pa.RecordBatch.from_pylist(
                    cuts,
                    schema=pa.schema(
                        [("d", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()), ("m", pa.int32()), ("n", pa.int64()),
                         ("anchor", pa.int64()), ("hot", pa.bool_()), ("wide", pa.bool_()), ("body", pa.binary())]
                    ),
                )

    return joined.select("d", "tag", "text", "cuts").mapInArrow(
        run, "d long, tag int, start long, m int, n long, anchor long, hot boolean, wide boolean, body binary"
    )


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 400,
    gram: int = 160,
    shard_bytes: int = 1 << 20,
    max_contexts: int = 4000,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per row of `docs`."""
    folder = work_dir(docs.sparkSession, "substrings")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("d"),
        F.hash(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("tag"),
        F.col(text).cast("string").alias("text"),
    )
    every = saved(scan(rows.select("d", "tag", "text"), length, gram), f"{folder}/contexts", clear=True)
    distinct = saved(
        every.groupBy("anchor", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "tag", "start", "m")).alias("at")),
        f"{folder}/distinct",
        clear=True,
    )
    shared = undecided(distinct, F.col("at.m") + length, max_contexts, shard_bytes)
    wanted = distinct.join(shared, "anchor").select("at.d", "at.tag", "at.start", "at.m", "n", "anchor", "hot", "wide")
    cut = bodies(rows.select("d", "tag", "text"), wanted, length)
    cut = cut.withColumns({c: F.lit(None).cast("int") for c in ("core", "width")}).select(*PIECE_COLUMNS)
    cut = saved(cut, f"{folder}/bodies", clear=True)
    spans, ready, size = whole_spans(every, distinct, length), cut.where("NOT hot"), F.octet_length("body")
    for k in range(length.bit_length()):
        if cut.where("hot").isEmpty():
            break
        found, cut = split(cut.where("hot"), length, gram, max_contexts, shard_bytes, f"{folder}/split-{k}")
        spans, ready = spans.union(found), ready.union(cut.where("NOT hot"))
    total, narrow = ready.agg(F.sum(size), F.sum(F.when(~F.col("wide"), size))).first()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // (8 * shard_bytes)))
    spans = spans.union(shard_spans(ready, length, max(1, -(-(narrow or 0) // shard_bytes)), tasks))
    lists = saved(spans.groupBy("d", "tag").agg(F.collect_list(F.struct("first", "past")).alias("spans")), f"{folder}/spans", clear=True)
    joined = rows.join(lists, ["d", "tag"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for t, spans in zip(K.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                at, kept, removed, runs = 0, [], 0, 0
                for a, b in sorted((s["first"], s["past"]) for s in spans or ()):
                    if a > at or not runs:
                        kept.append(t[at:a])
                        runs, removed, at = runs + 1, removed + b - a, b
                    elif b > at:
                        removed, at = removed + b - at, b
                kept.append(t[at:])
                done.append((len(t), removed, runs, b"".join(kept)))
            columns = list(zip(*done, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    done = remove_repeats(docs)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Texts are cut into hex digits of chunks that overlap, so that each string is taken from a short one.
ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents
),
chunk AS (
  SELECT r, c, substr(x, 800 * c + 1, 1598) AS y FROM (SELECT r, x, unnest(range(0, length(x) // 800 + 1)) AS c FROM doc)
),
string AS (
  SELECT r, 400 * c + o AS i, md5_number(substr(y, 2 * o + 1, 800)) AS h
  FROM (SELECT r, c, y, unnest(range(0, least(400, length(y) // 2 - 399))) AS o FROM chunk WHERE length(y) >= 800)
),
again AS (SELECT h FROM string GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i FROM string SEMI JOIN again USING (h)),
edge AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit),
span AS (
  SELECT r, min(i) AS first, max(i) + 400 AS past
  FROM (SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM edge) GROUP BY r, g
),
gap AS (
  SELECT r, past AS first, lead(first) OVER (PARTITION BY r ORDER BY first) AS past FROM span
  UNION ALL SELECT r, 0, min(first) FROM span GROUP BY r
),
kept AS (
  SELECT r, string_agg(substr(x, 2 * first + 1, 2 * (coalesce(past, length(x) // 2) - first)), '' ORDER BY first) AS k FROM gap JOIN doc USING (r) GROUP BY r
),
removed AS (SELECT r, sum(past - first) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM doc LEFT JOIN removed ON removed.r = doc.r LEFT JOIN kept ON kept.r = doc.r
"""
