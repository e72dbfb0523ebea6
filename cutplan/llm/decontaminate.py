"""Operator 7: benchmark decontamination by a generalised suffix automaton of the test items.

The words of all items go into one automaton over word ids (`Automaton`).  Each document streams its
words through it and tracks, at every word, the longest stretch ending there that some item holds.
A stretch of at least `window` words, or a whole shorter item, makes its words hit.  Hit words that
touch are one span; `stretches` are the longest matches before that, with their places in words, so
that removal can leave those below a length limit.  Words whose
neighbour pair no item has can't be inside a stretch of two or more, so runs of such words are passed
over with one vectorised test and the automaton starts again at its root behind them.

The items are the test set, not the corpus: their size is counted first, and automata of at most
`max_words` words are built, one for each block of items; every document meets every block, one job
after the other, so a large set costs more passes but no more memory in a task or on the driver.

Defined results: null text has no words; an item without words is no window; equal items all count;
a null item_id is left out of item lists but its words are windows; an empty benchmark hits nothing;
an empty table gives an empty table; extra columns pass through and the result column replaces one of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutplan.llm import kernels as K
from cutplan.llm.shared import saved, spare, with_column, work_dir


class Automaton:
    """Generalised suffix automaton of word-id sequences, with what occurs marked on its states."""

    def __init__(self, items: list[tuple[int | None, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: State that stands for the last `window` words, for states that are long enough.
        self.gram = list(range(len(self.length)))
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        for s in order:
            if s and self.length[self.link[s]] >= window:
                self.gram[s] = self.gram[self.link[s]]
        #: Items by the state of each of their windows; short items by the state of all their words.
        self.items: dict[int, list] = {}
        self.short: dict[int, list[int]] = {}
        for item, words in items:
            if len(words) >= window:
                for s in {self.gram[s] for s, n in self.stream(words) if n >= window}:
                    self.items.setdefault(s, []).append(item)
            elif words:
                s = list(self.stream(words))[-1][0]
                self.items.setdefault((s, len(words)), []).append(item)
                if len(words) not in self.short.setdefault(s, []):
                    self.short[s].append(len(words))
        #: The nearest state on the way to the root, itself included, that ends a short item.
        self.ends = [-1] * len(self.length)
        for s in order:
            self.ends[s] = s if s in self.short else (self.ends[self.link[s]] if s else -1)

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {})
        while last != -1 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last == -1:
            self.link[new] = 0
        else:
            q = self.next[last][w]
            self.link[new] = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, last: int, w: int, q: int) -> int:
        new = self._state(self.length[last] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while last != -1 and self.next[last].get(w) == q:
            self.next[last][w] = new
            last = self.link[last]
        return new

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            yield state, length

    def hits(self, words: list[int], base: int, spans: list[list[int]], stretches: list[list[int]], items: set) -> None:
        """Adds the spans [start, end) of words that are hit, the stretches that no other holds, and the items whose windows occur."""

        def add(start: int, end: int) -> None:
            if not (stretches and stretches[-1][0] <= start and stretches[-1][1] >= end):
                while stretches and stretches[-1][0] >= start:
                    stretches.pop()
                stretches.append([start, end])
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append([start, end])

        for i, (state, length) in enumerate(self.stream(words), base + 1):
            if length >= self.window:
                items.update(self.items[self.gram[state]])
                add(i - length, i)
            s = self.ends[state]
            while s != -1:
                for n in self.short[s]:
                    if n <= length:
                        items.update(self.items[s, n])
                        add(i - n, i)
                s = self.ends[self.link[s]] if s else -1


class Items:
    """What a task needs of one block of items: the automaton, word ids and the pairs that occur."""

    def __init__(self, rows: list[tuple[int | None, str]], window: int):
        texts = [(t or "").encode() for _, t in rows]
        hashed, _, _, bounds = K.words(texts, K.ALNUM) if rows else (np.zeros(0, K.U), None, None, [0])
        self.vocabulary = np.unique(hashed)
        ids = np.searchsorted(self.vocabulary, hashed)
        words = [ids[bounds[i] : bounds[i + 1]] for i in range(len(rows))]
        self.automaton = Automaton([(r[0], w.tolist()) for r, w in zip(rows, words, strict=True)], window)
        self.shortest = min((min(len(w), window) for w in words if len(w)), default=window)
        pairs = [w[:-1].astype(np.int64) * len(self.vocabulary) + w[1:] for w in words if len(w) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    def word_ids(self, hashed: np.ndarray) -> np.ndarray:
        """Ids of words, -1 for words that no item has."""
        if not len(self.vocabulary):
            return np.full(len(hashed), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashed, at, -1)

    def runs(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, end) of stretches of words that can hold a window, none across a text's end."""
        if self.shortest < 2:
            joined = np.zeros(max(len(ids) - 1, 0), bool)
            joined[:] = (ids[:-1] >= 0) & (ids[1:] >= 0)
        else:
            key = ids[:-1] * len(self.vocabulary) + ids[1:]
            known = (ids[:-1] >= 0) & (ids[1:] >= 0)
            at = np.flatnonzero(known)
            joined = np.zeros(max(len(ids) - 1, 0), bool)
            if len(self.pairs) and len(at):
                place = np.minimum(np.searchsorted(self.pairs, key[at]), len(self.pairs) - 1)
                joined[at] = self.pairs[place] == key[at]
        cut = bounds[1:-1] - 1
        joined[cut[(cut >= 0) & (cut < len(joined))]] = False
        edge = np.flatnonzero(np.diff(joined.view(np.int8), prepend=0, append=0))
        start, end = edge[0::2], edge[1::2] + 1
        if self.shortest < 2:
            single = np.flatnonzero((ids >= 0) & ~np.concatenate([joined, [False]]) & ~np.concatenate([[False], joined])) if len(ids) else edge[:0]
            start, end = np.concatenate([start, single]), np.concatenate([end, single + 1])
            order = np.argsort(start)
            start, end = start[order], end[order]
        long = end - start >= self.shortest
        return start[long], end[long]


RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<array<int>>,stretches:array<array<int>>>"
RESULT_TYPE = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int32()))), ("stretches", pa.list_(pa.list_(pa.int32())))]
)


def _match(items: Items, texts: list[bytes]) -> list[dict]:
    """Per text: its words, the merged hit spans as byte positions in the text, and the items found."""
    hashed, starts, ends, bounds = K.words(texts, K.ALNUM)
    first, last = items.runs(items.word_ids(hashed), bounds)
    owner = np.searchsorted(bounds, first, side="right") - 1
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    found: dict[int, tuple[list, list, set]] = {}
    for a, b, row in zip(first.tolist(), last.tolist(), owner.tolist(), strict=True):
        spans, stretches, names = found.setdefault(row, ([], [], set()))
        items.automaton.hits(items.word_ids(hashed[a:b]).tolist(), a, spans, stretches, names)
    out = []
    for i in range(len(texts)):
        spans, stretches, names = found.get(i, ((), (), ()))
        out.append(
            {
                "n_words": int(bounds[i + 1] - bounds[i]),
                "n_hit": sum(e - s for s, e in spans),
                "items": sorted(str(n) for n in names if n is not None),
                "spans": [[int(starts[s] - offsets[i]), int(ends[e - 1] - offsets[i])] for s, e in spans],
                "stretches": [[int(starts[s] - offsets[i]), int(ends[e - 1] - offsets[i]), int(s - bounds[i]), int(e - bounds[i])] for s, e in stretches],
            }
        )
    return out


def match_items(docs: DataFrame, broadcast: Broadcast, text: str, out: str) -> DataFrame:
    """All columns of `docs` plus `out`; `broadcast` holds `Items`."""
    names = [c for c in docs.columns if c != out]
    at = names.index(text)
    schema = with_column(docs.select(*names), out, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.as_bytes(batch.column(at))
            for lo, hi in K.blocks(texts):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(_match(broadcast.value, texts[lo:hi]), RESULT_TYPE)], names=[*names, out]
                )

    return docs.select(*names).mapInArrow(run, schema)


def item_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, max_words: int) -> Iterator[int | Items]:
    """The number of blocks, then an `Items` for each, of at most about `max_words` words, made when it is asked for."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // (5 * max_words)))
    yield parts
    for p in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p)
        yield Items([(r.item, r.text) for r in part.toLocalIterator()], window)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    out: str = "contamination",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    max_words: int = 200_000,
) -> DataFrame:
    """All columns of `docs` plus `out`: struct<n_words, n_hit, items, spans, stretches>; spans are byte
    ranges of `text`, stretches have their range of words besides and may overlap."""
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, item_id, item_text, window, max_words)
    parts = next(blocks)
    if parts == 1:
        return match_items(docs, spark.sparkContext.broadcast(next(blocks)), text, out)
    # one job a block: its automaton goes before the next is made, and only rows that it hits are written
    names = [c for c in docs.columns if c != out]
    held, folder = [f"c{i}" for i in range(len(names))], work_dir(spark, "contamination")
    rows = saved(docs.select(*names).toDF(*held).withColumn("row", F.monotonically_increasing_id()), f"{folder}/rows")
    texts = rows.select("row", F.col(held[names.index(text)]).alias("text"))
    for k, items in enumerate(blocks):
        shared = spark.sparkContext.broadcast(items)
        found = match_items(texts, shared, "text", "hit").select("row", "hit")
        saved(found if k == 0 else found.where("hit.n_hit > 0"), f"{folder}/hits/block={k}")
        shared.destroy()
    every = spark.read.schema(T.StructType([T.StructField("row", T.LongType()), T.StructField("hit", T.StructType.fromDDL(f"x {RESULT}")["x"].dataType)])).parquet(f"{folder}/hits")
    met = every.groupBy("row").agg(
        F.max("hit.n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hit.spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit.items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("hit.stretches"))).alias("stretches"),
    )
    # spans of several blocks of items may overlap: hit words are counted anew, from the merged spans
    merged = F.aggregate(
        "spans",
        F.array().cast("array<array<int>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.get(F.get(a, F.size(a) - 1), F.lit(1)) >= F.get(s, F.lit(0))),
            F.concat(
                F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(F.array(F.get(F.get(a, F.size(a) - 1), F.lit(0)), F.greatest(F.get(F.get(a, F.size(a) - 1), F.lit(1)), F.get(s, F.lit(1))))),
            ),
        ).otherwise(F.concat(a, F.array(s))),
    )
    joined = rows.join(met.withColumn("spans", merged), "row").select(*held, "n_words", "spans", "items", "stretches")
    body = F.encode(F.coalesce(F.col(held[names.index(text)]), F.lit("")), "utf-8")
    pieces = F.transform("spans", lambda s: F.decode(F.substring(body, F.get(s, F.lit(0)) + 1, F.get(s, F.lit(1)) - F.get(s, F.lit(0))), "utf-8"))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    n_hit = F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + F.regexp_count(p, F.lit(word)))
    result = F.struct("n_words", n_hit.alias("n_hit"), "items", "spans", "stretches")
    return joined.select(*[F.col(h).alias(n) for n, h in zip(names, held, strict=True)], result.alias(out))


def remove_spans(
    docs: DataFrame, text: str = "text", out: str = "contamination", least_words: int = 10, drop_share: float = 0.5
) -> DataFrame:
    """Takes stretches of at least `least_words` words out of `text`; shorter ones, which are whole short
    items, stay.  Documents of which more than `drop_share` of the words is in such stretches go, and so do
    those that are nothing but test items, whatever the items' lengths."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    long = F.filter(F.col(out)["stretches"], lambda s: F.get(s, F.lit(3)) - F.get(s, F.lit(2)) >= least_words)

    def step(a: Column, s: Column) -> Column:
        begin, end, first, last = (F.get(s, F.lit(i)) for i in range(4))
        # stretches that overlap or touch are cut as one, with what is between their words
        between = F.when(first > a["word"], F.substring(body, a["at"] + 1, begin - a["at"])).otherwise(F.encode(F.lit(""), "utf-8"))
        return F.struct(
            F.greatest(a["at"], end).alias("at"),
            F.greatest(a["word"], last).alias("word"),
            (a["n"] + F.greatest(F.lit(0), last - F.greatest(first, a["word"]))).alias("n"),
            F.concat(a["t"], between).alias("t"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("word"), F.lit(0).alias("n"), F.encode(F.lit(""), "utf-8").alias("t"))
    cut = F.aggregate(long, start, step)
    name = spare(docs.columns, "_cut")
    made = F.col(name)
    rest = F.decode(F.concat(made["t"], F.substring(body, made["at"] + 1, F.lit(2**31 - 1))), "utf-8")
    hit, n_words = F.col(out)["n_hit"], F.col(out)["n_words"]
    only_items = (hit == n_words) & (hit > drop_share * n_words)
    keep = docs.withColumn(name, cut).where(F.coalesce((made["n"] <= drop_share * n_words) & ~only_items, F.lit(True)))
    return keep.withColumn(text, F.when(made["n"] > 0, rest).otherwise(F.col(text))).drop(name)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of the query: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    done = contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.col("contamination")
    return done.select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (hit["n_hit"] > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
win AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) END) AS g FROM item
),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
),
size AS (SELECT DISTINCT len(g) AS n FROM win),
place AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM doc, size WHERE len(ws) >= n),
occ AS (SELECT a.doc_id, a.i, a.n, w.item_id FROM place a JOIN win w ON w.g = a.ws[a.i:a.i + a.n - 1]),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit ON hit.doc_id = doc.doc_id LEFT JOIN its ON its.doc_id = doc.doc_id
"""
