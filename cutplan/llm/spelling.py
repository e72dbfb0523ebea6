"""Operator 12: words that differ by one edit, by dynamic programming over sorted vocabulary.

1. Words are counted in one pass: runs of letters, lower-cased, noise taken as the query states it; only
   words and counts are shuffled, summed before that.
2. A near pair whose shorter word has m letters has one edit; the rest of both words is equal, so they have
   the first half or the last half of m letters in common.  A word therefore goes to four groups: for m its
   own length and one less, by that prefix and by that suffix.  What differs is the rest of the word without
   it.  Pairs found by prefix are passed over by suffix: there the rests must differ before the prefix ends.
   A group with more than `max_words` rows is split in the same way by the halves of its rests, until no group
   has more; at a rest of one letter none can (the alphabet bounds it), so it ends after log2(m) rounds.
3. Groups are dealt to shards.  A shard sorts the rests of each group and takes the longest common prefixes
   (LCP) of neighbours.  A range of the sorted list whose LCPs reach d shares one prefix of d letters, so
   the banded row of the edit matrix, D[d][d-1..d+1], is made once for the range and kept for all that
   continue it; a range whose row exceeds one edit throughout is skipped with everything in it.  All words of
   a group are looked up at once, depth by depth; a word that ends where its row says 1 is near.
4. A task gives each word's number of near words and the best of them, so no list of pairs is written.
   Roots follow forms by doubling; counts grow tenfold a step, which bounds the rounds.

Defined results: null and empty texts have no words; a null doc_id counts as the text `null`; rows of one
doc_id are worked through one by one; extra columns aren't used; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutplan.llm.shared import CRC_TABLE, ascii_lower, crc_sql, saved, work_dir

#: A fixed pattern and fixed numbers of the contract.
RUN = r"[A-Za-zÀ-ÿ]+"
NOISE = 31
#: No limit on the common prefix of two rests.
ANY = 1 << 30


def runs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, run): every maximal run of letters, A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(RUN), F.lit(0))
    d = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return docs.select(d.alias("d"), F.explode(found).alias("run")).select("d", ascii_lower(F.col("run")).alias("run"))


def struck(d: Column, run: Column) -> Column:
    """The run less one code point where the checksum of `<doc_id>:<run>` says so."""
    h = F.crc32(F.concat(d, F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): words of at least `min_chars` code points and `min_count` occurrences."""
    words = runs(docs, doc_id, text).where(F.char_length("run") >= min_chars).select(struck(F.col("d"), F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def halves(rest: Column, r: Column, limit: Column, key: Column) -> Column:
    """The two groups of a rest of at least r letters by its first half and its last half of r: array of (key, rest, r, limit).

    Two rests of one group must have fewer than `limit` letters in common from the start.
    """
    first = F.ceil(r / 2).cast("int")
    last = r - first
    size = F.char_length(rest)
    by_prefix = F.struct(
        F.concat(key, F.lit("<"), F.substring(rest, F.lit(1), first)).alias("key"),
        F.substring(rest, first + 1, size).alias("rest"),
        last.alias("r"),
        F.when(limit >= ANY, limit).otherwise(limit - first).alias("limit"),
    )
    by_suffix = F.struct(
        F.concat(key, F.lit(">"), F.substring(rest, size - last + 1, last)).alias("key"),
        F.substring(rest, F.lit(1), size - last).alias("rest"),
        first.alias("r"),
        F.least(limit, first).alias("limit"),
    )
    return F.filter(F.array(by_prefix, by_suffix), lambda g: g["limit"] > 0)


GROUP = ["word", "n", "m", "key", "rest", "r", "limit"]


def groups(words: DataFrame, max_words: int, folder: str) -> DataFrame:
    """(word, n, m, key, rest, r, limit): words in groups of at most `max_words` rows that hold every near pair exactly once.

    m is the length of the shorter word of the pairs that a group looks for.
    """
    size = F.char_length("word")
    each = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    cut = F.explode(halves(F.col("word"), F.col("m"), F.lit(ANY), F.concat(F.col("m").cast("string"), F.lit(":")))).alias("x")
    rows = saved(each.select("word", "n", "m", cut).select("word", "n", "m", "x.*").select(*GROUP), f"{folder}/groups-0")
    done, k = None, 0
    while True:
        k += 1
        large = saved(rows.where("r > 1").groupBy("key").count().where(F.col("count") > max_words).select("key"), f"{folder}/large-{k}")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fine = rows.join(large, "key", "left_anti").select(*GROUP)
        done = fine if done is None else done.unionByName(fine)
        wide = rows.join(large, "key", "left_semi")
        cut = F.explode(halves(F.col("rest"), F.col("r"), F.col("limit"), F.col("key"))).alias("x")
        rows = saved(wide.select("word", "n", "m", cut).select("word", "n", "m", "x.*").select(*GROUP), f"{folder}/groups-{k}")


class Sorted:
    """Rests of several groups, sorted within each, with the LCPs of neighbours; a group's first has -1."""

    def __init__(self, group: np.ndarray, rests: list[str]):
        self.order = sorted(range(len(rests)), key=lambda i: (group[i], rests[i]))
        texts = [rests[i] for i in self.order]
        self.group = group[self.order]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
        self.lcp = np.full(len(texts), -1, np.int64)
        open_ = np.flatnonzero(self.group[1:] == self.group[:-1]) + 1
        self.lcp[open_] = 0
        d = 0
        while len(open_):
            a, b = self.code(open_ - 1, d), self.code(open_, d)
            open_ = open_[(a == b) & (a >= 0)]
            d += 1
            self.lcp[open_] = d
        edge = np.flatnonzero(self.lcp == -1)
        number = np.cumsum(self.lcp == -1) - 1
        self.low = edge[number]
        self.high = np.append(edge[1:], len(texts))[number]

    def code(self, i: np.ndarray, d: int) -> np.ndarray:
        """Code point d of entries i, -1 beyond their ends."""
        inside = self.length[i] > d
        return np.where(inside, self.codes[np.minimum(self.start[i] + d, max(len(self.codes) - 1, 0))] if len(self.codes) else -1, -1)


def near_pairs(held: Sorted, asked: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry asked for, entry one edit away in its group), whose common prefix is below the entry's limit.

    A state is an asked entry and a range of the list that shares d letters, with its row D[d][d-1], D[d][d],
    D[d][d+1] capped at 2.  The next letter splits a range where the LCP is d; a row is made once for each part.
    """
    ask, low, high = asked, held.low[asked], held.high[asked]
    row = np.tile(np.array([[2], [0], [1]], np.int8), (1, len(asked)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size, d = held.length, 0
    while len(ask):
        row[2, size[ask] < d + 1] = 2
        live = (row.min(0) <= 1) & ~((limit[ask] == d) & (row[1] == 0))
        ask, low, high, row = ask[live], low[live], high[live], row[:, live]
        # an entry that ends here is the first of its range
        ends = np.flatnonzero(size[low] == d)
        off = size[ask[ends]] - d
        hit = (np.abs(off) <= 1) & (row[np.clip(off + 1, 0, 2), ends] == 1)
        found.append((ask[ends[hit]], low[ends[hit]]))
        low[ends] += 1
        # the parts of each range by the next letter
        edges = np.flatnonzero(held.lcp <= d)
        first = np.searchsorted(edges, low, "right") - 1
        first = np.where(edges[first] == low, first, first + 1) if len(edges) else first
        parts = np.where(low < high, np.searchsorted(edges, high) - first, 0)
        owner = np.repeat(np.arange(len(ask)), parts)
        at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        ask, low, high, row = ask[owner], edges[at], np.append(edges[1:], len(size))[at], row[:, owner]
        letter = held.code(low, d)
        unlike = [(held.code(ask, d + k) != letter).astype(np.int8) if d + k >= 0 else np.int8(2) for k in (-1, 0, 1)]
        below = np.minimum(row[0] + unlike[0], row[1] + 1)
        same = np.minimum(np.minimum(row[1] + unlike[1], row[2] + 1), below + 1)
        above = np.minimum(row[2] + unlike[2], same + 1)
        row = np.minimum(np.stack([below, same, above]), 2).astype(np.int8)
        row[1, size[ask] < d + 1] = 2
        d += 1
    ask, other = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
    return ask, other


#: States that a lookup may hold at once, at most one for each asked entry and entry of its group.
STATES = 1 << 22


def shard_links(word: np.ndarray, n: np.ndarray, m: np.ndarray, key: np.ndarray, rest: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, near words, best n, best word) of rows of whole groups, for rows that have near words in their group."""
    group = np.unique(key, return_inverse=True)[1]
    held = Sorted(group, rest.tolist())
    order = np.array(held.order, np.int64)
    size = np.fromiter(map(len, word), np.int64, len(word))[order]
    asked = np.flatnonzero(size == m[order])
    asked = asked[(held.high - held.low)[asked] > 1]
    cost = np.cumsum((held.high - held.low)[asked])
    cuts = np.searchsorted(cost, np.arange(0, (cost[-1] if len(cost) else 0) + STATES, STATES))
    alphabetic = np.empty(len(word), np.int64)
    alphabetic[sorted(range(len(word)), key=word.__getitem__)] = np.arange(len(word))
    count = np.zeros(len(word), np.int64)
    best = np.full(len(word), -1, np.int64)
    top = np.zeros(len(word), np.int64)
    for lo, hi in pairwise(np.unique(np.append(cuts, len(asked)))):
        a, b = near_pairs(held, asked[lo:hi], limit[order])
        # words of equal length ask for each other; of a word and a longer one only the shorter asks
        longer = size[a] != size[b]
        one, two = order[np.concatenate([a, b[longer]])], order[np.concatenate([b, a[longer]])]
        np.add.at(count, one, 1)
        turn = np.lexsort((alphabetic[two], -n[two], one))
        one, two = one[turn], two[turn]
        lead = np.flatnonzero(np.diff(one, prepend=-1))
        one, two = one[lead], two[lead]
        better = (n[two] > top[one]) | ((n[two] == top[one]) & (alphabetic[two] < alphabetic[best[one]]))
        best[one[better]], top[one[better]] = two[better], n[two[better]]
    hit = np.flatnonzero(count)
    return word[hit], count[hit], top[hit], word[best[hit]]


LINKS = "word string, links long, best_n long, best string"


def near_words(words: DataFrame, max_words: int = 10_000, shard_rows: int = 50_000, folder: str | None = None) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words; best is the near word of the largest n, ties the smallest."""
    folder = folder or work_dir(words.sparkSession, "spelling")
    rows = groups(words, max_words, folder)
    shards = max(1, -(-rows.count() // shard_rows))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        columns = (part[c].to_numpy() for c in ("word", "n", "m", "key", "rest", "limit"))
        return pd.DataFrame(dict(zip(("word", "links", "best_n", "best"), shard_links(*columns), strict=True)))

    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "word", "n", "m", "key", "rest", "limit")
    links = dealt.groupBy("shard").applyInPandas(run, LINKS)
    # the least of (-n, word) is the largest n and, of equals, the first word
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    found = links.groupBy("word").agg(F.sum("links").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of words (word, form) that have a form: the last word that forms lead to."""
    now, k = saved(forms.select("word", F.col("form").alias("root")), f"{folder}/roots-0"), 0
    while True:
        k += 1
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = saved(step, f"{folder}/roots-{k}")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 7, min_count: int = 2, ratio: int = 10, **limits: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    A word's form is its near word of the largest n if that is at least `ratio` times the word's; `limits` are those of `near_words`.
    """
    folder = work_dir(docs.sparkSession, "spelling")
    words = saved(vocabulary(docs, doc_id, text, min_chars, min_count), f"{folder}/words")
    joined = words.join(near_words(words, folder=folder, **limits), "word", "left")
    strong = F.col("best_n") >= ratio * F.col("n")
    linked = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"))
    linked = saved(linked, f"{folder}/linked")
    last = roots(linked.where("form IS NOT NULL"), folder)
    return linked.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def normalized(docs: DataFrame, found: DataFrame, text: str = "text", out: str = "normalized") -> DataFrame:
    """All columns of `docs` and `out`, the text with every run of letters lower-cased and replaced by the root of its word; a null text stays null.

    Runs are looked up one by one, so a text of any length is put together again by row.
    """
    names = docs.columns
    held = [f"_c{i}" for i in range(len(names))]
    body = F.col(held[names.index(text)]).cast("string")
    numbered = docs.toDF(*held).withColumn("_row", F.monotonically_increasing_id())
    folder = work_dir(docs.sparkSession, "normalized")
    rows = saved(numbered, f"{folder}/rows")
    pieces = F.regexp_extract_all(body, F.lit(r"[A-Za-zÀ-ÿ]+|[^A-Za-zÀ-ÿ]+"), F.lit(0))
    each = rows.select("_row", F.posexplode(pieces).alias("_pos", "_piece")).withColumn("_word", ascii_lower(F.col("_piece")))
    table = found.where("form IS NOT NULL").select(F.col("word").alias("_word"), F.col("root").alias("_root"))
    put = each.join(table, "_word", "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_root", "_piece").alias("p")))).alias("_all"))
    joined = rows.join(put, "_row", "left")
    made = F.when(body.isNotNull(), F.coalesce(F.array_join(F.transform("_all", lambda x: x["p"]), ""), F.lit("")))
    columns = [F.col(h).alias(n) for n, h in zip(names, held, strict=True) if n != out]
    return joined.select(*columns, made.alias(out))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: word, form, root, n, n_near, form_n."""
    return variants(docs.select("doc_id", "text"))


#: Of near words one is the other less a letter, or both are equal without the letter at one place.
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
),
counted AS (SELECT d, run, count(*) AS k FROM run WHERE length(run) >= 7 GROUP BY d, run),
checked AS (SELECT run, k, CAST({crc_sql("d || ':' || run")} AS BIGINT) AS h FROM counted CROSS JOIN crc_table),
struck AS (
  SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM checked
),
word AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM struck WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gap AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, unnest(range(0, length(word))) AS i FROM word)
),
near AS (
  SELECT a.word AS a, b.word AS b FROM gap a JOIN gap b USING (i, s) WHERE a.word <> b.word
  UNION
  SELECT word, s FROM gap WHERE s IN (SELECT word FROM word)
  UNION
  SELECT s, word FROM gap WHERE s IN (SELECT word FROM word)
),
best AS (
  SELECT a.word, any_value(a.n) AS n, count(*) AS n_near, max(b.n) AS top, min(struct_pack(k := -b.n, w := b.word)).w AS best
  FROM near JOIN word a ON a.word = near.a JOIN word b ON b.word = near.b GROUP BY a.word
),
form AS (SELECT word, best AS form, top AS form_n FROM best WHERE top >= 10 * n),
chain AS (
  SELECT word, form AS root FROM form
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.root
),
last AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM form))
SELECT w.word, f.form, coalesce(l.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM word w LEFT JOIN best b USING (word) LEFT JOIN form f USING (word) LEFT JOIN last l USING (word)
"""
