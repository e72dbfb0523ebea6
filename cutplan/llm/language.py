"""Operator 2: language identification by bit-sliced Bloom filters of n-grams.

Filter.  Row b of the filter is a mask of languages, as many 64-bit words as there are languages for;
an n-gram of language l sets bit l in `probes` rows.  One lookup, the AND of an n-gram's rows, gives all languages that hold it at once.

Learning.  N-grams (`n` bytes, lower-cased, words only) of at most `sample` training documents per
language are counted in Spark; each language's most telling `grams` n-grams go into the filter: those
with the largest surplus of their share in the language over their mean share in the others.

Prediction.  A document's popcount for language l, hits of its n-grams, has false positives: with fill
rate f_l of the language's slice, a foreign n-gram hits with f_l**probes.  Corrected, the hits are
(hits - n * fp_l) / (1 - fp_l); they are divided by the share of hits that the language's own training
documents have, which makes slices comparable, and the largest decides.  The score is its part of the
sum over languages.

Defined results: a text that is null or has no letter is `und` with score 0; a text whose n-grams hit
no slice, or is shorter than an n-gram, gets the most frequent training language with score 0; ties go
to the language that sorts first; without training rows every text is `und`; rows are independent;
an empty table gives an empty table; extra columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutplan.llm import kernels as K
from cutplan.llm.shared import crc_mod

#: Byte classes: ASCII letters and all bytes of other characters make words; anything else parts them.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def fold(joined: bytes) -> np.ndarray:
    """Lower-cased bytes with every byte that isn't part of a word as a blank."""
    data = K.LOWERED[np.frombuffer(joined, np.uint8)]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1 if len(data) > 1 else []
    data[upper] += 0x20
    return np.where(LETTER[data], data, np.uint8(32))


def grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the n-byte runs of each text, blank-padded; runs with two blanks in a row are left out."""
    data = fold(b" " + b"  ".join(texts) + b" ")
    if len(data) < n:
        return np.zeros(0, K.U), np.zeros(0, np.int64)
    code = np.zeros(len(data) - n + 1, K.U)
    double = np.zeros(len(data) - n + 1, bool)
    blank = data == 32
    for i in range(n):
        code = (code << K.U(8)) | data[i : len(data) - n + 1 + i]
        if i:
            double |= blank[i - 1 : len(data) - n + i] & blank[i : len(data) - n + 1 + i]
    at = np.flatnonzero(~double)
    offset = np.cumsum([0, *(len(t) + 2 for t in texts)])
    return K.mix(code[at]), np.searchsorted(offset, at, side="right") - 1


@dataclass
class Filter:
    """The bit-sliced filter with what the decision needs; its size is `bits` rows of 8 bytes for each 64 languages."""

    languages: list[str]
    rows: np.ndarray
    probes: int
    n: int
    false_rate: np.ndarray
    own_rate: np.ndarray
    fallback: int

    def masks(self, hashed: np.ndarray) -> np.ndarray:
        """Masks of the languages that hold each n-gram: one word, or a row of words where there are more than 64."""
        found = self.words(hashed)
        return found[:, 0] if found.shape[1] == 1 else found

    def words(self, hashed: np.ndarray) -> np.ndarray:
        bits = K.U(len(self.rows) - 1)
        found = self.rows[hashed & bits]
        for k in range(1, self.probes):
            found &= self.rows[(hashed >> K.U(20 * k)) & bits]
        return found

    def corrected(self, texts: list[bytes]) -> np.ndarray:
        """float[texts, languages]: share of n-grams that are the language's, without false positives."""
        hashed, owner = grams(texts, self.n)
        total = np.bincount(owner, minlength=len(texts))[: len(texts)].astype(float)
        masks = np.ascontiguousarray(self.words(hashed).T)
        hits = np.stack(
            [np.bincount(owner[(masks[k >> 6] >> K.U(k & 63)) & K.U(1) == 1], minlength=len(texts))[: len(texts)] for k in range(len(self.languages))],
            axis=1,
        )
        share = hits / np.maximum(total, 1)[:, None]
        return np.maximum(0, (share - self.false_rate) / (1 - self.false_rate)) * (total > 0)[:, None]

    def decide(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        weighed = self.corrected(texts) / self.own_rate
        best = weighed.argmax(1)
        total = weighed.sum(1)
        score = np.divide(weighed[np.arange(len(texts)), best], total, out=np.zeros(len(texts)), where=total > 0)
        return np.where(total > 0, best, self.fallback), score


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, sample: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """About `sample` rows per language at most, taken by a hash of doc_id, and the languages' row counts."""
    rows = docs.where((crc_mod(F.col(doc_id), 4) != 2) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = [(r["lang"], r["n"]) for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()]
    shares = docs.sparkSession.createDataFrame([(name, min(1.0, sample / n)) for name, n in sizes], "_lang string, _share double")
    kept = F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id)), F.lit(1 << 20)) < F.col("_share") * (1 << 20)
    rows = rows.select(F.col(doc_id), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(shares), F.col("lang") == F.col("_lang"))
    return rows.where(kept).select("lang", "text"), sizes


def learn(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", n: int = 4, grams_kept: int = 3000, bits: int = 1 << 18,
    probes: int = 3, sample: int = 2000,
) -> Filter | None:
    """Learns from rows whose crc32(doc_id) mod 4 isn't 2 and whose lang isn't null; None without any."""
    rows, sizes = training_rows(docs, doc_id, text, lang, sample)
    if not sizes:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = np.array(batch.column(0).to_pylist(), object), K.as_bytes(batch.column(1))
            for lo, hi in K.blocks(texts):
                hashed, owner = grams(texts[lo:hi], n)
                for name in sorted(set(names[lo:hi])):
                    mine = np.isin(owner, np.flatnonzero(names[lo:hi] == name))
                    gram, c = np.unique(hashed[mine], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram.view(np.int64)), pa.array(c)], names=["lang", "gram", "c"])

    counts = rows.mapInArrow(count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")).persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
    languages = sorted(totals)
    known = docs.sparkSession.createDataFrame([(name, k, totals[name]) for k, name in enumerate(languages)], "lang string, k int, total long")
    share = counts.join(F.broadcast(known), "lang").select("gram", F.struct("k", (F.col("c") / F.col("total")).alias("own")).alias("s"))
    every = share.groupBy("gram").agg(F.array_sort(F.collect_list("s")).alias("every")).select("gram", "every", F.explode("every").alias("s"))
    # summed in the order of languages, so that runs agree to the last bit
    rest = F.aggregate("every", F.lit(0.0), lambda a, s: a + F.when(s["k"] == F.col("s.k"), 0.0).otherwise(s["own"])) / max(1, len(languages) - 1)
    top = every.select("gram", "s.k", "s.own", (F.col("s.own") - rest).alias("surplus")).where("surplus > 0")
    order = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("surplus"), "gram"))
    best = top.withColumn("place", order).where(F.col("place") <= grams_kept).select("k", "place", "gram", "own").toPandas()
    counts.unpersist()
    table = np.zeros((bits, -(-len(languages) // 64)), K.U)
    own = np.zeros(len(languages))
    for k, mine in best.sort_values(["k", "place"]).groupby("k"):
        gram = mine["gram"].to_numpy(np.int64).view(K.U)
        own[k] = sum(mine["own"].tolist())
        for i in range(probes):
            table[(gram >> K.U(20 * i)) & K.U(bits - 1), k >> 6] |= K.U(1) << K.U(k & 63)
    fill = np.array([np.mean((table[:, k >> 6] >> K.U(k & 63)) & K.U(1)) for k in range(len(languages))])
    largest = next((name for name, _ in sizes if name in totals), languages[0])
    return Filter(languages, table, probes, n, fill**probes, np.maximum(own, 1e-9), languages.index(largest))


def predict(docs: DataFrame, model: Filter | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (crc_mod(F.col(doc_id), 4) == 2).alias("held_out"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        F.col(text).alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, letters = K.as_bytes(batch.column(3)), np.array(batch.column(2).to_pylist(), bool)
            names, scores = [], []
            for lo, hi in K.blocks(texts):
                if shared.value is None:
                    names += ["und"] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                best, score = shared.value.decide(texts[lo:hi])
                names += [shared.value.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters[lo:hi], strict=True)]
                scores += np.where(letters[lo:hi], score, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: doc_id, held_out, lang_pred, score."""
    return predict(docs, learn(docs))
