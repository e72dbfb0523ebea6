"""Operator 5: document quality by Bradley-Terry pairwise ranking.

Features of a text: how often each pair of neighbouring byte classes occurs, and figures of its words
(length, repeats of words and of runs of three, line and word counts).  Preference pairs take one good
and one bad training document; weights minimise the logistic loss on feature differences with an L2
term, by Newton's method, so the score difference of two documents is the log-odds that the first is
the better one.  The threshold is the score quantile at the share of bad documents among the labelled
training rows; the reported score is the logistic of the distance to it.

All labelled training documents count: mean, spread, weights and threshold come from each of them.  Their
features are stored once.  The larger class is numbered, and each of its documents is paired with documents of
the smaller one in turn, so every document is in a pair; there are at least `pairs` pairs where the classes
allow as many different ones.  A step of Newton's method is a pass over the stored pairs, of which tasks return
sums; sums are whole numbers of small units, so the model doesn't depend on how rows lie in partitions.  The
quantile is exact, by counts along the order of scores.  `sample` is an option for fits on about that many
documents a class; no query uses it.  Scoring is one pass.

Defined results: null text counts as empty and gets the score of an empty text; rows without a label
or with a null one aren't learned from; equal labels of one doc_id count once, as do equal texts of it,
unequal ones each; without both classes every score is 0.5; rows are independent; an empty table gives an empty table; extra columns aren't used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutplan.llm import kernels as K
from cutplan.llm.shared import crc_mod, saved, with_column, work_dir
from cutplan.operators.prefix import numbered, running_sum

# Byte classes; a byte that none lists is of class 0.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "*#", "$%&", "-_", "()[]{}<>", "@/\\"]
SIDE = len(CLASSES) + 2
CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(CLASSES):
    CLASS[list(_chars.encode())] = _k + 1
CLASS[128:] = SIDE - 1
WIDTH = SIDE * SIDE + 8

#: Units of sums, of single values and of blocks of pairs, and the pairs of a block.
VALUE_UNIT, BLOCK_UNIT, BLOCK = 2.0**28, 2.0**24, 1024
#: A vector of sums is added up in this many parts.
SLOTS = 8
#: The smaller class is broadcast up to this many documents, about a kilobyte each.
FEW = 1000


def features(texts: list[bytes]) -> np.ndarray:
    """float32[texts, WIDTH] of one block of texts."""
    joined = b"\n".join(texts) + b"\n"
    kinds = CLASS[np.frombuffer(joined, np.uint8)]
    lengths = np.array([len(t) + 1 for t in texts])
    offset = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(texts)), lengths)
    code = owner[:-1] * SIDE * SIDE + kinds[:-1] * SIDE + kinds[1:]
    inside = owner[:-1] == owner[1:]
    pair = np.bincount(code[inside], minlength=len(texts) * SIDE * SIDE)
    out = np.empty((len(texts), WIDTH), np.float32)
    out[:, : SIDE * SIDE] = np.sqrt(pair.reshape(len(texts), -1) / lengths[:, None])
    hashed, start, end, bounds = K.words(texts, K.NOT_SPACE)
    size = end - start
    for i in range(len(texts)):
        w = hashed[bounds[i] : bounds[i + 1]]
        n = len(w)
        if n == 0:
            out[i, SIDE * SIDE :] = 0
            continue
        counts = np.unique(w, return_counts=True)[1]
        threes = len(K.shingles(w, 3)) / max(1, n - 2)
        mean = float(size[bounds[i] : bounds[i + 1]].mean())
        same_next = float(np.mean(w[1:] == w[:-1])) if n > 1 else 0.0
        lines = joined.count(b"\n", int(offset[i]), int(offset[i + 1]))
        out[i, SIDE * SIDE :] = (np.log1p(n), len(counts) / n, counts.max() / n, threes, np.log1p(mean), same_next, np.log1p(lines), lines / n)
    return out


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        # summed row by row, so that a text's score doesn't depend on those beside it
        return (self.standard(x) * self.weights).sum(1)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.float64) - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, share_bad: float, pairs: int, ridge: float, seed: int = 7) -> Ranking:
    """Weights from `pairs` random preference pairs, and the threshold at the quantile `share_bad`."""
    both = np.concatenate([good, bad]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    model = Ranking(mean, scale, np.zeros(both.shape[1]), 0.0)
    rng = np.random.default_rng(seed)
    z = lambda x: np.clip((x.astype(np.float64) - mean) / scale, -8, 8)
    d = z(good[rng.integers(len(good), size=pairs)]) - z(bad[rng.integers(len(bad), size=pairs)])
    w = model.weights
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = ridge * w - d.T @ p / pairs
        curvature = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    model.weights = w
    up, down = np.sort(model.raw(good)), np.sort(model.raw(bad))
    values = np.concatenate([up, down])
    weight = np.concatenate([np.full(len(up), (1 - share_bad) / len(up)), np.full(len(down), share_bad / len(down))])
    order = np.argsort(values)
    at = min(int(np.searchsorted(np.cumsum(weight[order]), share_bad)), len(order) - 1)
    nearby = values[order][max(0, at - 1) : at + 2]
    model.threshold = float((nearby.min() + nearby.max()) / 2)
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), WIDTH)


def _totals(rows: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of the int64 vector that `sums` makes of a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [v.tobytes() for v in np.array_split(sums(batches), SLOTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array(pieces, pa.binary())], names=["slot", "v"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, np.int64) for v in group["v"].to_pylist()], axis=0)
        return pa.table({"slot": group["slot"][:1], "v": pa.array([total.tobytes()], pa.binary())})

    found = rows.mapInArrow(run, "slot int, v binary").groupBy("slot").applyInArrow(add, "slot int, v binary").collect()
    return np.concatenate([np.frombuffer(r["v"], np.int64) for r in sorted(found, key=lambda r: r["slot"])])


def moments(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the features of all n rows (x)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2 * WIDTH, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            total += np.rint(np.concatenate([x, x * x], axis=1) * VALUE_UNIT).astype(np.int64).sum(0)
        return total

    first, second = np.split(_totals(rows.select("x"), sums) / VALUE_UNIT / n, 2)
    return first, np.sqrt(np.maximum(0, second - first * first))


def paired(rows: DataFrame, sizes: dict[int, int], model: Ranking, pairs: int) -> tuple[DataFrame, int]:
    """(q, d): numbered pairs with the difference of good and bad features, and their number; rows (y, r, x) have numbers r by class."""
    small, large = sorted((0, 1), key=lambda y: (sizes[y], y))
    each = min(sizes[small], max(1, -(-pairs // sizes[large])))
    turns = F.explode(F.sequence(F.col("r") * each, F.col("r") * each + each - 1)).alias("q")
    many = rows.where(F.col("y") == large).select(turns, "x").withColumn("other", F.col("q") % sizes[small])
    few = rows.where(F.col("y") == small).select(F.col("r").alias("other"), F.col("x").alias("z"))
    both = many.join(F.broadcast(few) if sizes[small] <= FEW else few, "other").select("q", "x", "z")
    sign = 1 if large == 1 else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                d = sign * (model.standard(_matrix(part.column(1))) - model.standard(_matrix(part.column(2))))
                found = [v.tobytes() for v in d.astype(np.float32)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["q", "d"])

    total = sizes[large] * each
    files = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (32 * BLOCK)))
    dealt = both.mapInArrow(run, "q long, d binary").repartition(files, F.floor(F.col("q") / BLOCK))
    return dealt.sortWithinPartitions("q"), total


def slope(rows: DataFrame, weights: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean logistic loss over all pairs (q, d), which lie in order of q, block by block."""

    def block(d: np.ndarray) -> np.ndarray:
        d = d.astype(np.float64)
        p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
        return np.rint(np.concatenate([-(d.T @ p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()]) * BLOCK_UNIT).astype(np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(WIDTH + WIDTH * WIDTH, np.int64)
        q, d = np.empty(0, np.int64), np.empty((0, WIDTH), np.float32)
        for batch in batches:
            q, d = np.concatenate([q, batch.column(0).to_numpy()]), np.concatenate([d, _matrix(batch.column(1))])
            edge = [0, *(np.flatnonzero(np.diff(q // BLOCK)) + 1).tolist()]
            for lo, hi in zip(edge, edge[1:], strict=False):
                out += block(d[lo:hi])
            q, d = q[edge[-1] :], d[edge[-1] :]
        return out + block(d) if len(d) else out

    found = _totals(rows, sums) / BLOCK_UNIT / total
    return found[:WIDTH], found[WIDTH:].reshape(WIDTH, WIDTH)


def quantile(scores: DataFrame, sizes: dict[int, int], share: tuple[int, int]) -> float:
    """The threshold: the middle of the neighbours of the value at which the weights of scores (y, raw) reach the share of bad ones.

    share (bad, all) in whole numbers; each class weighs as much as its share, whatever its number of scores.
    """
    bad, whole = share
    weight = {1: (whole - bad) * sizes[0], 0: bad * sizes[1]}
    target = bad * sizes[0] * sizes[1]
    groups = scores.groupBy("raw", "y").agg(F.count(F.lit(1)).alias("n"))
    one = F.when(F.col("y") == 1, F.lit(str(weight[1]))).otherwise(F.lit(str(weight[0]))).cast("decimal(27,0)")
    sums = running_sum(groups, [], ["raw", "y"], (F.col("n").cast("decimal(10,0)") * one).cast("decimal(28,0)"), "upto")
    hit = sums.where(F.col("upto") >= F.lit(str(target)).cast("decimal(38,0)")).orderBy("raw", "y").first()
    v, w = hit["raw"], weight[hit["y"]]
    k = -((int(hit["upto"]) - hit["n"] * w - target) // w)
    key, here = F.struct("raw", "y"), F.struct(F.lit(v).alias("raw"), F.lit(hit["y"]).alias("y"))
    near = groups.agg(F.max(F.when(key < here, F.col("raw"))).alias("low"), F.min(F.when(key > here, F.col("raw"))).alias("high")).first()
    low = v if k > 1 or near["low"] is None else near["low"]
    high = v if k < hit["n"] or near["high"] is None else near["high"]
    return (low + high) / 2


def fit(rows: DataFrame, labelled: dict[int, int], pairs: int, ridge: float, folder: str) -> Ranking | None:
    """Weights and threshold from all rows (y, id, t, x), job by job on Spark; `labelled` rows of each class give the share of bad ones."""
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    mean, spread = moments(rows, sum(sizes.values()))
    model = Ranking(mean, spread + 1e-3, np.zeros(WIDTH), 0.0)
    placed = numbered(rows.withColumn("h", F.xxhash64("id", "t")), ["y"], ["h", "id", "t"], "r").select("y", "r", "x")
    made, total = paired(placed, sizes, model, pairs)
    made = saved(made, f"{folder}/pairs", clear=True)
    w = model.weights
    for _ in range(25):
        gradient, curvature = slope(made, w, total)
        step = np.linalg.solve(curvature + ridge * np.eye(WIDTH), gradient + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    model.weights = w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.raw(_matrix(batch.column(1))), pa.float64())], names=["y", "raw"])

    scores = saved(rows.select("y", "x").mapInArrow(run, "y int, raw double"), f"{folder}/scores")
    model.threshold = quantile(scores, sizes, (labelled[0], labelled[0] + labelled[1]))
    return model


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int | None = None,
    pairs: int = 12000, ridge: float = 1e-3, fold: int | None = 1,
) -> Ranking | None:
    """Learns from labelled rows whose crc32(doc_id) mod 3 isn't `fold` (None: from all); None without both classes.

    With `sample` it learns from about that many documents a class and at most twice as many in all, fitted on the driver.
    """
    usable = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if fold is not None:
        usable, rows = (d.where(crc_mod(F.col("id"), 3) != fold) for d in (usable, rows))
    usable = usable.distinct()
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    if sample is not None:
        share = F.when(F.col("y") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
        place = F.xxhash64(F.lit("sample"), "id")
        usable = F.broadcast(usable.where(F.pmod(place, F.lit(1 << 20)) < share * (1 << 20)).orderBy(place, "id", "y").limit(2 * sample))
        rows = rows.join(usable.select("id").distinct(), "id", "left_semi")
    rows = rows.where("id IS NOT NULL").select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.as_bytes(batch.column(2))
            for lo, hi in K.blocks(texts):
                found = [x.tobytes() for x in features(texts[lo:hi])]
                held = [batch.column(i).slice(lo, hi - lo) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(found, pa.binary())], names=["id", "t", "x"])

    # features meet the labels, not texts: they are much smaller once packed
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, t bigint, x binary").join(usable, "id")
    found = made.groupBy("y", "id", "t").agg(F.first("x").alias("x"))
    if sample is None:
        folder = work_dir(docs.sparkSession, "quality")
        return fit(saved(found, f"{folder}/features", clear=True), sizes, pairs, ridge, folder)
    got = found.orderBy(F.xxhash64("id", "t"), "id", "t", "y").limit(2 * sample).select("y", "x").toArrow()
    y = got["y"].to_numpy()
    x = _matrix(got["x"])
    order = np.lexsort(np.concatenate([x, y[:, None]], axis=1).T)
    x, y = x[order], y[order]
    if not (0 < y.sum() < len(y)):
        return None
    return bradley_terry(x[y == 1], x[y == 0], sizes[0] / (sizes[0] + sizes[1]), pairs, ridge)


def score(docs: DataFrame, model: Ranking | None, text: str = "text", out: str = "quality_score") -> DataFrame:
    """All columns of `docs` plus `out`, the score between 0 and 1."""
    names = [c for c in docs.columns if c != out]
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_column(docs.select(*names), out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.as_bytes(batch.column(at))
            for lo, hi in K.blocks(texts):
                part = batch.slice(lo, hi - lo)
                value = np.full(hi - lo, 0.5) if shared.value is None else shared.value.score(features(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], names=[*names, out])

    return docs.select(*names).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the query: doc_id, held_out, score, predicted."""
    model = learn(docs, labels)
    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    done = score(rows, model, out="score")
    return done.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
