import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cutplan.llm import quality as Q


def corpus(n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        ws = ["".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 60))]
        text = " ".join(ws).capitalize() + "." if good else rng.choice([" ".join([ws[0]] * 30), " ".join(w.upper() + "!!" for w in ws), "### ".join(ws)])
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    extra = [(900, None), (901, ""), (902, "word " * 30_000)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(900, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.digest(d, lab).collect()}
    truth = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(got[i].held_out for i in truth) and len(got) == len(docs) + len(extra)
    assert sum(got[i].predicted == q for i, q in truth.items()) >= 0.97 * len(truth)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[900].score == got[901].score


def test_pairwise_fit_orders_and_cuts_at_the_quantile():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1.0, 0.3, (300, 5)), rng.normal(-1.0, 0.3, (100, 5))
    model = Q.bradley_terry(good, bad, 0.25, 4000, 1e-3)
    assert (model.score(good) > 0.5).mean() > 0.98 and (model.score(bad) < 0.5).mean() > 0.98


def test_one_class_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert Q.digest(d, lab).first().score == 0.5
    assert Q.digest(d.limit(0), lab.limit(0)).count() == 0


def plain_features(text):
    """The features of one text by plain loops."""
    data = text.encode() + b"\n"
    kinds = [int(Q.CLASS[b]) for b in data]
    out = [0.0] * (Q.SIDE * Q.SIDE)
    for a, b in zip(kinds, kinds[1:], strict=False):
        out[a * Q.SIDE + b] += 1
    out = [math.sqrt(c / len(data)) for c in out]
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in data)) if w]
    n, lines = len(words), data.count(b"\n")
    if n == 0:
        return out + [0.0] * 8
    threes = {tuple(words[i : i + 3]) for i in range(max(1, n - 2))}
    mean = sum(map(len, words)) / n
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1) if n > 1 else 0.0
    return out + [math.log1p(n), len(set(words)) / n, max(Counter(words).values()) / n, len(threes) / max(1, n - 2), math.log1p(mean), same, math.log1p(lines), lines / n]


def test_features_and_scores_equal_plain_loops(spark):
    docs, labels = corpus(200)
    texts = [t for _, t in docs] + ["", " \n\t ", "one", "Two two", "Ünïcode — ß\n\nlines | 3 * 4", "long words here, " * 80_000]
    got = np.concatenate([Q.features([t.encode() for t in texts[:100]]), Q.features([t.encode() for t in texts[100:-1]]), Q.features([texts[-1].encode()])])
    want = np.array([plain_features(t) for t in texts])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-5)

    d = spark.createDataFrame([(i, t, 0, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, y int, quality_score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.learn(d, lab)
    rows = {r.doc_id: r.score for r in Q.digest(d, lab).collect()}
    for i, x in enumerate(want):
        raw = sum(min(8.0, max(-8.0, (v - m) / s)) * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=True))
        assert abs(rows[i] - 1 / (1 + math.exp(-min(30.0, max(-30.0, raw - model.threshold))))) < 2e-3


def test_weights_minimise_the_logistic_loss_of_the_pairs():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.5, 1, (60, 4)), rng.normal(-0.5, 1, (40, 4))
    model = Q.bradley_terry(good, bad, 0.4, 500, 1e-2, seed=11)
    draw = np.random.default_rng(11)
    pairs = list(zip(draw.integers(60, size=500).tolist(), draw.integers(40, size=500).tolist(), strict=True))
    z = lambda x: [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale, strict=True)]
    slope = [1e-2 * w for w in model.weights]
    for g, b in pairs:
        diff = [p - q for p, q in zip(z(good[g]), z(bad[b]), strict=True)]
        lose = 1 / (1 + math.exp(sum(w * v for w, v in zip(model.weights, diff, strict=True))))
        slope = [s - lose * v / 500 for s, v in zip(slope, diff, strict=True)]
    assert max(map(abs, slope)) < 1e-4


def test_repeated_and_null_ids(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs + docs[:20] + [(None, "Some text.")] * 2, "doc_id long, text string")
    got = Q.digest(d, spark.createDataFrame(labels + labels[:20], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 222
    for i in [None, *range(20)]:
        assert len({r.score for r in got if r.doc_id == i}) == 1 and sum(r.doc_id == i for r in got) == 2


def test_sample_is_bounded_when_an_id_repeats_in_both_tables(spark, monkeypatch):
    docs, labels = corpus(300)
    hot = [(7, f"{docs[7][1]} {i % 900}") for i in range(3000)]
    d = spark.createDataFrame(docs + hot, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [labels[7]] * 2000, "doc_id long, quality int, toxic int")
    seen = []
    fit = Q.bradley_terry
    monkeypatch.setattr(Q, "bradley_terry", lambda good, bad, *rest: (seen.append(len(good) + len(bad)), fit(good, bad, *rest))[1])
    model = Q.learn(d, lab, sample=100, fold=None)
    assert 100 < seen[0] <= 200
    # labels and rows of one document that are repeated change nothing
    plain = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = Q.learn(*plain, fold=None)
    again = Q.learn(plain[0].unionByName(plain[0]), plain[1].unionByName(plain[1]), fold=None)
    assert np.array_equal(once.weights, again.weights) and once.threshold == again.threshold and model is not None


def test_every_labelled_document_counts_in_model_and_threshold(spark):
    docs, labels = corpus(6500)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.learn(d, lab, fold=None, pairs=1, ridge=1e-2)
    x, y = Q.features([t.encode() for _, t in docs]).astype(np.float64), np.array([q for _, q, _ in labels])
    # mean and spread are those of all documents, and a change of any one of them changes the model
    assert np.allclose(model.mean, x.mean(0), atol=1e-6) and np.allclose(model.scale, x.std(0) + 1e-3, atol=1e-4)
    other = Q.learn(d.withColumn("text", F.expr("CASE WHEN doc_id = 6017 THEN 'Something else.' ELSE text END")), lab, fold=None, pairs=1, ridge=1e-2)
    assert not np.array_equal(model.weights, other.weights)
    raw = np.sort(model.raw(x))
    at = int((y == 0).sum()) - 1
    assert abs(model.threshold - (raw[at - 1] + raw[at + 1]) / 2) < 1e-6


def test_pairs_hold_every_document_and_slopes_are_those_of_plain_sums(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = {1: 70, 0: 9}
    x = {y: rng.normal(0, 1, (k, Q.WIDTH)).astype(np.float32) for y, k in n.items()}
    rows = spark.createDataFrame([(y, r, x[y][r].tobytes()) for y in n for r in range(n[y])], "y int, r long, x binary")
    model = Q.Ranking(np.zeros(Q.WIDTH), np.ones(Q.WIDTH), np.zeros(Q.WIDTH), 0.0)
    monkeypatch.setattr(Q, "BLOCK", 16)
    made = {}
    for few in (0, 100):
        monkeypatch.setattr(Q, "FEW", few)
        df, total = Q.paired(rows, n, model, 200)
        made[few] = Q.saved(df, Q.work_dir(spark, "pairs"))
        assert total == made[few].count() == 210
    assert sorted(map(tuple, made[0].collect())) == sorted(map(tuple, made[100].collect()))
    want = np.array([x[1][q // 3] - x[0][q % 9] for q in range(210)], np.float64)
    assert len({(q // 3, q % 9) for q in range(210)}) == 210 and {q % 9 for q in range(210)} == set(range(9))
    w = rng.normal(0, 0.1, Q.WIDTH)
    gradient, curvature = Q.slope(made[0], w, 210)
    p = 1 / (1 + np.exp(want @ w))
    assert np.allclose(gradient, -want.T @ p / 210, atol=1e-5) and np.allclose(curvature, (want * (p * (1 - p))[:, None]).T @ want / 210, atol=1e-5)


def test_quantile_equals_that_of_sorted_values(spark):
    rng = random.Random(4)
    for good, bad, share in ((30, 10, (1, 4)), (5, 40, (9, 10)), (50, 50, (1, 3)), (1, 1, (1, 2))):
        part = [(1, float(rng.randrange(20))) for _ in range(good)] + [(0, float(rng.randrange(12))) for _ in range(bad)]
        weight = {1: (share[1] - share[0]) * bad, 0: share[0] * good}
        part.sort(key=lambda r: (r[1], r[0]))
        total, at = 0, 0
        for at, (y, _) in enumerate(part):  # noqa: B007
            total += weight[y]
            if total >= share[0] * good * bad:
                break
        nearby = [v for _, v in part[max(0, at - 1) : at + 2]]
        found = Q.quantile(spark.createDataFrame(part, "y int, raw double"), {1: good, 0: bad}, share)
        assert found == (min(nearby) + max(nearby)) / 2
