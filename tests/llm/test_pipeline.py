"""Each stage on its own input, on a small fixture, against brute force."""

import random
import re

import pytest

import corpus_pipeline as P
from cutplan.llm.packing import CAPACITIES
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_near_dedup import null_ids


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(14))
    common = " ".join(word() for _ in range(12))
    docs, labels = [], []
    for i in range(300):
        ws = [word() for _ in range(rng.randrange(30, 80))]
        good = i % 4 != 0
        text = " ".join(ws).capitalize() + "." if good else rng.choice([" ".join([ws[0]] * 40), " ".join(w.upper() + "!!" for w in ws)])
        if good and i % 10 == 1:
            text = common + "\n" + text
        if good and i % 15 == 2:
            text += " " + passage + " " + " ".join(ws[:6])
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
        if good and i % 12 == 3:
            docs.append((1000 + i, text.replace(ws[5], "changed", 1), "en", "s", len(text)))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, labels, [(1, passage)]


def rows(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: r[0])


def test_stages(spark, tables):
    folder, docs, labels, items = tables
    given = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    kept = rows(P.quality_stage(spark, given, folder))
    ids = {i for i, _ in kept}
    truth = {i: q for i, q, _ in labels}
    assert sum((i in ids) == bool(q) for i, q in truth.items()) >= 0.98 * len(truth)

    texts = [(d, t) for d, t, *_ in docs]
    want = [(d, k) for d, _, n, k in lines(texts, 40, 5) if n == 0 or k]
    assert [(d, t or "") for d, t in rows(P.line_stage(spark, given, folder))] == want

    want = [d for d, _, root in near(texts, 5, 80) if d == root]
    assert [d for d, _ in rows(P.near_stage(spark, given, folder))] == want

    got = dict(rows(P.benchmark_stage(spark, given, folder)))
    for d, t in texts:
        n_words, n_hit, _ = hits(t, items)
        if n_hit == 0:
            assert got[d] == t
        elif n_hit <= 0.5 * n_words:
            assert items[0][1] not in got[d] and re.sub(r"\s", "", got[d]) == re.sub(r"\s", "", t.replace(items[0][1], ""))
        else:
            assert d not in got


def test_near_stage_with_null_and_repeated_ids(spark):
    docs = null_ids()
    given = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.near_stage(spark, given, "").collect()]
    texts = [t or "" for _, t in got]
    assert len(got) == 5 and texts.count("") == 2
    assert sorted(t.split()[1][0] for t in texts if t) == ["a", "b", "c"]
    assert [d for d, t in got if t and t.split()[1][0] == "a"] == [3]


def test_run_packs_what_is_kept(spark, tables):
    folder, docs, *_ = tables
    got = P.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert ids <= {d[0] for d in docs} and len(ids) > 200
    assert all(r.capacity in CAPACITIES and r.place + r.length <= r.capacity for r in got)
