import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutplan.llm import kernels as K
from cutplan.llm import suffix_trees as S

DDL = "doc_id long, text string"


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(docs, length):
    windows = Counter()
    for _, t in docs:
        words = split(t)
        windows.update(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
    out = []
    for d, t in docs:
        words = split(t)
        gone = set()
        for i in range(len(words) - length + 1):
            if windows[tuple(words[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def plain(frame):
    assert frame.columns == ["doc_id", "n_words", "n_removed", "kept"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


def corpus(seed, n=90, vocabulary=30):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["É x", "W1", "w1,"]
    passages = [[rng.choice(words) for _ in range(rng.randrange(3, 40))] for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randrange(12))] for _ in range(rng.randrange(6))]
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n "), (None, docs[0][1]), (None, None), (3, docs[3][1]), (3, docs[3][1]), (3, "other text"), (n + 3, "a b " * 60)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("length", "gram", "max_contexts"), [(5, 2, 4000), (9, 3, 2), (6, 1, 1), (12, 5, 3)])
def test_equals_brute_force_with_groups_of_any_size(spark, length, gram, max_contexts):
    docs = corpus(length)
    frame = spark.createDataFrame(docs, DDL).withColumns({"d": F.lit("x"), "tag": F.lit(1), "spans": F.lit(None), "start": F.lit(2)})
    got = S.remove_passages(frame, length=length, gram=gram, shard_words=400, max_contexts=max_contexts)
    assert plain(got) == brute(docs, length)


def test_one_frequent_line_in_front_of_different_texts(spark):
    rng = random.Random(1)
    line = " ".join(f"notice{k}" for k in range(8))
    docs = [(i, f"{' '.join(str(rng.random()) for _ in range(9))} {line} {' '.join(rng.choice('xyz') for _ in range(9))}") for i in range(400)]
    docs += [(1000 + i, docs[i][1] + " end") for i in range(3)]
    got = S.remove_passages(spark.createDataFrame(docs, DDL), length=12, gram=3, max_contexts=20)
    assert plain(got) == brute(docs, 12)


def test_copies_and_an_own_repeat_go_and_neighbours_stay(spark):
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))
    passage, copy = fresh(50), fresh(80)
    docs = [(1, f"{fresh(40)} {passage} {fresh(40)}"), (2, passage.replace(" ", "\n")), (3, copy), (4, copy), (5, fresh(500)), (6, f"{copy[:200]}")]
    docs += [(7, f"{(own := fresh(35))} {fresh(3)} {own}"), (8, passage.upper())]
    got = {r.doc_id: r.n_removed for r in S.digest(spark.createDataFrame(docs, DDL)).collect()}
    assert got == {d: n for d, _, n, _ in brute(docs, 35)}
    assert got[1] == 50 and got[2] == 50 and got[3] == 80 and got[5] == 0 and got[7] == 70 and got[8] == 0


def test_very_long_text_and_empty_tables(spark):
    rng = random.Random(3)
    words = [f"v{k}" for k in range(500)]
    text = " ".join(rng.choice(words) for _ in range(300_000))
    docs = [(1, text), (2, text[1_000_001:1_000_901]), (3, "unlike")]
    assert plain(S.remove_passages(spark.createDataFrame(docs, DDL))) == brute(docs, 35)
    assert S.digest(spark.createDataFrame([], DDL)).count() == 0
    assert plain(S.remove_passages(spark.createDataFrame([(None, None)], DDL))) == [(None, 0, 0, "")]


def test_contexts_in_pieces_are_those_of_the_whole(monkeypatch):
    words, *_ = K.words([" ".join(str(random.Random(4).randrange(20)) for _ in range(50)).encode() + b" " + b"x y z " * 90], K.NOT_SPACE, K.UNCHANGED)
    bounds = np.array([0, len(words)])

    def windows(found):
        return sorted((start + k, anchor) for _, start, m, anchor, _, _ in zip(*found, strict=True) for k in range(m))

    whole = windows(S.contexts(words, bounds, 7, 3))
    assert [s for s, _ in whole] == list(range(len(words) - 6))
    monkeypatch.setattr(S, "PIECE", 64)
    assert windows(S.contexts(words, bounds, 7, 3)) == whole


def test_deep_nodes_are_the_repeated_prefixes():
    rng = random.Random(5)
    words = np.array([rng.randrange(3) for _ in range(300)])
    starts = np.arange(294)
    node = S.deep_nodes(words, starts, 6)
    key = [tuple(words[i : i + 6]) for i in starts]
    count = Counter(key)
    assert [n >= 0 for n in node] == [count[k] > 1 for k in key]
    assert len({(n, k) for n, k in zip(node, key, strict=True) if n >= 0}) == len({n for n in node if n >= 0}) == sum(c > 1 for c in count.values())
