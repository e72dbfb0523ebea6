import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutplan.llm import spelling as S

DDL = "doc_id long, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def counted(docs, min_chars=7, min_count=2):
    count = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= min_chars:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= min_count}


def brute(count, ratio=10):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        if best is not None and count[best] >= ratio * count[w]:
            form[w] = best
    out = []
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, count[w], len(near[w]), count[form[w]] if w in form else None))
    return sorted(out, key=str)


def plain(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


def mutated(rng, word, letters):
    k = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:k] + rng.choice(letters) + word[k:]
    return word[:k] + (rng.choice(letters) if kind == 1 else "") + word[k + 1 :]


def corpus(seed, n=150, letters="abÉéÿ"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(25)]
    words = base * 12 + [mutated(rng, w, letters) for w in base for _ in range(10)]
    words += [mutated(rng, mutated(rng, w, letters), letters) for w in base for _ in range(6)]
    docs = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "1 2 Ā ×÷"), (None, " ".join(base)), (3, " ".join(base)), (3, " ".join(base))]
    return docs


@pytest.mark.parametrize("max_words", [10_000, 40, 4])
def test_equals_brute_force_with_groups_split_in_any_number_of_rounds(spark, max_words):
    docs = corpus(max_words)
    frame = spark.createDataFrame(docs, DDL).withColumns({"n": F.lit("x"), "word": F.lit(1), "run": F.lit(2)})
    assert plain(S.variants(frame, max_words=max_words, shard_rows=300)) == brute(counted(docs))


def test_chains_of_forms_end_in_one_root(spark):
    sizes = (30_000, 2_500, 220, 20, 2)
    for first in "abcdefgh":
        chain = {first + "bcdefghijk"[: 6 + k]: n for k, n in enumerate(sizes)}
        docs = [(None, " ".join([w] * n)) for w, n in chain.items()]
        if counted(docs) == chain:
            break
    got = plain(S.variants(spark.createDataFrame(docs, DDL)))
    assert got == brute(chain)
    assert {r[2] for r in got} == {first + "bcdefg"}


def test_ties_go_to_the_first_word_and_repeated_letters_are_one_edit(spark):
    docs = [(None, " ".join(["aaaaaaab"] * 30 + ["aaaaaaac"] * 30 + ["aaaaaaa"] * 3 + ["aaaaaaaa"] * 2 + ["baaaaaaa"] * 30))]
    got = plain(S.variants(spark.createDataFrame(docs, DDL)))
    assert got == brute(counted(docs))
    assert {r[0]: r[1] for r in got}["aaaaaaa"] == "aaaaaaab"


def test_very_long_words_and_empty_tables(spark):
    long = "ab" * 30_000
    docs = [(k, f"{long} {long[:-1]} {long}é {long[:100]}x{long[100:]} short") for k in range(12)]
    assert plain(S.variants(spark.createDataFrame(docs, DDL))) == brute(counted(docs))
    assert plain(S.digest(spark.createDataFrame([], DDL))) == []
    assert plain(S.digest(spark.createDataFrame([(None, None), (1, "")], DDL))) == []


def test_all_near_words_of_a_large_group_are_found_once(spark):
    rng = random.Random(5)
    words = {"stem" + "".join(rng.choice("abcdefgh") for _ in range(rng.choice((3, 4)))) for _ in range(1500)}
    frame = spark.createDataFrame([(w, rng.randrange(1, 99)) for w in words], "word string, n long")
    rows = S.groups(frame, 60, S.work_dir(spark, "test"))
    assert max(r["count"] for r in rows.where("r > 1").groupBy("key").count().collect()) <= 60
    got = {r.word: r.n_near for r in S.near_words(frame, max_words=60, shard_rows=500).collect()}
    want = {w: sum(one_edit(w, v) for v in words) for w in words}
    assert got == {w: n for w, n in want.items() if n}


def test_rows_of_the_matrix_against_plain_comparison():
    rng = random.Random(6)
    group = np.array([rng.randrange(3) for _ in range(400)])
    pairs = sorted({(int(g), "".join(rng.choice("ab") for _ in range(rng.randrange(7)))) for g in group})
    held = S.Sorted(np.array([g for g, _ in pairs]), [t for _, t in pairs])
    texts = [pairs[i] for i in held.order]
    limit = np.array([rng.choice([1, 2, S.ANY]) for _ in texts])
    got = set(zip(*(x.tolist() for x in S.near_pairs(held, np.arange(len(texts)), limit)), strict=True))

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    want = {
        (i, j)
        for i, (g, a) in enumerate(texts)
        for j, (h, b) in enumerate(texts)
        if g == h and one_edit(a, b) and common(a, b) < limit[i]
    }
    assert got == want


def test_normalized_texts_are_whole(spark):
    docs = [(None, "The separate seperate, " * 40), (None, "SEPERATE word\n"), (1, None), (2, "")]
    frame = spark.createDataFrame(docs, DDL).withColumn("_row", F.lit(1))
    found = spark.createDataFrame([("seperate", "separate", "separate", 2, 1, 30)], "word string, form string, root string, n long, n_near long, form_n long")
    got = sorted((str(r.doc_id), r.normalized) for r in S.normalized(frame, found).collect())
    assert got == sorted([("None", "The separate separate, " * 40), ("None", "separate word\n"), ("1", None), ("2", "")], key=lambda x: (x[0], str(x[1])))


def test_groups_hold_every_near_pair_once():
    """The rule of halves, by hand: prefix or suffix of half the shorter word, never both."""
    rng = random.Random(7)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(7, 12)))
        b = mutated(rng, a, "ab")
        if not one_edit(a, b) or min(len(a), len(b)) < 7:
            continue
        m = min(len(a), len(b))
        first = -(-m // 2)
        last = m - first
        found = defaultdict(int)
        found["p"] += a[:first] == b[:first]
        rest_a, rest_b = a[: len(a) - last], b[: len(b) - last]
        same = next((i for i, (x, y) in enumerate(zip(rest_a, rest_b, strict=False)) if x != y), min(len(rest_a), len(rest_b)))
        found["s"] += a[len(a) - last :] == b[len(b) - last :] and same < first
        assert sum(found.values()) == 1
