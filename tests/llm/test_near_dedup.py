import random
import re

from cutplan.llm import near_dedup as N


def shingles(text, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def brute(docs, n, percent):
    sets = [(d, shingles(t, n)) for d, t in docs]
    label = {i: i for i in range(len(docs))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


def chains(seed, groups=12, size=25):
    """Copies that drift apart, so links form chains and stars don't settle every bucket."""
    rng, docs = random.Random(seed), []
    for _ in range(groups):
        ws = [f"w{rng.randrange(500)}" for _ in range(rng.choice([2, 9, 60, 120]))]
        for _ in range(size):
            docs.append(" ".join(ws))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                ws[rng.randrange(len(ws))] = f"w{rng.randrange(500)}"
    docs += ["", None, " \t ", "A b", "a  B", "one"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_components_equal_brute_force(spark):
    docs = chains(1)
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=3, threshold=0.85, rows=6, block=8)
    rows = got.collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute(docs, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_five_words_repeated_ids_and_extra_columns(spark):
    docs = chains(2, groups=4)
    docs += [(docs[0][0], docs[0][1]), (docs[1][0], "another text with this id that is quite its own")]
    rows = [(d, t, 1, "x") for d, t in docs]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, bucket int, label string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(docs, 5, 80)


def null_ids():
    """One component whose least class has null ids only, one without any id, one without near copies."""
    rng = random.Random(7)
    a, b, c = ([f"{x}{rng.randrange(500)}" for _ in range(120)] for x in "abc")
    near = lambda ws, k: " ".join([*ws[:k], "changed", *ws[k + 1 :]])
    docs = [(None, " ".join(a)), (None, " ".join(a)), (5, near(a, 0)), (3, near(a, 119)), (4, near(a, 60))]
    docs += [(None, " ".join(b))] * 3 + [(None, near(b, 0))]
    docs += [(7, " ".join(c)), (7, near(a, 30)), (7, near(c, 0)), (7, " ".join(c)), (None, None), (None, "")]
    return docs


def test_one_row_is_kept_of_each_component_with_null_and_repeated_ids(spark):
    docs = null_ids()
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    kept = [(r.doc_id, r.component_id, r.n_shingles > 0) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted([(3, 3, True), (7, 7, True), (None, None, True), (None, None, False), (None, None, False)], key=str)
    assert sum(r.component_id == 3 for r in got) == 6 and sum(r.component_id == 7 for r in got) == 3


def test_null_ids_in_unsettled_buckets(spark):
    docs = [(d if d % 3 else None, t) for d, t in chains(4, groups=6)]
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=3, threshold=0.85, rows=6, block=8).collect()
    want = brute([(d if d is not None else 10**6 + i, t) for i, (d, t) in enumerate(docs)], 3, 85)
    assert sum(r.kept for r in got) == len({root for _, _, root in want if root is not None})
    assert sorted(r.component_id for r in got if r.component_id is not None) == sorted(root for _, _, root in want if root < 10**6)


def test_empty_table(spark):
    assert N.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_documents_with_clashing_columns_ties_and_a_long_text(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    docs = [(1, long), (2, long + " end"), (3, "one two three four five six"), (3, "one two three four five six"), (4, None)]
    names = ["_doc_id", "_text_id", "text_id", "kept", "n", "d", "t", "row"]
    frame = spark.createDataFrame([(*r, *["x"] * len(names)) for r in docs], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = N.kept_documents(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id, r["_doc_id"], r.row) for r in got.collect()) == [(1, "x", "x"), (3, "x", "x"), (4, "x", "x")]
