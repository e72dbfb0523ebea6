import random
import re

from cutplan.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    ws, hit, names = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        n = min(len(iw), window)
        for j in range(len(iw) - n + 1) if n else ():
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[j : j + n]:
                    hit |= set(range(i, i + n))
                    names.add(item)
    return len(ws), len(hit), sorted(str(x) for x in names if x is not None)


def corpus(seed, n_docs, vocabulary, size):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(rng.choice([0, 1, 2, 5, 12, 30]) if i % 3 == 0 else rng.randrange(10, 40))) for i in range(12)]
    items += [(100, items[4][1]), (None, text(15)), (101, None)]
    docs = []
    for i in range(n_docs):
        parts = [text(rng.randrange(size))]
        for _ in range(rng.randrange(3)):
            ws = rng.choice(items)[1] or ""
            ws = ws.split()
            a = rng.randrange(len(ws) + 1)
            parts += [" ".join(ws[a : a + rng.randrange(25)]), text(rng.randrange(5))]
        docs.append((i, "  ".join(parts)))
    return docs + [(n_docs, None), (n_docs + 1, ""), (n_docs + 2, "ß É " * 3)], items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def check(spark, docs, items, **more):
    d, b = frames(spark, docs, items)
    for r in D.contamination(d, b, **more).collect():
        want = brute(docs[r.doc_id][1], items)
        assert (r.contamination.n_words, r.contamination.n_hit, sorted(r.contamination["items"])) == want, docs[r.doc_id]


def test_large_and_small_vocabulary(spark):
    check(spark, *corpus(1, 60, [f"W{i}" for i in range(300)], 40))
    check(spark, *corpus(2, 60, ["a", "B", "c"], 40))


def test_no_short_items(spark):
    docs, items = corpus(3, 60, ["x", "y", "z"], 60)
    check(spark, docs, [(i, t) for i, t in items if len(words(t)) >= 10])


def test_several_blocks_of_items(spark):
    docs, items = corpus(4, 40, [f"w{i}" for i in range(40)], 40)
    check(spark, docs, items, max_words=20)


def test_removal_empty_tables_and_clashing_columns(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    docs = [(0, f"Clean start é {passage}, clean end of a longer text with many more words in it here"), (1, passage), (2, None)]
    d, b = frames(spark, docs, [(1, passage)])
    clash = d.selectExpr("doc_id", "text", "1 AS contamination", "2 AS item_id")
    kept = {r.doc_id: r for r in D.remove_spans(D.contamination(clash, b)).collect()}
    assert kept[0].text == "Clean start é , clean end of a longer text with many more words in it here"
    assert 1 not in kept and kept[2].text is None and kept[0].item_id == 2
    assert D.digest(d, b.limit(0)).where("contaminated").count() == 0
    assert D.digest(d.limit(0), b).count() == 0


def test_removal_leaves_short_items(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    items = [(1, "Yes"), (2, "new york"), (3, " ".join(f"n{i}" for i in range(9))), (4, passage), (5, "yes " + " ".join(f"r{i}" for i in range(9)))]
    nine, ten = items[2][1], items[4][1]
    docs = [
        "yes, we went to New York and said yes", "New York, yes, new york yes yes.", "yes yes no", "yes " * 12 + "no", nine + " and more",
        f"({passage} yes) " + "w " * 30, ten + " " + passage + " k" * 30, "", passage + " yes " * 20 + "no", '"' + ten + '" ' + "z " * 20,
    ]
    want = {0: docs[0], 2: docs[2], 3: docs[3], 4: docs[4], 5: "( yes) " + "w " * 30, 6: " k" * 30, 7: "", 8: " yes " * 20 + "no", 9: '"" ' + "z " * 20}
    d, b = frames(spark, list(enumerate(docs)), items)
    for more in ({}, {"max_words": 5}):
        got = {r.doc_id: r.text for r in D.remove_spans(D.contamination(d, b, **more)).collect()}
        assert got == want


def test_blocks_of_items_clashing_names_and_repeated_rows(spark):
    words = [f"w{i}" for i in range(400)]
    items = [(f"i{k}", " ".join(words[20 * k : 20 * k + 15])) for k in range(12)]
    text = "x " + " ".join(words[0:15]) + " y " + " ".join(words[40:58]) + " z"
    docs = spark.createDataFrame([(1, text, 7, 8), (1, text, 7, 8), (2, None, 0, 0), (3, "clean text", 0, 0)], "doc_id long, text string, _hit_0 int, row int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole, cut = D.contamination(docs, bench), D.contamination(docs, bench, max_words=20)
    key = lambda r: (r.doc_id, r._hit_0, r.row, r.contamination.n_words, r.contamination.n_hit, r["contamination"]["items"], str(r.contamination.spans))
    assert sorted(map(key, whole.collect())) == sorted(map(key, cut.collect()))
    assert whole.columns == cut.columns and cut.where("doc_id = 1").first().contamination.n_hit == 30


def test_spans_are_cut_beside_columns_of_any_name(spark):
    passage = " ".join(f"b{k}" for k in range(14))
    docs = spark.createDataFrame([(1, f"{'clean words here ' * 12}{passage} and an end", "x", "y")], "doc_id long, text string, _cut string, _cut1 string")
    bench = spark.createDataFrame([("i", passage)], "item_id string, text string")
    got = D.remove_spans(D.contamination(docs, bench))
    row = got.first()
    assert (row["_cut"], row["_cut1"]) == ("x", "y") and "b3" not in row.text and row.text.endswith("and an end")
