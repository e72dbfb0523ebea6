import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from cutplan.llm import language as L

WORDS = {
    "aa": ["komo", "tiras", "belun", "okano", "rimato"],
    "bb": ["schtrum", "eich", "ungert", "keitz", "bauch"],
    "cc": ["éloque", "ainçon", "tréau", "quelou", "ménti"],
}


def corpus(n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        name = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[name]) for _ in range(rng.randrange(4, 40))), name))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !? 34", "bb"), (1003, "KEITZ BAUCH EICH", None), (1004, "é", None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("letters", F.lit(1))
    got = {r.doc_id: r for r in L.digest(docs).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(i, name) for i, _, name in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].lang_pred == name for i, name in held) >= 0.98 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "bb" and got[1004].lang_pred in WORDS
    assert all(0 <= r.score <= 1 for r in got.values())


def test_filter_returns_every_language_that_holds_a_gram(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = L.learn(docs, bits=1 << 20)
    hashed, _ = L.grams(["komo tiras".encode()], model.n)
    aa = 1 << model.languages.index("aa")
    assert all(int(m) & aa for m in model.masks(hashed)[:3])
    assert (model.false_rate < 0.01).all()


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.digest(docs).first().lang_pred == "und"
    assert L.digest(docs.limit(0)).count() == 0


def test_more_than_64_languages(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(6)] for k in range(140)}
    rows = [(i, " ".join(rng.choice(words[name]) for _ in range(12)), name) for i, name in enumerate(sorted(words) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(docs)
    assert model.languages == sorted(words) and model.rows.shape[1] == 3
    got = {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()}
    held = [(i, name) for i, _, name in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == name for i, name in held) >= 0.98 * len(held)


def plain_grams(text):
    low = "".join(c.lower() if c.isascii() or ("À" <= c <= "Þ" and c != "×") else c for c in text or "")
    data = b" " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low.encode()) + b" "
    return [data[i : i + 4] for i in range(len(data) - 3) if b"  " not in data[i : i + 4]]


def plain(rows):
    """{doc_id: (language, score)} by counters and sets, no filter."""
    counts = {}
    for i, text, name in rows:
        if name is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(name, Counter()).update(plain_grams(text))
    names = sorted(counts)
    share = {n: {g: c / counts[n].total() for g, c in counts[n].items()} for n in names}
    rest = lambda n, g: sum(share[m].get(g, 0.0) for m in names if m != n) / max(1, len(names) - 1)
    telling = {n: {g for g in share[n] if share[n][g] > rest(n, g)} for n in names}
    own = {n: sum(share[n][g] for g in telling[n]) for n in names}
    out = {}
    for i, text, _ in rows:
        found = plain_grams(text)
        weighed = [sum(g in telling[n] for g in found) / max(1, len(found)) / own[n] for n in names]
        if any(c.isalpha() for c in text or "") and sum(weighed):
            out[i] = names[weighed.index(max(weighed))], max(weighed) / sum(weighed)
    return out


def test_equals_plain_counts_without_a_filter(spark):
    rows = corpus() + [(500, "KOMO Éloque ÄINÇON keitz", None), (501, "komo 7 schtrum, schtrum", None), (502, "Komo tiras " * 120_000, None)]
    got = {r.doc_id: r for r in L.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = plain(rows)
    assert len(want) == len(rows)
    for i, (name, score) in want.items():
        assert got[i].lang_pred == name and abs(got[i].score - score) < 1e-3


def test_ties_repeated_rows_and_null_ids(spark):
    learned = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:90]
    rows = [(i, " ".join(WORDS["aa" if k % 3 < 2 else "cc"]), ["ab", "aa", "cc"][k % 3]) for k, i in enumerate(learned)]
    rows += [(900, "komo tiras", None)] * 2 + [(None, "belun okano", None)]
    got = L.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    tied = [r for r in got if r.doc_id in (900, None)]
    assert len(got) == len(rows) and len(tied) == 3
    assert all(r.lang_pred == "aa" and abs(r.score - 0.5) < 1e-6 for r in tied)
