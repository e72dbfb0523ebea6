import hashlib
import random
from collections import Counter

import pytest

from cutplan.llm import substring_dedup as S


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), kept))
    return out


def corpus(seed, alphabet):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [text(rng.randrange(10, 120)) for _ in range(6)]
    docs = [None, "", "ab" * 60, "aaaa" * 30, text(15)]
    for _ in range(80):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a:] if rng.random() < 0.5 else p, text(rng.randrange(20))]
        docs.append("".join(parts))
    return docs + docs[10:14] + [docs[12]] * 3


def check(spark, texts, ids=None, **more):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()
    want = [(i, *w) for (i, _), w in zip(rows, brute(texts, more["length"]), strict=True)]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz  ", "ab", "aéß€ "])
def test_shards_equal_brute_force(spark, alphabet):
    check(spark, corpus(len(alphabet), alphabet), length=20, gram=8, shard_bytes=700)


def test_frequent_anchors_equal_brute_force(spark):
    check(spark, corpus(9, "abcdef"), length=20, gram=6, max_contexts=2)


def test_parts_hold_every_string_once_and_equal_strings_go_one_way():
    rng = random.Random(5)
    for _ in range(300):
        length = rng.randrange(2, 40)
        width = rng.randrange(1, length + 1)
        m = rng.randrange(1, length - width + 2)
        core = rng.randrange(m - 1, length - width + 1)
        todo, seen = [(0, m, core, width)], Counter()
        rounds = 0
        while any(w < length for *_, w in todo):
            rounds += 1
            done = [p for p in todo if p[3] == length]
            for first, k, c, w in (p for p in todo if p[3] < length):
                for f, n, at, wide in S.halves(k, c, w, length):
                    assert all(i <= at and at + wide <= i + length for i in range(n))
                    done.append((first + f, n, at, wide))
            todo = done
        for first, k, c, w in todo:
            assert (k, c, w) == (1, 0, length)
            seen[first] += 1
        assert seen == Counter(range(m)) and rounds <= length.bit_length()


def test_one_anchor_in_many_different_contexts(spark):
    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common = text(14)
    longer = [text(3) + common + text(3) for _ in range(4)]
    texts = [text(20) + common + text(20) for _ in range(60)] + [text(15) + rng.choice(longer) + text(15) for _ in range(40)]
    check(spark, texts + texts[:5], length=20, gram=8, max_contexts=1)
    check(spark, texts + texts[:5], length=20, gram=8, max_contexts=10, shard_bytes=300)


def test_repeated_ids(spark):
    texts = corpus(11, "abcdefghij ")
    check(spark, texts, ids=[i // 3 for i in range(len(texts))], length=20, gram=8)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 64)
    texts = [t.encode() for t in corpus(12, "abcdefg ")[5:]]
    one, count = b"".join(texts), Counter()
    for _, s, m, _, body in S.contexts([one], 20, 8):
        assert body == one[s : s + m + 19]
        count.update(range(s, s + m))
    assert count == Counter(range(len(one) - 19))


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, d int, tag string")
    assert S.digest(docs).count() == 0


def test_very_frequent_contexts_are_dealt_over_keys(spark):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common = text(150)
    texts = [common] * 90 + [text(12) + common + text(12) for _ in range(60)] + [text(40) for _ in range(20)]
    check(spark, texts, length=20, gram=8)
    check(spark, texts, length=20, gram=8, max_contexts=2)


def test_null_and_repeated_ids_with_equal_texts(spark):
    rng = random.Random(14)
    one, two = ("".join(rng.choice("abcdefghij ") for _ in range(60)) for _ in range(2))
    rows = [(None, one), (None, one), (None, two), (1, two + one), (1, None), (1, "short")]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=20, gram=8).collect()
    want = [(-1 if i is None else i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 20), strict=True)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)


def test_query_goes_by_400_bytes_not_by_words(spark):
    rng = random.Random(16)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    passage = lambda n: " ".join(text(6, "stuvw") for _ in range(60))[:n]
    shared = [passage(399), passage(400), "é" * 199 + "x", "ü" * 200]
    assert all(len(p.split()) > 50 for p in shared[:2]) and [len(p.encode()) for p in shared] == [399, 400, 399, 400]
    texts = [text(300, letters) + p + text(300, letters) for p in shared for letters in ("abc", "def")]
    got = S.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in enumerate(brute(texts, 400))]
    assert sorted(map(tuple, got)) == want
    assert [w[2] for w in want] == [0, 0, 400, 400, 0, 0, 400, 400]
