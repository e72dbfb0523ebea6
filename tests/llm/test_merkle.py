import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from cutplan.llm import merkle as M

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, t, lang, s, n):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, t)))


def climb(nodes):
    """All levels, and for each leaf the (left, right) siblings at every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
            at[k] = i // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(docs):
    by_source = defaultdict(list)
    for row in docs:
        by_source[row[3]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, own, (d, t, lang, _, n)), path in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            x = own
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and t is not None:
                x = leaf(d, t.replace("\n", ""), lang, s, n)
            for left, right in path + top:
                x = H(left, x, right)
            proof = H(*(a + b for a, b in path + top))
            out.append((d, own, trees[s][0], root, proof, x, x == root))
    return sorted(out, key=str)


def rows(docs, spark):
    frame = spark.createDataFrame(docs, DDL)
    got = M.digest(frame)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(n, sources=5, seed=1):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + [f"s{k} é" for k in range(sources)])
        docs.append((i, rng.choice(["line\nline", "one", "", "é\n\n"]) * rng.randrange(4), rng.choice(["de", None]), source, rng.randrange(99)))
    rng.shuffle(docs)
    return docs


def test_equals_brute_force_over_several_stored_levels(spark):
    docs = corpus(700)
    assert rows(docs, spark) == brute(docs)


def test_nulls_repeated_rows_long_texts_and_lone_leaves(spark):
    docs = corpus(40, sources=30, seed=2)
    docs += [(None, "a\nb", None, None, None), (None, None, "x", None, 3), (7, None, None, "hot", None), (9, "w\n" * 200_000, "é", "S", 1)]
    docs += [(5, "same", "x", "hot", 1)] * 4 + [(5, "other", "x", "hot", 1), (6, "only row", "x", "\U0001f600", 1), (8, "x", "x", "", 1)]
    assert rows(docs, spark) == brute(docs)


def test_one_row_and_empty_table(spark):
    one = [(4, "a", "b", "c", 1)]
    assert rows(one, spark) == brute(one)
    made = M.manifest(spark.createDataFrame([], DDL))
    assert made.root is None and made.proofs().count() == 0
    assert rows([], spark) == []


def test_any_stride_gives_the_same_proofs_and_levels_are_stored_by_stride(spark):
    docs = corpus(300, seed=3)
    frame = spark.createDataFrame(docs, DDL)
    found = []
    for stride in (1, 3, 9):
        made = M.manifest(frame, stride=stride)
        most = max(sum(d[3] == s for d in docs) for s in {d[3] for d in docs})
        assert len(made.rows.stored) == 1 + -(-M.height(most) // stride)
        found.append(sorted((r.doc_id, r.leaf, r.root, str(r.path)) for r in made.proofs().collect()))
    assert found[0] == found[1] == found[2]


def test_verify_finds_changed_rows_and_ignores_extra_columns(spark):
    docs = corpus(60, seed=4)
    extra = spark.createDataFrame(docs, DDL).withColumns({"g": F.lit(1), "pos": F.lit("x"), "digest": F.lit(2), "leaf": F.lit(3)})
    proofs = M.manifest(extra).proofs()
    changed = extra.withColumn("lang", F.when(F.col("doc_id") == 3, "changed").otherwise(F.col("lang"))).withColumn("root", F.lit(1))
    got = {r.doc_id: r.verified for r in M.verify(changed, proofs).collect()}
    assert got == {d[0]: d[0] != 3 for d in docs}
    moved = proofs.withColumn("path", F.reverse("path"))
    assert not any(r.verified for r in M.verify(extra, moved).where("doc_id < 20").collect() if r.doc_id != -1)
