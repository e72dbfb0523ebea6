import random
import re
from collections import defaultdict

import pytest

from cutplan.llm import line_dedup as D


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(docs, min_chars, min_docs):
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    hot = {k: max(ids) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if hot.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    lines = ["line number %d é with text" % i for i in range(12)] + ["short", "", "  PADDED line of text É \t", "padded LINE of text É", "x" * 30]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(8)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, lines[0]), (n + 4, "\r\n".join(lines))]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_equals_brute_force_for_any_number_of_batches(spark, batches):
    docs = corpus(batches)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.dedup_lines(frame, min_chars=20, min_docs=5, batches=batches, fanout=2)
    assert sorted((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.line_dedup.kept) for r in got.collect()) == brute(docs, 20, 5)


def test_repeated_ids_count_once_and_extra_columns_stay(spark):
    same = "this line is long enough to be a key"
    docs = [(1, same), (1, same), (1, same + "\nother"), (2, same), (3, same)]
    frame = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, line_dedup int, pos string")
    assert D.dedup_lines(frame, min_chars=20, min_docs=4).where("line_dedup.n_dropped > 0").count() == 0
    got = D.dedup_lines(frame, min_chars=20, min_docs=3)
    assert got.columns == ["doc_id", "text", "line_dedup", "pos"]
    assert sorted((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.line_dedup.kept) for r in got.collect()) == brute(docs, 20, 3)


def test_null_ids_and_empty_table(spark):
    line = "this line is long enough to be a key"
    frame = spark.createDataFrame([(None, line), (1, line), (2, line)], "doc_id long, text string")
    got = {r.doc_id: r.line_dedup.n_dropped for r in D.dedup_lines(frame, min_chars=20, min_docs=3).collect()}
    assert got == {None: 1, 1: 1, 2: 0}
    assert D.digest(frame.limit(0)).count() == 0


def test_runs_share_no_hash_and_are_not_exchanged_again(spark, tmp_path):
    rows = [(d, 0, 0, h, h) for d in range(40) for h in range(d % 7, 60, 1 + d % 5)]
    lines = spark.createDataFrame(rows, "d long, tag long, pos int, h1 long, h2 long")
    runs = D.LineRuns(spark, f"file://{tmp_path}", fanout=2)
    for low in (30, 20, 10, 0):
        runs.add(lines.where(f"d >= {low} AND d < {low + 10}"))
    held = [r for level in runs.levels for r in level]
    owners = [(r.h1, r.owner) for run in held for r in run.collect()]
    assert len(runs.levels) > 1 and len(owners) == len({h for h, _ in owners})
    want = {h: max(d for d, *_, x, _ in rows if x == h) for h in {r[3] for r in rows}}
    assert dict(owners) == want
    plan = held[0].join(held[1].hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    runs.forget()


def test_a_failed_run_leaves_no_table_in_the_catalog(spark, monkeypatch):
    def fails(self, min_docs):
        raise RuntimeError("lost")

    monkeypatch.setattr(D.LineRuns, "frequent", fails)
    docs = spark.createDataFrame([(1, "a" * 50), (2, "a" * 50)], "doc_id long, text string")
    with pytest.raises(RuntimeError, match="lost"):
        D.dedup_lines(docs)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]
