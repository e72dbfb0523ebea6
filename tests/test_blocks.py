"""Work along a video in blocks: lookups in segments, decimation, numbers and sums by prefix scans."""

import random

from pyspark.sql import functions as F

from cutplan.operators import deletes, lookup, prefix
from cutplan.sources import frames as sources


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_meet_segments_over_block_edges(spark):
    rng = random.Random(1)
    segs, want, points = [], {}, []
    for v in range(3):
        at = rng.randrange(4)
        while at < 400:
            end = at + rng.choice([0, 1, 5, 9, 40, 130])
            segs.append((v, at, end, len(segs)))
            at = end + 1 + rng.choice([0, 0, 3, 50])
        for i in rng.sample(range(-5, 600), 300):
            points.append((v, i))
            want[v, i] = next((k for w, a, b, k in segs if w == v and a <= i <= b), None)
    points += points[:5]
    s = spark.createDataFrame([*segs, (0, 9_000, 8_999, -1)], "video_id long, start_frame long, end_frame long, k long")
    p = spark.createDataFrame(points, "video_id long, frame_idx long")
    for block in (1, 7, 64, 100_000):
        got = lookup.assigned(p, s, F.col("k"), block)
        rows = got.collect()
        assert len(rows) == len(points) and all(want[r.video_id, r.frame_idx] == r.info for r in rows), block
    text = plan(lookup.assigned(p, s, F.col("k"), 7))
    assert text.count("Exchange hashpartitioning") == 1 and "_block" in text.split("Window")[1][:300]


def test_decimation_of_one_long_video_has_no_task_above_a_block(spark):
    n, block, factor = 1_000_000, 50_000, 3
    state = F.when((F.col("id") >= 10) & (F.col("id") < 900_001), 4).otherwise(0)
    rows = spark.range(0, n, 1, 8).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_idx"), state.alias("state"), (F.col("id") == 500_000).alias("deleted"))
    done = deletes.speedup_deletes(rows, 4, F.lit(factor), F.lit(True), block=block)
    kept = F.when(F.col("frame_idx") < 500_000, (F.col("frame_idx") - 10) % factor == 0).otherwise((F.col("frame_idx") - 500_001) % factor == 0)
    want = (F.col("frame_idx") == 500_000) | (F.col("frame_idx").between(10, 900_000) & ~kept)
    assert done.where(F.col("deleted") != want).count() == 0 and done.count() == n
    windows = [w[:200] for w in plan(done).split("Window [")[1:] if "row_number" in w[:200] or "frame_idx" in w[:120]]
    assert windows and "_block" in plan(done)


def test_numbers_and_sums_of_one_key_of_a_million_rows(spark):
    n = 1_000_000
    rows = spark.range(0, n, 1, 8).select(F.lit(7).cast("long").alias("v"), ((F.col("id") * 7919) % n).alias("t"))
    more = spark.createDataFrame([(None, 5), (None, 3), (1, 2), (1, 2), (1, 9)], "v long, t long")
    both = rows.unionByName(more)
    placed = prefix.ranged(both, ["v"], ["t"], 50_000)
    assert max(r["count"] for r in placed.groupBy("_part").count().collect()) < 150_000
    got = sources.number_long_frames(both, "v", ["t"], 50_000)
    assert got.columns == ["v", "t", "video_id", "frame_idx"]
    assert got.where((F.col("v") == 7) & (F.col("t") != F.col("frame_idx"))).count() == 0
    assert sorted(((r.v, r.t, r.frame_idx) for r in got.where("v IS NULL OR v = 1").collect()), key=str) == sorted([(None, 3, 0), (None, 5, 1), (1, 2, 0), (1, 2, 1), (1, 9, 2)], key=str)
    sums = prefix.running_sum(both, ["v"], ["t"], F.col("t") % 3, "s", 50_000)
    t = F.col("t")
    assert sums.where((F.col("v") == 7) & (F.col("s") != (t + 1 - (t + 1) % 3) + F.when((t + 1) % 3 == 2, 1).otherwise(0))).count() == 0
    assert sums.count() == n + 5
    assert prefix.numbered(more.limit(0), ["v"], ["t"], "k").count() == 0


def test_numbers_do_not_depend_on_the_partitions(spark):
    rows = spark.createDataFrame([(i % 3, (i * 37) % 101, i) for i in range(101)], "v long, t long, i long")
    one = sorted(map(tuple, sources.number_frames(rows, "v", ["t"]).select("v", "t", "i", "frame_idx").collect()))
    for block in (5, 40, 1000):
        assert sorted(map(tuple, sources.number_long_frames(rows.repartition(5), "v", ["t"], block).select("v", "t", "i", "frame_idx").collect())) == one


def test_toggles_on_runs_equal_toggles_on_frames(spark):
    from cutplan.operators import edits

    rng = random.Random(3)
    masks, given, want = [], [], []
    for pause in range(12):
        m = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randrange(1, 40))] if pause else [0] * 50
        start = 100 * pause
        masks += [(1, pause, k, v) for k, v in enumerate(m)]
        for seq in range(rng.randrange(12)):
            f = start + rng.randrange(-3, len(m) + 3)
            given.append((1, f, seq))
            k = f - start
            if 0 <= k < len(m):
                old, new = m[k], 2 if m[k] in (0, 3) else 3
                lo = hi = k
                while lo and m[lo - 1] == old:
                    lo -= 1
                while hi + 1 < len(m) and m[hi + 1] == old:
                    hi += 1
                m[lo : hi + 1] = [new] * (hi + 1 - lo)
        want += [(1, pause, k, v) for k, v in enumerate(m)]
    pauses = [(1, p, 100 * p, 100 * p + sum(x[1] == p for x in masks) - 1, "auto") for p in range(12)]
    mask = spark.createDataFrame(masks, "video_id long, pause_id int, k int, m tinyint")
    frame = spark.createDataFrame(pauses, "video_id long, pause_id int, start_frame long, end_frame long, mode string")
    edit = spark.createDataFrame(given, "video_id long, frame_idx long, seq int")
    got = edits.apply_mask_edits(mask, frame, edit)
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, edits.apply_mask_edits(mask, frame.withColumn("mode", F.lit("all")), edit).collect())) == sorted(masks)


def test_a_pause_of_a_million_frames_with_a_thousand_edits(spark):
    from cutplan.operators import edits

    n = 1_000_000
    mask = spark.range(0, n, 1, 8).select(F.lit(1).alias("video_id"), F.lit(0).alias("pause_id"), F.col("id").cast("int").alias("k"), (F.col("id") / 1000).cast("int").alias("m"))
    mask = mask.withColumn("m", (F.col("m") % 2).cast("tinyint"))
    frame = spark.createDataFrame([(1, 0, 0, n - 1, "auto")], "video_id int, pause_id int, start_frame long, end_frame long, mode string")
    edit = spark.range(1000).select(F.lit(1).alias("video_id"), (F.col("id") * 1000 + 5).alias("frame_idx"), F.col("id").cast("int").alias("seq"))
    got = edits.apply_mask_edits(mask, frame, edit)
    # blocks of 0 become 2, those of 1 become 3; the first toggle of each block doesn't touch its neighbours
    assert {(r.m, r["count"]) for r in got.groupBy("m").count().collect()} == {(2, n // 2), (3, n // 2)}


def test_cut_plans_read_frames_once(spark):
    import __spark_entry__ as entry

    for name in ("cut_list", "delete_mask", "segments", "next_kept", "skip_ranges", "edit_summary"):
        text = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "events.parquet" not in text and "/placed-" in text, name
        assert text.count("Exchange hashpartitioning") <= 5, (name, text.count("Exchange hashpartitioning"))
