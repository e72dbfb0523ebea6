"""The frame store against the same operators on plain frames, and its plans."""

import random

import pytest
from pyspark.sql import functions as F

from cutplan.operators import scoring, segments
from cutplan.plans import runs as R
from cutplan.sources import store

SCHEMA = "video_id long, frame_idx long, state int, gray array<double>"


def videos(seed, lengths):
    rng, rows = random.Random(seed), []
    for v, n in enumerate(lengths):
        state = 1
        for i in range(n):
            state = rng.choice([0, 1, 2, 4]) if rng.random() < 0.15 else state
            rows.append((v, i, state, [float(rng.randrange(12)), float(rng.randrange(12))]))
    return rows


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def naive(rows, motion):
    """Pauses by a loop over each video: (video, number, first, last, boundary difference, active frames)."""
    found, by_video = [], {}
    for v, i, state, gray in rows:
        by_video.setdefault(v, []).append((state, gray))
    far = lambda a, b: sum(abs(x - y) for x, y in zip(a, b)) / len(a)
    for v, f in by_video.items():
        i, number = 0, 0
        while i < len(f):
            if f[i][0] != 1:
                i += 1
                continue
            j = i
            while j + 1 < len(f) and f[j + 1][0] == 1:
                j += 1
            moved = [k > i and far(f[k][1], f[k - 1][1]) > motion for k in range(i, j + 1)]
            active = sum(m or (k + 1 < len(moved) and moved[k + 1]) for k, m in enumerate(moved))
            found.append((v, number, i, j, far(f[max(0, i - 1)][1], f[min(len(f) - 1, j + 1)][1]), active))
            i, number = j + 1, number + 1
    return sorted(found)


@pytest.mark.parametrize("block, buckets", [(1, 3), (2, 1), (7, 4), (64, 5), (100_000, 2)])
def test_store_equals_plain_frames(spark, tmp_path, block, buckets):
    rows = videos(block, [1, 2, 6, 7, 8, 63, 64, 65, 200])
    frames = spark.createDataFrame(rows, SCHEMA)
    kept = store.write_store(frames.withColumn("note", F.lit("x")), str(tmp_path / "s"), block, buckets)
    assert rows_of(kept.frames.drop("note")) == rows_of(frames)
    with_diff = scoring.frame_diff(frames)
    assert rows_of(kept.frame_diff().drop("note")) == rows_of(with_diff)
    assert rows_of(kept.state_runs()) == rows_of(segments.state_runs(frames))
    assert rows_of(kept.frame_runs(4.0)) == rows_of(R.frame_runs(with_diff, 4.0, block=1000))
    report = R.pause_report(R.placed_runs(kept.frame_runs(4.0)))
    got = sorted((r.video_id, r.pause_id, r.start_frame, r.end_frame, r.boundary_diff, r.n_active) for r in report.collect())
    assert got == [pytest.approx(x) for x in naive(rows, 4.0)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[1:]


def test_no_frame_is_exchanged(spark, tmp_path):
    frames = spark.createDataFrame(videos(5, [90, 300]), SCHEMA)
    store.write_store(frames, str(tmp_path / "s"), 50, 4)
    kept = store.open_store(spark.newSession(), str(tmp_path / "s"))
    assert (kept.block, kept.buckets) == (50, 4)
    assert exchanges(kept.frame_diff()) == []
    # what is left is one exchange of runs by their video
    for made in (kept.state_runs(), kept.frame_runs(4.0), R.placed_runs(kept.frame_runs(4.0))):
        assert [x.split("#")[0] for x in exchanges(made)] == ["(video_id"]
    assert len(exchanges(R.frame_runs(scoring.frame_diff(frames), 4.0, 50))) > 1
    # a store is read by the columns that are asked for
    scan = kept.state_runs()._jdf.queryExecution().executedPlan().toString()
    assert "gray" not in scan.split("ReadSchema")[1]


def test_one_long_video_is_spread_over_buckets(spark, tmp_path):
    n, block = 200_000, 1000
    frames = spark.range(n).select(F.lit(3).cast("long").alias("video_id"), F.col("id").alias("frame_idx"), F.lit(1).alias("state"), F.array((F.col("id") % 7).cast("double")).alias("gray"))
    kept = store.write_store(frames, str(tmp_path / "s"), block, 8)
    sizes = kept.dealt.groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < n / 3
    assert kept.dealt.groupBy("video_id", "_block").count().agg(F.max("count")).first()[0] == block + 2
    assert [tuple(r) for r in kept.state_runs().collect()] == [(3, 1, 0, n - 1)]


def test_unfinished_empty_and_refused(spark, tmp_path):
    frames = spark.createDataFrame([], SCHEMA)
    kept = store.write_store(frames, str(tmp_path / "none"), 10, 2)
    assert kept.frames.count() == 0 and kept.frame_runs(1.0).count() == 0 and kept.frame_diff().columns[-1] == "diff"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.open_store(spark, str(tmp_path / "nothing"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.write_store(frames, str(tmp_path / "none"), 10, 2)
    with pytest.raises(ValueError):
        store.write_store(frames.withColumn("_Own", F.lit(1)), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        store.write_store(frames, str(tmp_path / "y"), 0)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("frames_")]


def test_nulls_and_repeats_are_kept(spark, tmp_path):
    rows = [(1, 0, 1, [1.0]), (1, 0, 1, [1.0]), (None, 0, None, None), (2, 1, None, None), (2, 0, 1, [])]
    frames = spark.createDataFrame(rows, SCHEMA)
    kept = store.write_store(frames, str(tmp_path / "s"), 1, 3)
    assert rows_of(kept.frames) == rows_of(frames)
    assert kept.frame_diff().where("diff = 0").count() == 5
