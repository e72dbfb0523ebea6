"""Random videos against naive loops written from the rules, and batch against stream."""

import random

from pyspark.sql import functions as F

from cutplan.operators import deletes, mask, outputs, segments
from cutplan.streaming.files import boundaries_of_table


def videos(seed, count, longest=90):
    rng = random.Random(seed)
    out = {}
    for v in range(count):
        states = []
        while len(states) < rng.randrange(1, longest):
            states += [rng.randrange(5)] * rng.randrange(1, 20)
        out[v] = [(s, float(rng.choice([0, 0, 0, 0, 1, 3, 9])), float(rng.randrange(6))) for s in states]
    return out


def table(spark, data):
    rows = [(v, i, s, d, [g]) for v, fs in data.items() for i, (s, d, g) in enumerate(fs)]
    return spark.createDataFrame(rows, "video_id long, frame_idx long, state int, diff float, gray array<double>").repartition(4)


def runs_of(values):
    out = []
    for i, x in enumerate(values):
        if out and out[-1][0] == x:
            out[-1][2] = i
        else:
            out.append([x, i, i])
    return [tuple(r) for r in out]


def naive_mask(diffs, sf, limit):
    n = len(diffs)
    active = [False] * n
    for k in range(1, n):
        if diffs[k] > limit:
            active[k] = active[k - 1] = True
    gone = [0] * n
    if not any(active):
        for k in range(sf, n - sf):
            gone[k] = int(n > 2 * sf)
        return gone
    for on, a, b in runs_of(active):
        if on or b - a + 1 <= sf:
            continue
        front = 0 if a == 0 else sf if b == n - 1 else sf // 2
        back = sf if a == 0 else 0 if b == n - 1 else sf - sf // 2
        for k in range(a + front, b - back + 1):
            gone[k] = 1
    return gone


def test_runs_masks_decimation_and_ranges(spark):
    data, sf = videos(1, 60), 3
    f = table(spark, data)
    for block in (4, 100_000):
        got = {}
        for r in segments.state_runs(f, block).collect():
            got.setdefault(r.video_id, []).append((r.state, r.start_frame, r.end_frame))
        for v, fs in data.items():
            assert sorted(got[v], key=lambda r: r[1]) == runs_of([s for s, *_ in fs])
    masks = {(r.video_id, r.frame_idx): r.m for r in mask.pause_mask(mask.pause_activity(f, 2.0), F.lit(sf)).collect()}
    want_masks, gone = {}, {}
    for v, fs in data.items():
        gone[v] = [False] * len(fs)
        for s, a, b in runs_of([s for s, *_ in fs]):
            if s == 1:
                for k, m in enumerate(naive_mask([d for _, d, _ in fs[a : b + 1]], sf, 2.0)):
                    want_masks[v, a + k] = m
                    gone[v][a + k] = bool(m)
    assert masks == want_masks
    base = f.join(spark.createDataFrame([(v, i, x) for v, xs in gone.items() for i, x in enumerate(xs)], "video_id long, frame_idx long, deleted boolean"), ["video_id", "frame_idx"])
    done = deletes.delete_mask(base.select("video_id", "frame_idx", "state", "deleted"), factor_02=3)
    for v, fs in data.items():
        keys = [(s, x) for (s, *_), x in zip(fs, gone[v], strict=True)]
        for (s, x), a, b in runs_of(keys):
            factor = {2: 2, 4: 3}.get(s)
            if factor and not x:
                for k in range(a, b + 1):
                    gone[v][k] = (k - a) % factor != 0
    got = {(r.video_id, r.frame_idx): r.deleted for r in done.collect()}
    assert got == {(v, i): x for v, xs in gone.items() for i, x in enumerate(xs)}
    ranges = outputs.kept_ranges(done).collect()
    kept = sorted((r.video_id, i) for r in ranges for i in range(r.start_frame, r.end_excl))
    assert kept == sorted(k for k, x in got.items() if not x)
    onward = {(r.video_id, r.frame_idx): r.next_frame for r in outputs.next_kept(done).collect()}
    for (v, i), to in onward.items():
        assert to == next((j for j in range(i, len(gone[v])) if not gone[v][j]), len(gone[v]))


def test_islands_in_blocks_equal_plain_ones(spark):
    f = table(spark, videos(4, 20)).select("video_id", "frame_idx", "state")
    plain = segments.islands(f, ["video_id"], "frame_idx", ["state"])
    split = segments.islands(f, ["video_id"], "frame_idx", ["state"], block=5)
    assert split.columns == plain.columns
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


def test_pauses_and_clips_cover_each_video(spark):
    data = videos(2, 40)
    f = table(spark, data)
    runs, lengths = segments.state_runs(f), segments.totals(f)
    pauses = segments.pause_segments(runs)
    parts = pauses.select("video_id", "start_frame", "end_frame").union(segments.clip_segments(pauses, lengths).select("video_id", "start_frame", "end_frame"))
    seen = sorted((r.video_id, i) for r in parts.collect() for i in range(r.start_frame, r.end_frame + 1))
    assert seen == sorted((v, i) for v, fs in data.items() for i in range(len(fs)))


def test_stream_equals_batch(spark):
    f = table(spark, videos(3, 25))
    lengths = segments.totals(f)
    want = segments.boundary_diff(segments.pause_segments(segments.state_runs(f)), f, lengths)
    got = boundaries_of_table(f, batches=4)
    key = lambda rows, d: sorted((r.video_id, r.start_frame, r.end_frame, r.before_index, r.after_index, r[d]) for r in rows.collect())
    assert key(got, "diff") == key(want, "boundary_diff")
