import random
from collections import defaultdict

import numpy as np

from cutplan.llm import packing as P


SIZES = (16, 32, 64)


def plain(lengths, capacities):
    """Best fit into the smallest lengths without any index: each piece looks at every open bin."""
    bins = []
    for size in lengths:
        fits = [(c - sum(b), i) for i, (c, b) in enumerate(bins) if c - sum(b) >= size]
        if fits:
            bins[min(fits, key=lambda x: x[0])[1]][1].append(size)
        else:
            bins.append((min(c for c in capacities if c >= size), [size]))
    return [(sum(b), min(c for c in capacities if c >= sum(b))) for _, b in bins]


def test_same_bins_as_a_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted((rng.randrange(1, 65) for _ in range(rng.randrange(1, 80))), reverse=True)
        way = P.best_fit(np.array(lengths), SIZES, lambda i, lengths=lengths: P.opened(lengths[i], SIZES))
        fill = defaultdict(int)
        for b, p, n in zip(way[0].tolist(), way[1].tolist(), lengths, strict=True):
            assert p == fill[b]
            fill[b] += n
        assert sorted(bins_of(way, lengths).values()) == sorted(plain(lengths, SIZES))


def least(lengths, attention, per_sequence):
    """The least cost of all ways to share the pieces out, each group in the smallest length that holds it."""

    def share(i, groups):
        if i == len(lengths):
            fits = [min((c for c in SIZES if c >= g), default=None) for g in groups]
            return sum(per_sequence + c * (1 + attention * c / SIZES[-1]) for c in fits)
        options = [share(i + 1, [*groups, lengths[i]])]
        for k, g in enumerate(groups):
            if g + lengths[i] <= SIZES[-1] and g not in groups[:k]:
                options.append(share(i + 1, [*groups[:k], g + lengths[i], *groups[k + 1 :]]))
        return min(options)

    return share(0, [])


def test_close_to_the_optimum_of_all_ways():
    rng = random.Random(8)
    ratios = []
    for k in range(60):
        lengths = sorted((rng.choice([rng.randrange(1, 65), rng.randrange(5, 25)]) for _ in range(rng.randrange(1, 8))), reverse=True)
        attention, per_sequence = [(0.1, 1.5), (0.5, 0.0), (0.0, 6.0)][k % 3]
        way = P.cheapest(np.array(lengths), SIZES, attention, per_sequence)
        got = sum(per_sequence + c * (1 + attention * c / SIZES[-1]) for _, c in bins_of(way, lengths).values())
        ratios.append(got / least(lengths, attention, per_sequence))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.25 and sum(ratios) / len(ratios) < 1.02
    assert sum(r < 1 + 1e-9 for r in ratios) > 45


def test_knapsack_equals_all_contents():
    rng = random.Random(9)
    for _ in range(40):
        left = np.array([0] + [rng.randrange(3) for _ in range(7)])
        worth = np.array([rng.random() * u for u in range(8)])
        best, contents = P.worthiest(left, worth, 12)
        every = {(): 0}
        for u in np.flatnonzero(left).tolist():
            every = {(*key, (u, k)): size + u * k for key, size in every.items() for k in range(left[u] + 1)}
        for s in range(13):
            want = max(sum(worth[u] * k for u, k in key) for key, size in every.items() if size <= s)
            inside = contents(s)
            assert abs(best[s] - want) < 1e-9 and abs(sum(worth[u] * k for u, k in inside.items()) - want) < 1e-9
            assert sum(u * k for u, k in inside.items()) <= s and all(k <= left[u] for u, k in inside.items())


def test_a_cost_of_each_sequence_makes_bins_longer():
    rng = random.Random(10)
    lengths = np.array(sorted((rng.randrange(1, 3000) for _ in range(400)), reverse=True))
    counts = []
    for per_sequence in (0.0, 160.0, 2000.0):
        way = P.cheapest(lengths, P.CAPACITIES, 0.1, per_sequence)
        counts.append(len(set(way[0].tolist())))
        smallest = P.best_fit(lengths, P.CAPACITIES, lambda i: P.opened(int(lengths[i]), P.CAPACITIES))
        cost = lambda w, own=per_sequence: sum(P.bin_cost(int(c), P.CAPACITIES, 0.1, own) for c in w[2][w[1] == 0])
        assert cost(way) <= cost(smallest) and (per_sequence == 0 or cost(way) < cost(smallest))
    assert counts[0] > counts[2]


def test_every_token_once_and_bins_within_capacity(spark):
    rng = random.Random(2)
    texts = [None, "", "x" * 50_000, "é" * 3000] + ["w" * rng.randrange(1, 9000) for _ in range(200)] + ["same"] * 50
    rows = [(i if i != 9 else None, t, 3) for i, t in enumerate(texts)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), shard_pieces=60).collect()
    spans, bins = defaultdict(list), defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r["first"], r.length))
        bins[r.bin_id].append((r.place, r.length, r.capacity))
    for (i, t, _) in rows:
        at = 0
        for first, n in sorted(spans[i]):
            assert first == at
            at += n
        assert at == len((t or "").encode()) + 1
    for content in bins.values():
        at = 0
        for place, n, _ in sorted(content):
            assert place == at
            at += n
        capacity = content[0][2]
        assert at <= capacity and all(c < at for c in P.CAPACITIES if c < capacity)
    full = sum(n for b in bins.values() for _, n, _ in b) / sum(b[0][2] for b in bins.values())
    assert full > 0.9


def test_empty_table(spark):
    assert P.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def bins_of(way, lengths):
    """{bin: (fill, capacity)}"""
    fill = defaultdict(int)
    for b, n in zip(way[0].tolist(), lengths, strict=True):
        fill[b] += n
    return {b: (fill[b], c) for b, c in zip(way[0].tolist(), way[2].tolist(), strict=True)}


def total(way, lengths, attention=0.1):
    return sum(c * (1 + attention * c / 8192) for _, c in bins_of(way, lengths).values())


def test_mid_sized_pieces_share_long_bins(spark):
    got = P.pack(spark.createDataFrame([(i, "x" * 1499) for i in range(50)], "doc_id long, text string")).collect()
    assert {r.capacity for r in got} == {8192} and len({r.bin_id for r in got}) == 10


def test_bins_are_downsized_when_others_took_their_pieces():
    lengths = [3000, 3000, 3000, 1900, 1050, 1050]
    choose, chosen = P.joint(np.array(lengths), P.CAPACITIES, 0.1, 0.0), []
    way = P.best_fit(np.array(lengths), P.CAPACITIES, lambda i: chosen.append(choose(i)) or chosen[-1])
    final = [c for _, c in bins_of(way, lengths).values()]
    assert sum(final) < sum(chosen) and all(f <= c for f, c in zip(final, chosen, strict=True))


def test_never_dearer_than_the_smallest_lengths():
    rng = random.Random(4)
    cheaper = 0
    for top in (300, 1700, 2000, 4000, 8192):
        for n in (1, 7, 60, 400):
            lengths = sorted((rng.randrange(max(1, top - 900), top + 1) if n % 2 else rng.randrange(1, top + 1) for _ in range(n)), reverse=True)
            way, small = P.cheapest(np.array(lengths), P.CAPACITIES, 0.1), P.best_fit(np.array(lengths), P.CAPACITIES, lambda i, x=lengths: P.opened(x[i], P.CAPACITIES))
            bins = bins_of(way, lengths)
            assert all(f <= c for f, c in bins.values()) and sum(f for f, _ in bins.values()) == sum(lengths)
            assert total(way, lengths) <= total(small, lengths)
            cheaper += total(way, lengths) < total(small, lengths)
    assert cheaper
