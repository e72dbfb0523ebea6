"""Operator 4: variable-capacity best-fit packing of documents into training sequences.

Lengths are UTF-8 bytes plus one end mark, the tokens of a byte-level vocabulary; any other length
column can be given.  A document longer than the largest permitted length is cut into pieces of that
length first.  Pieces are dealt to shards of about `shard_pieces` by a hash of id, piece and length, with
a rank among equal ones, so bins don't depend on how the input is partitioned.  A shard packs its own:
pieces by decreasing length, each into the open bin with the least room that still holds it.  If none
does, a bin is opened.  A bin of capacity c costs `per_sequence` for itself and c * (1 + attention * c / largest)
for its length, so neither many short bins nor few half-empty long ones come cheap.

The lengths to open are chosen jointly over the shard's histogram of lengths (`plan`): a knapsack over it gives
the contents of the most worth for each permitted length, the length with the most worth for its cost is taken
as often as the histogram allows, and so on until it is empty; what a length class has cost in these bins is its
worth in the next round.  The plan says for each opening piece which length its bin has; pieces then go by best
fit, so they may end in other bins than planned, and after the last piece each bin is made as small as a permitted
length allows.  Of the plans, the greedy choice by simulated fill (`joint`) and the smallest lengths that hold each piece
(`opened`) a shard takes what costs least in all.

Equal pieces go one way, so a shard works through at most `largest` different lengths and groups of
equal bins, not through pieces; hash shards are even whatever the texts, and each loses at most a few
part-filled bins.

Defined results: null or empty text has length 1, its end mark; rows are pieces of their own even if
they repeat; a null doc_id packs like others; ties go by doc_id, then piece; an empty table gives an
empty table; extra columns aren't used.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutplan.llm.shared import saved, work_dir

CAPACITIES = (2048, 4096, 8192)
PACKED = "doc_id long, piece int, first long, length int, bin_id string, capacity int, place int"


def byte_length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def pieces(docs: DataFrame, doc_id: str, length: Column, largest: int) -> DataFrame:
    """(doc_id, piece, first, length): each document in pieces of at most `largest`."""
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(length, F.lit(1)).alias("n"))
    count = F.ceil(F.col("n") / largest).cast("int")
    cut = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    first = F.col("piece").cast("long") * largest
    return cut.select("doc_id", "piece", first.alias("first"), F.least(F.lit(largest), F.col("n") - first).cast("int").alias("length"))


def bin_cost(capacity: int, capacities: tuple[int, ...], attention: float, per_sequence: float = 0.0) -> float:
    return per_sequence + capacity * (1 + attention * capacity / capacities[-1])


def opened(length: int, capacities: tuple[int, ...]) -> int:
    """The smallest permitted length that holds a piece."""
    return next(c for c in capacities if c >= length)


def joint(lengths: np.ndarray, capacities: tuple[int, ...], attention: float, per_sequence: float) -> Callable[[int], int]:
    """The permitted length to open for piece i of lengths in decreasing order, by the fill that each would
    have if the longest of the pieces still to come that fit went into it, one after the other."""
    falling = (-lengths).tolist()

    def fill(i: int, capacity: int) -> int:
        room, at = capacity + falling[i], i + 1
        while room and (at := bisect_left(falling, -room, at)) < len(falling):
            size, end = -falling[at], bisect_right(falling, falling[at], at)
            room -= size * min(end - at, room // size)
            at = end
        return capacity - room

    def choose(i: int) -> int:
        fits = [c for c in capacities if c >= -falling[i]]
        return min(fits, key=lambda c: (bin_cost(c, capacities, attention, per_sequence) / fill(i, c), c))

    return choose


#: Length classes of a plan, and its rounds.
CLASSES, ROUNDS = 128, 4


def worthiest(left: np.ndarray, worth: np.ndarray, size: int) -> tuple[np.ndarray, Callable[[int], dict[int, int]]]:
    """The most worth of contents of at most s classes' units, for every s up to `size`, and those contents.

    A bounded knapsack: of class u, with u units a piece, there are left[u] pieces of worth[u] each.
    """
    best, taken = np.zeros(size + 1), []
    for u in np.flatnonzero(left[: size + 1]).tolist():
        count, part = min(int(left[u]), size // u), 1
        while count:
            part = min(part, count)
            units = u * part
            tried = best[: size + 1 - units] + worth[u] * part
            better = tried > best[units:]
            best[units:] = np.where(better, tried, best[units:])
            taken.append((u, part, units, better))
            count -= part
            part *= 2

    def contents(s: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for u, part, units, better in reversed(taken):
            if s >= units and better[s - units]:
                out[u] = out.get(u, 0) + part
                s -= units
        return out

    return best, contents


def plans(lengths: np.ndarray, capacities: tuple[int, ...], attention: float, per_sequence: float) -> list[dict[int, list[int]]]:
    """For each round {class of the longest piece: lengths of the bins that it opens}, jointly over all classes."""
    unit = -(-capacities[-1] // CLASSES)
    have = np.bincount(-(-lengths // unit), minlength=CLASSES + 1)
    cost = {c: bin_cost(c, capacities, attention, per_sequence) for c in capacities}
    worth, out = np.arange(len(have), dtype=np.float64), []
    for _ in range(ROUNDS):
        left, bins = have.copy(), {}
        paid, seen = np.zeros(len(have)), np.zeros(len(have))
        while left.any():
            best, contents = worthiest(left, worth, capacities[-1] // unit)
            rated = [(best[c // unit] / cost[c], -c) for c in capacities]
            capacity = -max(rated)[1]
            inside = contents(capacity // unit)
            if not inside:
                # rounded up, the longest class may need more than the units of the largest length
                inside, capacity = {int(np.flatnonzero(left)[-1]): 1}, capacities[-1]
            times = min(int(left[u]) // k for u, k in inside.items())
            fill = sum(u * k for u, k in inside.items())
            for u, k in inside.items():
                left[u] -= k * times
                paid[u] += k * times * cost[capacity] * u / fill
                seen[u] += k * times
            bins.setdefault(max(inside), []).extend([capacity] * times)
        out.append(bins)
        worth = np.where(seen > 0, (worth + paid / np.maximum(seen, 1)) / 2, worth)
    return out


def planned(lengths: np.ndarray, bins: dict[int, list[int]], capacities: tuple[int, ...], otherwise: Callable[[int], int]) -> Callable[[int], int]:
    """The length to open for piece i by a plan: that of its class, else of the next shorter one whose bins hold it."""
    unit = -(-capacities[-1] // CLASSES)
    queues = {u: sorted(b) for u, b in bins.items()}
    classes = sorted(queues)

    def choose(i: int) -> int:
        size = int(lengths[i])
        at = bisect_right(classes, -(-size // unit))
        while at:
            at -= 1
            queue = queues[classes[at]]
            if queue and queue[-1] >= size:
                return queue.pop()
            if not queue:
                del classes[at]
        return otherwise(i)

    return choose


Way = tuple[np.ndarray, np.ndarray, np.ndarray]


def cheapest(lengths: np.ndarray, capacities: tuple[int, ...], attention: float, per_sequence: float = 0.0) -> Way:
    """The packing of least cost of those by plans, by `joint` and by the smallest lengths."""
    greedy = joint(lengths, capacities, attention, per_sequence)
    ways = [planned(lengths, bins, capacities, greedy) for bins in plans(lengths, capacities, attention, per_sequence)]
    made = [best_fit(lengths, capacities, choose) for choose in (*ways, greedy, lambda i: opened(int(lengths[i]), capacities))]
    return min(made, key=lambda way: sum(bin_cost(int(c), capacities, attention, per_sequence) for c in way[2][way[1] == 0]))


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], choose: Callable[[int], int]) -> Way:
    """(bin, place, capacity) for lengths in decreasing order; `choose(i)` gives the length to open for piece i."""
    n = len(lengths)
    bins, places, rooms = np.empty(n, np.int64), np.empty(n, np.int64), []
    used: list[int] = []
    open_rooms: list[int] = []
    by_room: dict[int, list[int]] = {}

    def put_back(b: int, room: int) -> None:
        if room:
            if room not in by_room:
                insort(open_rooms, room)
                by_room[room] = []
            heappush(by_room[room], b)

    for i, size in enumerate(lengths.tolist()):
        at = bisect_left(open_rooms, size)
        if at < len(open_rooms):
            room = open_rooms[at]
            b = heappop(by_room[room])
            if not by_room[room]:
                del by_room[room], open_rooms[at]
        else:
            room, b = choose(i), len(used)
            used.append(0)
            rooms.append(room)
        bins[i], places[i] = b, used[b]
        used[b] += size
        put_back(b, room - size)
    allowed = np.array(capacities)
    final = allowed[np.searchsorted(allowed, np.array(used, np.int64))] if used else np.zeros(0, np.int64)
    return bins, places, final[bins] if n else final


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES,
    attention: float = 0.1, per_sequence: float = 160.0, shard_pieces: int = 20_000,
) -> DataFrame:
    """(doc_id, piece, first, length, bin_id, capacity, place): each piece's range of its document and where it lies."""
    capacities = tuple(sorted(capacities))
    parts = pieces(docs, doc_id, length if length is not None else byte_length(F.col(text)), capacities[-1])
    # rows of one id, piece and length are alike in all that is returned; a rank among them deals them out too
    counted = parts.groupBy("doc_id", "piece", "first", "length").agg(F.count(F.lit(1)).alias("n"))
    counted = saved(counted, f"{work_dir(docs.sparkSession, 'packing')}/pieces")
    total = counted.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    ranked = counted.select("doc_id", "piece", "first", "length", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("rank"))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "length", "rank"), F.lit(shards))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, places, capacity = cheapest(group["length"].to_numpy(), capacities, attention, per_sequence)
        group = group.assign(bin_id=[f"{key[0]}-{b}" for b in bins], capacity=capacity, place=places)
        return group[["doc_id", "piece", "first", "length", "bin_id", "capacity", "place"]]

    return ranked.withColumn("shard", spread).drop("rank").groupBy("shard").applyInPandas(run, PACKED)


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: every piece and its place."""
    return pack(docs)
