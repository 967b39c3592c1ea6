"""Filling containers of fixed capacity with items of varying length.

Only the length histogram is optimised: at most ``capacity`` numbers, whatever the number of items.
Lengths fall into size classes (exact up to 64, then to 1.6 %), and the configuration linear program
over the classes, "cover every item with as few containers as possible", is solved by multiplicative
weights: each class carries a price, a knapsack by dynamic programming finds the fullest-priced
configuration, and the prices of the classes it packs fall. The prices prove a lower bound, which the
fill report states. The fractional solution is rounded down, and what is left is packed by best fit,
first into the room that rounded containers have left. Best fit alone is worked out as well, and the
plan with fewer containers counts, so the program never costs any.

Items get their place by rank within their length: the plan says for each length which ranks lie in
which container. The ranks come from bucketed running counts, so a length that a third of the items
share is no hot group. The plan is broadcast; its size is bounded by containers' configurations, not
by items.

Defined results: items of 0 tokens need no container and are left out; an item longer than the
capacity is cut into full pieces and a rest, and only such an item is; null texts have no tokens;
repeated texts are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.operators.skew import bucketed_rank
from graphloom.storage import materialize


def size_class(length: int) -> int:
    """The length rounded up to its class."""
    if length <= 64:
        return length
    step = 1 << (length.bit_length() - 7)
    return -(-length // step) * step


def _knapsack(lengths: np.ndarray, prices: np.ndarray, counts: np.ndarray, capacity: int) -> Counter:
    """The most valuable configuration: how many of each class fit into the capacity (bounded by their counts)."""
    parts: list[tuple[int, int]] = []  # (class, multiple), binary splitting of the bound
    for k in np.argsort(-prices / lengths, kind="stable"):
        most = min(int(counts[k]), capacity // int(lengths[k]))
        take = 1
        while most > 0 and prices[k] > 0:
            parts.append((int(k), min(take, most)))
            most -= take
            take *= 2
    best = np.zeros(capacity + 1)
    chosen = np.zeros((len(parts), capacity + 1), dtype=bool)
    for p, (k, m) in enumerate(parts):
        size, value = int(lengths[k]) * m, float(prices[k]) * m
        if size > capacity:
            continue
        better = best[:-size] + value > best[size:] 
        chosen[p, size:] = better
        best[size:] = np.where(better, best[:-size] + value, best[size:])
    room, out = int(np.argmax(best)), Counter()
    for p in range(len(parts) - 1, -1, -1):
        if chosen[p, room]:
            k, m = parts[p]
            out[k] += m
            room -= int(lengths[k]) * m
    return out


@dataclass
class Solution:
    """A plan, the least number of containers that the dual of the linear program proves, and how it came about."""

    rows: list[tuple[int, dict[int, int]]]
    containers: int = 0
    bound: int = 0
    rounds: int = 0
    method: str = ""


def solve(histogram: dict[int, int], capacity: int, gap: float = 0.0005) -> Solution:
    """The better of the rounded linear program and of filling alone.

    The multiplicative weights run until the rounded plan is within ``gap`` of the proven bound, for at most 60 rounds and
    as many more as keep the knapsacks' work the same for any number of size classes. Every round's prices are a dual solution: divided by the value of the
    fullest-priced configuration they prove a lower bound; it is taken with each class at its least length, so that it holds for the
    lengths themselves.
    """
    by_class: dict[int, list[int]] = defaultdict(list)
    for length in sorted(histogram):
        by_class[min(size_class(length), capacity)].append(length)
    sizes = np.array(sorted(by_class), dtype=np.int64)
    if not len(sizes):
        return Solution([])
    counts = np.array([sum(histogram[n] for n in by_class[int(s)]) for s in sizes], dtype=np.int64)
    least = np.array([min(by_class[int(s)]) for s in sizes], dtype=np.int64)  # a configuration of the least lengths holds whatever one of the real lengths holds
    volume = -(-sum(n * c for n, c in histogram.items()) // capacity)
    bound, covered, weights = float(volume), np.zeros(len(sizes)), np.ones(len(sizes))
    used: dict[tuple, float] = defaultdict(float)
    class_of = {n: int(c) for c, members in by_class.items() for n in members}
    best: list[tuple[int, dict[int, int]]] = []
    mean = np.zeros(len(sizes))  # of the rounds' prices, the steadier dual solution
    rounds, last = 0, 60 + 24_000 // len(sizes)
    for rounds in range(1, last + 1):
        prices = sizes * weights / weights.max()
        mean += prices / (prices @ counts)
        config = _knapsack(sizes, prices, counts, capacity)
        if config:
            # as many containers of this configuration as its scarcest class allows in one step
            step = min(counts[k] / m for k, m in config.items()) / 4
            used[tuple(sorted(config.items()))] += step
            for k, m in config.items():
                covered[k] += step * m
            weights = np.exp(-3.0 * (covered / counts - (covered / counts).min()))
        if config and rounds not in (60, last) and (rounds % 128 or rounds < 60):
            continue
        for dual in (prices, mean):
            if fullest := _knapsack(least, dual, counts, capacity):
                bound = max(bound, float(dual @ counts) / sum(dual[k] * m for k, m in fullest.items()))
        scale = 1 / (covered / counts).max() if covered.max() > 0 else 0.0
        shares = [({int(sizes[k]): m for k, m in c}, int(amount * scale)) for c, amount in sorted(used.items(), key=lambda cu: -max(sizes[k] for k, _ in cu[0]))]
        rows = _rounded(histogram, class_of, capacity, shares)
        if not best or _containers(rows) < _containers(best):
            best = rows
        if not config or _containers(best) <= math.ceil(bound * (1 + gap)):
            break
    alone = _rounded(histogram, class_of, capacity, [])
    method, rows = ("filling", alone) if _containers(alone) < _containers(best) else ("linear program", best)
    return Solution(rows, _containers(rows), math.ceil(bound - 1e-6), rounds, method)


def _containers(rows: list[tuple[int, dict[int, int]]]) -> int:
    return sum(many for many, _ in rows)


def _rounded(histogram: dict[int, int], class_of: dict[int, int], capacity: int, shares: list[tuple[dict[int, int], int]]) -> list[tuple[int, dict[int, int]]]:
    """Containers of the configurations as often as said, then whatever is left by best fit."""
    supply = _Supply(histogram, class_of)
    out: list[tuple[int, dict[int, int]]] = []
    for config, many in shares:
        while many > 0:
            pick = supply.pick(config, capacity)
            if pick is None:
                break
            batch = supply.take(pick, many)
            out.append((batch, pick))
            many -= batch
    while supply.lengths:
        pick = supply.fill({}, capacity)
        out.append((supply.take(pick, 1 << 60), pick))
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(containers, {length: items in each})] that holds every item of the histogram.

    All lengths are between 1 and the capacity.
    """
    return solve(histogram, capacity).rows


class _Supply:
    """The items not yet packed, by exact length."""

    def __init__(self, histogram: dict[int, int], class_of: dict[int, int]) -> None:
        self.count = {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.count)
        self.members: dict[int, list[int]] = defaultdict(list)
        for n in self.lengths:
            self.members[class_of[n]].append(n)

    def pick(self, config: dict[int, int], capacity: int) -> dict[int, int] | None:
        """Exact lengths for a configuration of classes, topped up with the largest items that still fit."""
        chosen: dict[int, int] = {}
        for size, need in config.items():
            for n in reversed(self.members[size]):
                if take := min(need, self.count.get(n, 0)):
                    chosen[n] = take
                    need -= take
                if not need:
                    break
            if need:
                return None
        return self.fill(chosen, capacity)

    def fill(self, chosen: dict[int, int], capacity: int) -> dict[int, int]:
        """Add the largest items that fit, again and again; the last gap exactly where two items can."""
        room = capacity - sum(n * m for n, m in chosen.items())
        at = bisect_right(self.lengths, room)
        while room > 0 and at > 0:
            n = self.lengths[at - 1]
            free = self.count[n] - chosen.get(n, 0)
            if n > room or free <= 0:
                at = min(at - 1, bisect_right(self.lengths, room))
                continue
            if room < 2 * n and (pair := self._pair(room, chosen)):
                for x in pair:
                    chosen[x] = chosen.get(x, 0) + 1
                return chosen
            m = min(free, max(1, room // n - 1))
            chosen[n] = chosen.get(n, 0) + m
            room -= n * m
        return chosen

    def _pair(self, room: int, chosen: dict[int, int]) -> tuple[int, ...] | None:
        """One or two items that fill the room exactly."""
        free = lambda n, k=1: self.count.get(n, 0) - chosen.get(n, 0) >= k
        if free(room):
            return (room,)
        for n in self.lengths[: bisect_right(self.lengths, room // 2)]:
            if free(n, 2 if 2 * n == room else 1) and free(room - n, 2 if 2 * n == room else 1):
                return (n, room - n)
        return None

    def take(self, pick: dict[int, int], many: int) -> int:
        """Pack as many containers with these lengths as wanted and possible."""
        batch = min(many, *(self.count[n] // m for n, m in pick.items()))
        for n, m in pick.items():
            self.count[n] -= batch * m
            if not self.count[n]:
                del self.count[n]
                del self.lengths[bisect_right(self.lengths, n) - 1]
        return batch


class Places:
    """Where the item of a given rank within its length lies."""

    def __init__(self, rows: list[tuple[int, dict[int, int]]]) -> None:
        self.starts: dict[int, list[int]] = defaultdict(list)
        self.cells: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.containers = 0
        seen: Counter = Counter()
        for many, config in rows:
            for length, m in config.items():
                self.starts[length].append(seen[length])
                self.cells[length].append((self.containers, m))
                seen[length] += many * m
            self.containers += many

    def container(self, length: int, rank: int) -> int:
        """The container's number."""
        i = bisect_right(self.starts[length], rank) - 1
        first, m = self.cells[length][i]
        return first + (rank - self.starts[length][i]) // m


def pieces(sizes: DataFrame, id_column: str, capacity: int) -> DataFrame:
    """(id, piece, pieces, length): an item as one piece, or cut where it exceeds the capacity."""
    n = F.ceil(F.col("tokens") / F.lit(capacity)).cast("int")
    return (
        sizes.where("tokens > 0")
        .select(id_column, "tokens", n.alias("pieces"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
        .select(id_column, "piece", "pieces", F.when(F.col("piece") < F.col("pieces") - 1, F.lit(capacity)).otherwise(F.col("tokens") - F.lit(capacity) * (F.col("pieces") - 1)).cast("int").alias("length"))
    )


def pack(sizes: DataFrame, id_column: str, kind: str, capacity: int, solutions: dict[str, Solution] | None = None) -> DataFrame:
    """(container_kind, container, id, piece, pieces, length): every piece in its container.

    ``sizes`` (id, tokens) should be a written table: it is read twice. ``solutions`` takes up how the plan came about.
    """
    spark = sizes.sparkSession
    cut = pieces(sizes, id_column, capacity)
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    solution = solve(histogram, capacity)
    if solutions is not None:
        solutions[kind] = solution
    places = Places(solution.rows)
    held = spark.sparkContext.broadcast(places)
    ranked = bucketed_rank(
        cut.withColumn("_key", F.concat_ws(":", F.col(id_column).cast("string"), F.col("piece").cast("string"))), ["length"], "_key", total_rows=sum(histogram.values())
    ).select(id_column, "piece", "pieces", "length", "rank")
    kind_of = dict(ranked.dtypes)[id_column]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = held.value
        for batch in batches:
            numbers = [where.container(n, r) for n, r in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(numbers), pa.string()), pa.array(numbers, pa.int64()), *batch.columns[:4]], names=["container_kind", "container", id_column, "piece", "pieces", "length"])

    return ranked.mapInArrow(place, f"container_kind string, container bigint, `{id_column}` {kind_of}, piece int, pieces int, length int")


def pack_all(sizes: DataFrame, id_column: str, containers: DataFrame, solutions: dict[str, Solution] | None = None) -> DataFrame:
    """:func:`pack` for every container kind (a small fixed table)."""
    held = materialize(sizes.select(id_column, "tokens"), "sizes")
    out = None
    for row in containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().orderBy("container_kind", "capacity_tokens").collect():
        one = pack(held, id_column, row.container_kind, row.capacity_tokens, solutions)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else pack(held.limit(0), id_column, "", 1)


def fill_report(packed: DataFrame, containers: DataFrame, solutions: dict[str, Solution] | None = None) -> DataFrame:
    """(container_kind, capacity_tokens, containers, items, tokens, fill): how full the containers are.

    With ``solutions`` also ``least_containers`` (the proven bound), ``lp_rounds`` and ``method``.
    """
    used = packed.groupBy("container_kind", "container").agg(F.sum("length").alias("held"), F.count(F.lit(1)).alias("items"))
    total = used.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("held").alias("tokens"), F.max("held").alias("fullest"))
    report = total.join(F.broadcast(containers.select("container_kind", "capacity_tokens").distinct()), "container_kind").select(
        "container_kind", "capacity_tokens", "containers", "items", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    )
    if solutions is None:
        return report
    held = packed.sparkSession.createDataFrame([(k, s.bound, s.rounds, s.method) for k, s in solutions.items()], "container_kind string, least_containers bigint, lp_rounds int, method string")
    return report.join(F.broadcast(held), "container_kind")  # one row a container kind
