"""Items of varying length packed into containers of fixed capacity, by minimum bin slack.

Only the histogram of lengths is planned on the driver; it has at most ``capacity`` rows however
many items there are. Each window is seeded with the longest remaining length, and a bitset
subset-sum over the remaining multiset finds the filling closest to the capacity. The filling
is backtracked into counts per length and used for as many containers as the counts allow, so the
number of windows follows the number of lengths, not of items. Items then find their container
by their rank among the items of their length, which is counted in two steps so that no length,
however frequent, becomes one task.

Defined results: an item longer than the capacity fills containers of its own, and its rest is
packed like an item; items of length zero (empty and null texts) take no room and are spread over
the containers at offset zero; ties are settled by item id, so results are repeatable; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosescan.functions.scratch import materialize, small_or_shuffled

#: Parts into which the items of one length are split for ranking.
RANK_PARTS = 256


def closest_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum comes closest to ``room`` from below."""
    mask = (1 << (room + 1)) - 1
    reach = 1
    layers: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, lengths used) of each window, until nothing of the histogram is left."""
    left = {k: v for k, v in counts.items() if v > 0 and k > 0}
    windows = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        used = closest_filling({k: v for k, v in rest.items() if v}, capacity - seed)
        used[seed] = used.get(seed, 0) + 1
        repeats = min(left[k] // n for k, n in used.items())
        windows.append((repeats, used))
        for k, n in used.items():
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
    return windows


class Plan:
    """Windows arranged for look-up: of each length, which ranks go to which container and offset."""

    def __init__(self, windows: list[tuple[int, dict[int, int]]]):
        self.n_containers = 0
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        seen: dict[int, int] = {}
        for repeats, used in windows:
            offset = 0
            for length in sorted(used, reverse=True):
                rows.setdefault(length, []).append((seen.get(length, 0), used[length], self.n_containers, offset))
                seen[length] = seen.get(length, 0) + used[length] * repeats
                offset += length * used[length]
            self.n_containers += repeats
        self.by_length = {k: np.array(v, np.int64) for k, v in rows.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Container and offset of items given by length and rank among their length."""
        container, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length):
            of = np.flatnonzero(length == size)
            table = self.by_length[int(size)]
            at = table[np.searchsorted(table[:, 0], rank[of], side="right") - 1]
            step = rank[of] - at[:, 0]
            container[of] = at[:, 2] + step // at[:, 1]
            offset[of] = at[:, 3] + step % at[:, 1] * size
        return container, offset


def pack(items: DataFrame, item_id: str, size: str, capacity: int) -> DataFrame:
    """(item_id, piece, piece_start, n_tokens, container_id, container_offset) of every item.

    ``items`` has one row per item; ``piece`` is 0 unless the item exceeds the capacity.
    """
    chosen = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")).alias("size"))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0).cast("bigint"))
    pieces = chosen.select("item", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = pieces.select("item", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("piece") * capacity).alias("n"))
    pieces = materialize(pieces.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(RANK_PARTS)).cast("int")), "pieces")
    sizes = pieces.where("n > 0").groupBy("n", "part").agg(F.count("*").alias("many"))
    before = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.withColumn("base", F.coalesce(F.sum("many").over(before), F.lit(0))), "sizes")
    counts = {r["n"]: r["many"] for r in sizes.groupBy("n").agg(F.sum("many").alias("many")).collect()}
    plan = Plan(plan_windows(counts, capacity))
    in_part = Window.partitionBy("n", "part").orderBy("item", "piece")
    ranked = pieces.where("n > 0").withColumn("row", F.row_number().over(in_part)).join(small_or_shuffled(sizes.select("n", "part", "base")), ["n", "part"])
    ranked = ranked.select("item", "piece", "start", "n", (F.col("base") + F.col("row") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            container, offset = plan.place(b.column("n").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("item", "piece", "start", "n")), pa.array(container), pa.array(offset)], ["item", "piece", "start", "n", "container_id", "container_offset"])

    kind = chosen.schema["item"].dataType.simpleString()
    packed = ranked.mapInArrow(place, f"item {kind}, piece bigint, start bigint, n bigint, container_id bigint, container_offset bigint")
    zero = F.lit(0).cast("bigint")
    empty = pieces.where("n = 0").select("item", "piece", "start", "n", F.pmod(F.xxhash64("item"), F.lit(max(1, plan.n_containers))).alias("container_id"), zero.alias("container_offset"))
    return packed.unionByName(empty).select(F.col("item").alias(item_id), F.col("piece").cast("int").alias("piece"), F.col("start").alias("piece_start"), F.col("n").cast("int").alias("n_tokens"), "container_id", F.col("container_offset").cast("int").alias("container_offset"))
