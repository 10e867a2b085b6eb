"""Items of varying length into containers of fixed capacity: minimum bin slack."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.runtime import cut

#: Items are packed in blocks of about this many; each block leaves at most about one container badly filled.
BLOCK_ITEMS = 20_000
#: More tasks than this are of no use to a cluster; beyond it a task packs several blocks, one after another.
MOST_TASKS = 100_000


def best_fill(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How many items of each length to take so that their sum comes closest to ``room`` without exceeding it.

    Subset sums are the bits of one integer. Each length enters in bundles of 1, 2, 4, ... items; the sums before each
    bundle are kept, and backtracking from the best sum tells which bundles made it. Stops at an exact fill.
    ``lengths`` are in descending order.
    """
    mask, full = (1 << (room + 1)) - 1, 1 << room
    sums, steps = 1, []
    for length in lengths:
        if length > room or sums & full:
            continue
        left, bundle = min(counts[length], room // length), 1
        while left > 0 and not sums & full:
            n = min(bundle, left)
            steps.append((length, n, sums))
            sums |= (sums << (n * length)) & mask
            left, bundle = left - n, bundle * 2
    at, taken = sums.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + n
            at -= n * length
    return taken


def pack_block(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Containers as lists of (item, piece, start, length). An item longer than the capacity fills containers of its
    own; its remainder is packed like an item. Items of length 0 go into the first container."""
    containers: list[list[tuple[int, int, int, int]]] = []
    waiting: dict[int, list[tuple[int, int, int, int]]] = {}
    empty = []
    for item, size in enumerate(sizes):
        pieces = size // capacity if size > capacity else 0
        containers += [[(item, p, p * capacity, capacity)] for p in range(pieces)]
        rest = size - pieces * capacity
        if rest:
            waiting.setdefault(rest, []).append((item, pieces, pieces * capacity, rest))
        elif not size:
            empty.append((item, 0, 0, 0))
    lengths = sorted(waiting, reverse=True)
    counts = {length: len(x) for length, x in waiting.items()}

    def take(length: int, n: int) -> list:
        counts[length] -= n
        if not counts[length]:
            lengths.remove(length)
        return [waiting[length].pop() for _ in range(n)]

    while lengths:
        box = take(lengths[0], 1)
        room = capacity - box[0][3]
        if room and lengths and lengths[-1] <= room:
            for length, n in best_fill(room, lengths, counts).items():
                box += take(length, n)
        containers.append(box)
    if empty:
        if not containers:
            containers.append([])
        containers[0] += empty
    return containers


def pack(df: DataFrame, key: str, size: str, profiles: list[tuple[str, int]], block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Containers of each profile (name, capacity), filled with whole items as fully as possible.

    Columns: ``profile``, ``container`` (name, unique), ``key``, ``piece`` and ``start`` (of an item that alone exceeds the
    capacity; else 0), ``length``, and ``filled``, the sum of the container. Every row of ``df`` is an item, repeated ones too; a
    null or negative size counts as 0, and items of size 0 join the first container of their block. Items are spread over
    blocks of bounded size at random, with a fixed seed. An empty table gives no containers.
    """
    profiles = sorted({(p, int(c)) for p, c in profiles if c is not None and c > 0}, key=str)
    if not profiles:
        raise ValueError("no profile with a positive capacity")
    items = df.select(F.col(key).alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    items = cut(items)  # written rows keep their order, and so their block, when a task is run again
    blocks = max(1, math.ceil(items.count() / block_items))
    kind = df.schema[key].dataType.simpleString()
    # rand with a seed spreads also a third of the rows under one key
    spread = items.withColumn("block", F.floor(F.rand(11) * blocks).cast("int")).withColumn("profile", F.explode(F.array(*[F.struct(F.lit(p).alias("name"), F.lit(c).cast("long").alias("capacity")) for p, c in profiles])))
    # a block is little data and much work: one partition for each, not as many as the size of the data asks for
    flat = spread.select("profile.name", "profile.capacity", "block", "id", "size").repartition(min(MOST_TASKS, 2 * blocks * len(profiles)), "name", "capacity", "block")

    def run(table: pa.Table) -> pa.Table:
        name, capacity, block = (table[c][0].as_py() for c in ("name", "capacity", "block"))
        table = table.sort_by([("size", "descending"), ("id", "ascending")])
        boxes = pack_block(table["size"].to_pylist(), capacity)
        rows = [(f"{name}-{block}-{n}", i, p, s, length, sum(x[3] for x in box)) for n, box in enumerate(boxes) for i, p, s, length in box]
        box, at, piece, start, length, filled = (list(c) for c in zip(*rows))
        return pa.table({"profile": pa.array([name] * len(rows)), "container": pa.array(box), "id": table["id"].take(pa.array(at)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "filled": pa.array(filled, pa.int64())})

    out = flat.groupBy("name", "capacity", "block").applyInArrow(run, f"profile string, container string, id {kind}, piece int, start bigint, length bigint, filled bigint")
    return out.withColumnRenamed("id", key)
