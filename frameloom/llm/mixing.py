"""Mixing sources to target weights under repetition caps: temperature mixing and budgeted block permutations."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.runtime import cut

#: Records of a source are permuted in blocks of about this many; only the block in which a budget ends is read record by record.
BLOCK_RECORDS = 4096


def tempered(shares: dict[str, float], exponent: float, towards: dict[str, float] | None = None) -> dict[str, float]:
    """Shares to the power ``exponent``, normalised; with ``towards``, the ratio of that mix to the shares is
    exponentiated instead: 0 gives the shares, 1 the other mix."""
    logs = {s: exponent * math.log(p) if towards is None else math.log(p) + exponent * (math.log(towards[s]) - math.log(p)) for s, p in shares.items() if p > 0 and (towards is None or towards.get(s, 0) > 0)}
    top = max(logs.values(), default=0.0)
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(low: float, high: float, holds, rounds: int = 60) -> float:
    """The largest number in [low, high] up to which ``holds`` is true, given that it is at ``low``."""
    if holds(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def exponent_for_entropy(sizes: dict[str, float], wanted: float) -> float:
    """The exponent at which the tempered shares of ``sizes`` have the entropy ``wanted``; entropy falls as it grows."""
    total = sum(sizes.values())
    shares = {s: n / total for s, n in sizes.items() if n > 0}
    return bisect(0.0, 64.0, lambda x: entropy(tempered(shares, x)) >= wanted)


def relative_entropy(weights: dict[str, float], shares: dict[str, float]) -> float:
    return sum(w * math.log(w / shares[s]) for s, w in weights.items() if w > 0)


def exponent_for_targets(shares: dict[str, float], targets: dict[str, float]) -> float:
    """The exponent at which the shares tempered towards the targets are as far from the natural shares, in relative entropy, as the targets are.
    The distance grows with the exponent, so bisection finds it."""
    wanted = relative_entropy(tempered(targets, 1.0), tempered(shares, 1.0))
    return bisect(0.0, 2.0, lambda x: relative_entropy(tempered(shares, x, targets), shares) <= wanted)


def largest_total(sizes: dict[str, float], weights: dict[str, float], caps: dict[str, int | None]) -> float:
    """The largest total at which no source has to be repeated more often than its cap; without caps, the total size."""
    bounds = [caps[s] * sizes[s] / w for s, w in weights.items() if w > 0 and caps.get(s) is not None]
    return min(bounds, default=float(sum(sizes.values())))


def plan_weights(sizes: dict[str, float], targets: dict[str, float], caps: dict[str, int | None], total: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, total, exponent) of a mix of sources with these sizes.

    The natural shares are tempered towards the targets, and the exponent is bisected: without a total to the relative entropy of the targets, which gives
    the targets themselves, and the total is the largest at which no source exceeds its cap; with a wanted total to the repetition limit, the
    largest exponent up to that at which no cap is exceeded. Sources of no size fall out and the rest is normalised.
    """
    have = {s: n for s, n in sizes.items() if n > 0 and targets.get(s, 0) > 0}
    if not have:
        return {}, 0.0, 1.0
    shares = {s: n / sum(have.values()) for s, n in have.items()}
    exponent = exponent_for_targets(shares, {s: targets[s] for s in have})
    capped = any(caps.get(s) is not None for s in have)
    if total is not None and capped:
        holds = lambda x: total <= largest_total(have, tempered(shares, x, targets), caps) + 1e-9
        exponent = bisect(0.0, exponent, holds) if holds(0.0) else 0.0
    weights = tempered(shares, exponent, targets)
    most = largest_total(have, weights, caps)
    return weights, most if total is None else min(total, most) if capped else total, exponent


def mix(df: DataFrame, key: str, source: str, size: str, targets: list[tuple[str, float, int | None]], total: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """A selection in which each source holds its target share of the total size: (selection, report).

    ``targets``: (source, share, most repeats or None). The selection has ``key``, ``source``, ``size`` and ``uses``, how
    often to use the record; no use exceeds the cap. Budgets are realised as whole passes over the source and one partial
    pass over a permutation: blocks in random order, and in the block where the budget ends, records in random order as long as they fit.
    The report has a row per target: ``available``, ``budget``, ``taken``, ``share`` (reached), ``most_uses``, ``unused`` (the size of its records that are never used) and the ``exponent`` of the mix.

    Records with null key, null source or another source than the targets', and those of null or no size, take no part; a repeated
    key counts once, with its largest size. A target without records is reported with share 0. Targets repeat at most once each.
    """
    wanted = {s: (float(w), r) for s, w, r in targets if s is not None and w is not None and w > 0}
    rows = df.where(F.col(key).isNotNull() & F.col(source).isin(*wanted) & (F.col(size) > 0)).groupBy(F.col(key).alias("id")).agg(F.max(F.struct(F.col(size).cast("long").alias("size"), F.col(source).alias("source"))).alias("x"))
    records = cut(rows.select("id", "x.source", "x.size").withColumn("draw", F.xxhash64(F.lit(seed), "id")))
    sums = {r["source"]: (r["n"], r["records"]) for r in records.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("records")).collect()}
    sizes = {s: float(sums.get(s, (0, 0))[0]) for s in wanted}
    caps = {s: r for s, (_, r) in wanted.items()}
    weights, total, exponent = plan_weights(sizes, {s: w for s, (w, _) in wanted.items()}, caps, total)
    budget = {s: math.floor(total * weights.get(s, 0.0) + 1e-6) for s in wanted}
    passes = {s: int(budget[s] // sizes[s]) if sizes[s] else 0 for s in wanted}
    partial = {s: int(budget[s] - passes[s] * sizes[s]) for s in wanted}

    def lookup(values: dict, kind: str):
        return F.element_at(F.create_map(*[F.lit(x).cast(kind) if i else F.lit(x) for s, v in values.items() for i, x in enumerate((s, v))]), F.col("source"))

    spread = records.withColumn("block", F.pmod(F.col("draw"), lookup({s: max(1, math.ceil(sums.get(s, (0, 0))[1] / BLOCK_RECORDS)) for s in wanted}, "long")))
    blocks = spread.groupBy("source", "block").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("room", lookup(partial, "long") - F.coalesce(F.sum("held").over(before), F.lit(0))).where("room > 0").select("source", "block", "room", (F.col("room") >= F.col("held")).alias("whole"))
    joined = spread.join(placed, ["source", "block"], "left")
    rounds = lookup(passes, "long")
    inner = joined.where("whole is null or whole").select("id", "source", "size", (rounds + F.when(F.col("whole"), 1).otherwise(0)).alias("uses"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("id", "ascending")])
        room, extra = table["room"][0].as_py(), []
        for n in table["size"].to_pylist():
            extra.append(int(n <= room))
            room -= n * extra[-1]
        return pa.table({"id": table["id"], "source": table["source"], "size": table["size"], "extra": pa.array(extra, pa.int64())})

    kind = df.schema[key].dataType.simpleString()
    edge = joined.where("not whole").select("source", "block", "id", "size", "draw", "room").groupBy("source", "block").applyInArrow(fill, f"id {kind}, source string, size bigint, extra bigint")
    chosen = inner.unionByName(edge.select("id", "source", "size", (rounds + F.col("extra")).alias("uses"))).where("uses > 0")
    taken = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("taken"), F.max("uses").alias("most_uses"), F.sum("size").alias("used"))
    plan = df.sparkSession.createDataFrame([(s, w, r, int(sizes[s]), int(budget[s])) for s, (w, r) in wanted.items()], "source string, target double, most_repeats int, available long, budget long")
    report = plan.join(taken, "source", "left").fillna(0, ["taken", "most_uses", "used"]).withColumn("unused", F.col("available") - F.col("used")).drop("used").withColumn("exponent", F.lit(round(exponent, 9)))
    everything = F.sum("taken").over(Window.partitionBy(F.lit(1)))  # a row per target
    report = report.withColumn("share", F.when(everything > 0, F.col("taken") / everything).otherwise(F.lit(0.0)))
    return chosen.select(F.col("id").alias(key), "source", "size", "uses"), report
