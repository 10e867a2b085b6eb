"""Search for the best cascade of choosers by simulated annealing.

Every chooser is evaluated once; what a cascade scores depends only on how many cases share each pattern of outcomes, so
the search runs on a table of patterns whose size doesn't grow with the corpus.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_patterns(choices: DataFrame, case: list[str], chooser: str, right: str) -> dict[tuple[int, ...], int]:
    """Counts of patterns over choosers 0, 1, ...: 0 abstains, 1 wrong, 2 right. ``right`` is 1, 0 or null. At most 3 to the power of
    the number of choosers rows reach the driver."""
    names = sorted(r[0] for r in choices.select(chooser).where(F.col(chooser).isNotNull()).distinct().collect())
    if len(names) > 12:
        raise ValueError("patterns are kept for up to 12 choosers")
    outcome = [F.coalesce(F.max(F.when(F.col(chooser) == n, F.when(F.col(right) == 1, 2).when(F.col(right) == 0, 1).otherwise(0))), F.lit(0)).alias(f"c{i}") for i, n in enumerate(names)]
    cols = [f"c{i}" for i in range(len(names))]
    rows = choices.groupBy(*case).agg(*outcome).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()
    return {tuple(r[c] for c in cols): r["n"] for r in rows}


def cascade_score(patterns: dict[tuple[int, ...], int], stages: list[tuple[int, ...]], baseline: float = 0.0) -> tuple[float, float]:
    """(accuracy, precision) of a cascade; a stage of several choosers is a vote, which the majority of those that decide wins.
    An abstention counts ``baseline``, the expectation of a random choice (O-140)."""
    right = decided = total = 0.0
    for pattern, n in patterns.items():
        total += n
        for stage in stages:
            votes = [pattern[i] for i in stage if pattern[i]]
            yes = sum(v == 2 for v in votes)
            if votes and yes * 2 != len(votes):
                decided += n
                right += n * (yes * 2 > len(votes))
                break
        else:
            right += n * baseline
    return (right / total if total else 0.0, right / decided if decided else 0.0)


def anneal(patterns: dict[tuple[int, ...], int], steps: int = 2000, temperature: float = 1.0, cooling: float = 0.998, most_stages: int = 15, vote_ratio: float = 0.25, reset: int = 100, seed: int = 5) -> tuple[list[tuple[int, ...]], float, float]:
    """(cascade, accuracy, precision) found by adding, replacing or removing stages; the first stage stays, worse cascades are taken less and less
    often, and after ``reset`` steps without gain the search returns to the best. Stages that change nothing are pruned (O-139)."""
    rng = random.Random(seed)
    k = len(next(iter(patterns), ()))
    if not k:
        return [], 0.0, 0.0

    def stage():
        return tuple(sorted(rng.sample(range(k), rng.randint(2, min(3, k))))) if k > 1 and rng.random() < vote_ratio else (rng.randrange(k),)

    cache: dict = {}

    def value(c):
        key = tuple(c)
        if key not in cache:
            cache[key] = cascade_score(patterns, c)[0]
        return cache[key]

    now = [(0,)]
    best, best_value, since = now, value(now), 0
    for _ in range(steps):
        new = list(now)
        move = rng.random()
        if (move < 0.4 or len(new) == 1) and len(new) < most_stages:
            new.insert(rng.randint(1, len(new)), stage())
        elif move < 0.8 and len(new) > 1:
            new[rng.randrange(1, len(new))] = stage()
        elif len(new) > 1:
            del new[rng.randrange(1, len(new))]
        gain = value(new) - value(now)
        if gain >= 0 or rng.random() < math.exp(gain * 100 / max(temperature, 1e-9)):
            now = new
        since += 1
        if value(now) > best_value:
            best, best_value, since = list(now), value(now), 0
        if since >= reset:
            now, since = list(best), 0
        temperature *= cooling
    i = 1
    while i < len(best):
        shorter = best[:i] + best[i + 1 :]
        if value(shorter) >= best_value:
            best = shorter
        else:
            i += 1
    return best, *cascade_score(patterns, best)
