"""Selectional preferences of slots over the classes of a lexical network.

The formulas follow the literature: selectional association (Resnik 1996) and class-based estimation (Clark and Weir 2002).
Split-sum is an assumption: a head's count is split over its synsets and summed up the hierarchy.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable


class Preferences:
    """Scores of (frame or predicate, slot, head) from head counts, the synsets of each head and the ancestors of each synset.

    A score is None for slots without counts and for heads without a synset."""

    def __init__(self, counts: dict[tuple[str, str, str], float], synsets: dict[str, Iterable[int]], ancestors: dict[int, Iterable[int]]):
        self.synsets = {w: tuple(sorted(s)) for w, s in synsets.items()}
        self.above = {s: (s, *sorted(set(ancestors.get(s, ())) - {s})) for w in self.synsets.values() for s in w}
        self.heads: dict[tuple[str, str], dict[str, float]] = defaultdict(dict)
        self.mass: dict[tuple[str, str], dict[int, float]] = defaultdict(lambda: defaultdict(float))
        self.total: dict[tuple[str, str], float] = defaultdict(float)
        self.all_mass: dict[str, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        self.all_total: dict[str, float] = defaultdict(float)
        for (p, slot, h), n in counts.items():
            self.heads[p, slot][h] = n
            if not self.synsets.get(h):
                continue
            self.total[p, slot] += n
            self.all_total[slot] += n
            for c, share in self._classes(h).items():
                self.mass[p, slot][c] += n * share
                self.all_mass[slot][c] += n * share

    def _classes(self, head: str) -> dict[int, float]:
        """Classes at or above the head's synsets with the share of the head that falls to them."""
        out: dict[int, float] = defaultdict(float)
        own = self.synsets.get(head, ())
        for s in own:
            for c in self.above[s]:
                out[c] += 1 / len(own)
        return out

    def _known(self, p: str, slot: str, head: str) -> dict[int, float] | None:
        return self._classes(head) if self.synsets.get(head) and self.total.get((p, slot)) else None

    def split_sum(self, p: str, slot: str, head: str) -> float | None:
        """How much larger the shares of the head's classes are in the slot than in general, on average."""
        classes = self._known(p, slot, head)
        if classes is None:
            return None
        shares = [self.mass[p, slot].get(c, 0.0) / self.total[p, slot] - self.all_mass[slot].get(c, 0.0) / self.all_total[slot] for c in sorted(classes)]
        return sum(shares) / len(shares)

    def association(self, p: str, slot: str, head: str) -> float | None:
        """Selectional association: the largest contribution of a class above the head to the slot's preference strength."""
        classes = self._known(p, slot, head)
        if classes is None:
            return None
        return max(self._contribution(p, slot, c) for c in classes)

    def _contribution(self, p: str, slot: str, c: int) -> float:
        given = self.mass[p, slot].get(c, 0.0) / self.total[p, slot]
        prior = self.all_mass[slot].get(c, 0.0) / self.all_total[slot]
        return given * math.log(given / prior) if given > 0 else 0.0

    def class_estimate(self, p: str, slot: str, head: str, threshold: float = 3.84) -> float | None:
        """Log ratio of the slot's to the general probability of the class that stands for the head: it is generalised
        upwards as long as the ratio doesn't change significantly (G² on one degree of freedom)."""
        classes = self._known(p, slot, head)
        if classes is None:
            return None
        mass, every, n, m = self.mass[p, slot], self.all_mass[slot], self.total[p, slot], self.all_total[slot]
        ratio = lambda c: ((mass.get(c, 0.0) + 0.5) / (n + 0.5)) / ((every.get(c, 0.0) + 0.5) / (m + 0.5))
        order = sorted(classes, key=lambda c: (every.get(c, 0.0), c))
        at = order[0]
        for c in order[1:]:
            low, high = (mass.get(at, 0.0), every.get(at, 0.0)), (mass.get(c, 0.0), every.get(c, 0.0))
            if _g2(low[0], low[1] - low[0], high[0] - low[0], (high[1] - low[1]) - (high[0] - low[0])) > threshold:
                break
            at = c
        return math.log(ratio(at))

    def scorers(self) -> dict[str, Callable]:
        """By the names that chooser specs use."""
        return {"selassoc": self.association, "clark": self.class_estimate, "splitsum": self.split_sum}

    def percentiles(self, p: str, slot: str, score: Callable) -> list[float]:
        """100 percentiles of the distinct scores of the slot's heads, ``[0.0]`` without any (O-77, O-78)."""
        found = sorted({x for h in self.heads.get((p, slot), {}) if (x := score(p, slot, h)) is not None})
        return [found[len(found) * i // 100] for i in range(100)] if found else [0.0]


def _g2(a: float, b: float, c: float, d: float) -> float:
    """Log-likelihood ratio of a table of two by two; negative cells, which rounding makes, count as 0."""
    cells = [max(0.0, x) for x in (a, b, c, d)]
    total = sum(cells)
    rows, cols = (cells[0] + cells[1], cells[2] + cells[3]), (cells[0] + cells[2], cells[1] + cells[3])
    return 2 * sum(x * math.log(x * total / (rows[i // 2] * cols[i % 2])) for i, x in enumerate(cells) if x > 0)
