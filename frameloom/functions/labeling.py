"""Sequence labels: feature templates, label codecs, fillers, a linear-chain CRF, and the choice of labels to keep."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

import numpy as np

from frameloom.functions.attachment import CASES, VERB_POS, Word
from frameloom.functions.slots import QUESTION_WORDS

#: Lemmas that recover a label's conjunction, and lemmas of the ``nonch`` filler.
RECOVERED = {"iż": "że", "aby": "żeby", "gdy": "kiedy", "skoro": "ponieważ", "choć": "chociaż", "jeżeli": "jeśli"}
NONCH = frozenset(("coś", "nic", "co", "sporo", "wiele", "dużo", "mało", "niewiele", "trochę"))
#: How many tokens after ``jako`` count, and the labels that may not follow them.
JAKO_REACH, JAKO_STOPPERS = 5, ("subj", "np(mian)", "np(bier)", "np(dop)")
CASE_NAMES = {v: k for k, v in CASES.items()}

Label = tuple[str, float]


# --- codecs ------------------------------------------------------------------------------------------------------


def _parts(label: str) -> tuple[str, list[str]] | None:
    a, b = label.find("("), label.rfind(")")
    return (label[:a], [x.strip() for x in label[a + 1 : b].split(",")]) if 0 < a < b else None


class Codec:
    """Labels of some kinds with one argument blanked before training and filled from the word after prediction."""

    def __init__(self, kinds: tuple[str, ...], blank: int, fill: Callable[[Word], str], count: int, keep: tuple[str, ...] = ()):
        self.kinds, self.blank, self.fill, self.count, self.keep = kinds, blank, fill, count, keep

    def _change(self, label: str, value: str) -> str:
        found = _parts(label) if label.startswith(self.kinds) else None
        if not found or len(found[1]) != self.count or found[1][self.blank] in self.keep:
            return label
        args = list(found[1])
        args[self.blank] = value
        return f"{found[0]}({','.join(args)})"

    def simplify(self, word: Word, label: str) -> str:
        return self._change(label, "_")

    def recover(self, word: Word, label: str) -> str:
        return self._change(label, self.fill(word))


def _base(w: Word) -> str:
    return RECOVERED.get(w.base.strip(), w.base.strip())


def _case(w: Word) -> str:
    parts = w.ctag.split(":")
    return CASE_NAMES.get(parts[1], "unknown") if len(parts) > 1 else "unknown"


_PREP = ("prepnp", "prepadjp")
CODECS: dict[str, Codec] = {
    "p1": Codec(_PREP, 0, _base, 2), "p2": Codec(_PREP, 1, _case, 2), "q1": Codec(("prepadjp",), 0, _base, 2), "q2": Codec(("prepadjp",), 1, _case, 2),
    "s": Codec(("sentp",), 0, _base, 1, ("pz",)), "n": Codec(("np",), 0, _case, 1), "a": Codec(("adjp",), 0, _case, 1),
}
_ALIASES = {"prep": "p1"}


def codec(spec: str) -> list[Codec]:
    """Codecs of a comma-separated spec; ``identity`` (``i``) changes nothing."""
    names = [_ALIASES.get(x, x) for x in spec.lower().split(",") if x not in ("i", "identity")]
    if any(n not in CODECS for n in names):
        raise ValueError(f"unknown label codec in {spec!r}")
    return [CODECS[n] for n in names]


def simplify(codecs: list[Codec], word: Word, label: str) -> str:
    for c in codecs:
        label = c.simplify(word, label)
    return label


def recover(codecs: list[Codec], word: Word, label: str) -> str:
    for c in codecs:
        label = c.recover(word, label)
    return label


# --- fillers -----------------------------------------------------------------------------------------------------


def _open(labels: list[Label]) -> bool:
    return not any(x != "_" and p > 0.8 for x, p in labels)


def fill_questions(words: list[Word], labels: list[list[Label]]) -> list[list[Label]]:
    """Question words without a sure label and without a conjunction after them head a clause."""
    out = []
    for i, (w, own) in enumerate(zip(words, labels)):
        asks = w.base.lower() in QUESTION_WORDS or w.orth.lower() in QUESTION_WORDS
        joined = i + 1 < len(words) and words[i + 1].base in ("i", "również")
        out.append([("sentp(pz)", 9.0), (f"sentp({w.base})", 0.9)] if _open(own) and asks and not joined else own)
    return out


def fill_jako(words: list[Word], labels: list[list[Label]]) -> list[list[Label]]:
    """``jako`` with an adjective and no noun before the next stop (a verb, an unlabelled token, or the sixth token on) is prepadjp unless an object or subject
    stands at the stop, otherwise prepnp. Kinds up to each place are summed once, so a stretch is the difference of two sums."""
    n = len(words)
    top = [own[0][0] if own else "_" for own in labels]
    stops = [i for i in range(n) if top[i] == "_" or words[i].pos in VERB_POS]
    nouns, adjectives = (np.concatenate([[0], np.cumsum([w.ctag.startswith(kind) for w in words])]) for kind in ("subst", "adj"))
    out = []
    for i, own in enumerate(labels):
        if words[i].base != "jako" or not _open(own):
            out.append(own)
            continue
        later = bisect.bisect_right(stops, i)
        end = min(stops[later] if later < len(stops) else n, i + JAKO_REACH + 1, n)
        plain = adjectives[end] > adjectives[i + 1] and nouns[end] == nouns[i + 1] if end > i + 1 else False
        out.append([("prepadjp(jako,str)" if plain and not (end < n and top[end] in JAKO_STOPPERS) else "prepnp(jako,str)", 1.0)])
    return out


def fill_nonch(words: list[Word], labels: list[list[Label]]) -> list[list[Label]]:
    def is_nonch(i: int) -> bool:
        return words[i].base in NONCH or (words[i].base == "to" and i + 1 < len(words) and words[i + 1].base == "samo")

    return [[("nonch", 1.0), *own] if _open(own) and is_nonch(i) else own for i, own in enumerate(labels)]


def fill_siebie(words: list[Word], labels: list[list[Label]]) -> list[list[Label]]:
    return [[("refl", 1.0), *own] if w.orth.lower() == "siebie" else own for w, own in zip(words, labels)]


FILLERS: dict[str, Callable] = {"cp": fill_questions, "jako": fill_jako, "siebie": fill_siebie, "nonch": fill_nonch}


def keep_labels(words: list[Word], scored: list[list[Label]], keep: int = 2, threshold: float = 0.9, codecs: list[Codec] = (), fillers: tuple[str, ...] = ("cp", "jako", "nonch")) -> list[list[Label]]:
    """Labels to go on with: the top one alone where it is sure enough (that may be ``_``), else the best ``keep`` that are not
    ``_`` (if there are none, ``_``); then codecs are undone and the fillers run in order."""
    out = []
    for w, own in zip(words, scored):
        order = sorted(own, key=lambda x: -x[1])
        if order and order[0][1] > threshold:
            kept = order[:1]
        else:
            kept = [x for x in order if x[0] != "_"][:keep] or [("_", 1.0)]
        out.append([(recover(codecs, w, x), p) for x, p in kept])
    for name in fillers:
        out = FILLERS[name](words, out)
    return out


# --- linear-chain CRF --------------------------------------------------------------------------------------------


class Template:
    """Feature templates: ``U<id>:%x[row,col]`` joined by slashes, ``B`` for label pairs, ``#`` for comments."""

    def __init__(self, text: str):
        self.unigrams, self.bigram = [], False
        for line in text.splitlines():
            line = line.strip()
            if line.startswith("U"):
                name, _, rest = line.partition(":")
                self.unigrams.append((name, [(int(r), int(c)) for r, c in re.findall(r"%x\[(-?\d+),(\d+)\]", rest)]))
            elif line.startswith("B"):
                self.bigram = True

    def features(self, rows: list[list[str]], i: int) -> list[str]:
        at = lambda r, c: rows[r][c] if 0 <= r < len(rows) else f"_B{r if r < 0 else r - len(rows) + 1:+d}"
        return [name + ":" + "/".join(at(i + r, c) for r, c in cells) for name, cells in self.unigrams]


class ChainCRF:
    """A linear-chain CRF fitted by stochastic gradient with an L1 or L2 penalty; features are hashed into no table but kept by name."""

    def __init__(self, template: Template, labels: list[str], index: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.template, self.labels, self.index, self.weights, self.pairs = template, labels, index, weights, pairs

    @classmethod
    def train(cls, sentences: list[tuple[list[list[str]], list[str]]], template: str, min_freq: int = 1, cost: float = 1.0, rounds: int = 20, rate: float = 0.5, penalty: str = "l1", seed: int = 1) -> ChainCRF:
        """``sentences``: feature rows and gold labels. Minimised is the penalty plus ``cost`` times the loss: each round takes its step over ``cost`` off the weights (L1), or that share of them (L2)."""
        shape = Template(template)
        labels = sorted({x for _, gold in sentences for x in gold})
        counts: dict[str, int] = {}
        coded = [[shape.features(rows, i) for i in range(len(rows))] for rows, _ in sentences]
        for feats in coded:
            for f in (x for fs in feats for x in fs):
                counts[f] = counts.get(f, 0) + 1
        index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= min_freq))}
        made = cls(shape, labels, index, np.zeros((len(index), len(labels))), np.zeros((len(labels), len(labels))))
        gold = [np.array([labels.index(x) for x in g]) for _, g in sentences]
        data = [[np.array([index[f] for f in fs if f in index], int) for fs in feats] for feats in coded]
        rng = np.random.default_rng(seed)
        for r in range(rounds):
            step = rate / (1 + 0.2 * r)
            for s in rng.permutation(len(data)):
                if not len(gold[s]):
                    continue
                p, pp = made._marginals(made._scores(data[s]))
                for i, f in enumerate(data[s]):
                    delta = -p[i]
                    delta[gold[s][i]] += 1
                    made.weights[f] += step * delta
                if shape.bigram and len(gold[s]) > 1:
                    g = np.zeros_like(made.pairs)
                    np.add.at(g, (gold[s][:-1], gold[s][1:]), 1)
                    made.pairs += step * (g - pp)
            shrink = step / cost
            if penalty == "l1":
                made.weights = np.sign(made.weights) * np.maximum(np.abs(made.weights) - shrink, 0)
            else:
                made.weights *= 1 - min(1.0, shrink)
        return made

    def compact(self) -> ChainCRF:
        """The same model without features of no weight, in single precision."""
        kept = np.flatnonzero(self.weights.any(1))
        number = {old: new for new, old in enumerate(kept.tolist())}
        return ChainCRF(self.template, self.labels, {f: number[i] for f, i in self.index.items() if i in number}, self.weights[kept].astype(np.float32), self.pairs)

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of every label of every token, and the expected label pairs, by scaled forward and backward vectors."""
        n, k = len(scores), len(self.labels)
        local, step = np.exp(scores - scores.max(1, keepdims=True)), np.exp(self.pairs - self.pairs.max())
        fwd, bwd, scale = np.zeros((n, k)), np.ones((n, k)), np.ones(n)
        for i in range(n):
            row = local[i] if i == 0 else (fwd[i - 1] @ step) * local[i]
            scale[i] = max(row.sum(), 1e-300)
            fwd[i] = row / scale[i]
        for i in range(n - 2, -1, -1):
            bwd[i] = step @ (local[i + 1] * bwd[i + 1]) / scale[i + 1]
        pairs = step * (fwd[:-1].T @ (local[1:] * bwd[1:] / scale[1:, None]))
        return fwd * bwd, pairs

    def _scores(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum(0) if len(f) else np.zeros(len(self.labels)) for f in found], float)

    def predict(self, rows: list[list[str]]) -> list[list[Label]]:
        """Every label of every token with its marginal probability, the best first."""
        if not rows:
            return []
        found = [np.array([self.index[f] for f in self.template.features(rows, i) if f in self.index], int) for i in range(len(rows))]
        p, _ = self._marginals(self._scores(found))
        order = np.argsort(-p, axis=1, kind="stable")  # labels are in order of their names, which breaks ties
        return [[(self.labels[j], v) for j, v in zip(at, values)] for at, values in zip(order.tolist(), np.take_along_axis(p, order, 1).tolist())]
