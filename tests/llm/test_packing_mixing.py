"""Packing against exhaustive search, mixing against its own rules."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import mixing
from frameloom.llm.packing import best_fill, pack, pack_block
from frameloom.llm.tokens import token_counts


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 45), max_size=9))
def test_best_fill_is_optimal(room, items):
    counts = Counter(items)
    taken = best_fill(room, sorted(counts, reverse=True), counts)
    assert all(n <= counts[x] for x, n in taken.items())
    best = max((s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= room), default=0)
    assert sum(x * n for x, n in taken.items()) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=40), st.integers(1, 30))
def test_pack_block(sizes, capacity):
    boxes = pack_block(sizes, capacity)
    pieces = defaultdict(list)
    for box in boxes:
        assert sum(x[3] for x in box) <= capacity and box
        for i, p, s, n in box:
            pieces[i].append((p, s, n))
    assert sorted(pieces) == list(range(len(sizes)))
    for i, size in enumerate(sizes):
        parts = sorted(pieces[i])
        assert sum(n for _, _, n in parts) == size and [p for p, _, _ in parts] == list(range(len(parts)))
        assert all(a[1] + a[2] == b[1] for a, b in zip(parts, parts[1:]))
        assert len(parts) == (1 if size <= capacity else math.ceil(size / capacity))


def test_pack_table(spark):
    rng = random.Random(2)
    rows = [(i % 400, rng.randrange(1, 90), "x") for i in range(500)] + [(None, 5, "x"), (7, None, "x"), (8, 1000, "x"), (9, 0, "x")]
    df = spark.createDataFrame(rows, "id long, n long, block string")
    out = pack(df, "id", "n", [("a", 100), ("b", 333)], block_items=150).collect()
    for name, capacity in (("a", 100), ("b", 333)):
        mine = [r for r in out if r["profile"] == name]
        filled = Counter()
        for r in mine:
            filled[r["container"]] += r["length"]
        assert all(filled[r["container"]] == r["filled"] <= capacity for r in mine)
        assert sum(filled.values()) == sum(r[1] or 0 for r in rows)
        assert Counter(r["id"] for r in mine if r["piece"] == 0) == Counter(r[0] for r in rows)
        assert sum(filled.values()) / len(filled) / capacity > 0.9
    assert pack(df.limit(0), "id", "n", [("a", 10)]).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "ala ma kota " * 5000)], "n_tokens long, text string")
    got = [r[1] for r in token_counts(df.withColumnRenamed("n_tokens", "k"), "text", ["k"]).orderBy("k").collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1 and got[4] >= 15000


def test_weights():
    sizes = {"a": 1000.0, "b": 100.0, "c": 10.0, "d": 0.0}
    targets = {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}
    caps = {"a": 1, "b": 2, "c": 4, "d": None}
    weights, total, exponent = mixing.plan_weights(sizes, targets, caps)
    assert exponent == pytest.approx(1, abs=1e-6) and weights == pytest.approx({"a": 5 / 9, "b": 3 / 9, "c": 1 / 9}) and total == pytest.approx(360)
    weights, total, exponent = mixing.plan_weights(sizes, targets, caps, 900.0)
    assert 0 < exponent < 1 and total == pytest.approx(900) and all(total * w <= caps[s] * sizes[s] * (1 + 1e-6) for s, w in weights.items())
    assert mixing.plan_weights({}, targets, caps) == ({}, 0.0, 1.0)
    held = {"a": 70.0, "b": 20.0, "c": 10.0}
    x = mixing.exponent_for_entropy(held, 0.95)
    assert mixing.entropy(mixing.tempered({s: n / 100 for s, n in held.items()}, x)) == pytest.approx(0.95)
    assert mixing.tempered({"a": 0.5, "b": 0.5}, 0) == {"a": 0.5, "b": 0.5}


@pytest.mark.parametrize("block", [4096, 16])
def test_mix(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_RECORDS", block)
    rng = random.Random(4)
    rows = [(i, rng.choice(["big"] * 6 + ["mid"] * 3 + ["small", None, "other"]), rng.choice([None, 0] + list(range(1, 40))), "x") for i in range(1500)]
    rows += rows[:50] + [(None, "big", 5, "x")]
    df = spark.createDataFrame(rows, "id long, source string, n int, uses string").repartition(3)
    targets = [("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 5), ("none", 0.1, None)]
    chosen, report = mixing.mix(df, "id", "source", "n", targets)
    chosen, report = chosen.collect(), {r["source"]: r for r in report.collect()}
    caps = {"big": 1, "mid": 2, "small": 5}
    assert len({r["id"] for r in chosen}) == len(chosen) and all(1 <= r["uses"] <= caps[r["source"]] for r in chosen)
    taken = Counter()
    for r in chosen:
        taken[r["source"]] += r["size"] * r["uses"]
    for s, want in (("big", 4 / 9), ("mid", 3 / 9), ("small", 2 / 9)):
        assert report[s]["taken"] == taken[s] and abs(taken[s] / sum(taken.values()) - want) < 0.01
        assert report[s]["budget"] - 40 < taken[s] <= report[s]["budget"]
    assert report["none"]["share"] == 0 and set(report) == {"big", "mid", "small", "none"}
    assert all(report[s]["unused"] == report[s]["available"] - sum(r["size"] for r in chosen if r["source"] == s) for s in report)
    total = float(sum({r[0]: r[2] for r in rows if r[0] is not None and r[1] in caps and r[2]}.values()))
    caps = {"big": 2, "mid": 2, "small": 1}
    whole, limited = mixing.mix(df, "id", "source", "n", [(s, w, caps.get(s)) for s, w, _ in targets], total)
    limited = {r["source"]: r for r in limited.collect()}
    assert 0 <= limited["big"]["exponent"] < 0.999 and all(r["uses"] <= caps[r["source"]] for r in whole.collect())
    assert sum(r["taken"] for r in limited.values()) > 0.97 * total
    empty, report = mixing.mix(df.limit(0), "id", "source", "n", targets)
    assert empty.count() == 0 and report.count() == 4
