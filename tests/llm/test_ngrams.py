"""Suffix-sorted counting against brute force."""

import random
from collections import defaultdict

import pytest

from frameloom.llm.ngrams import SuffixStack, ngram_counts


def brute(rows, max_len):
    every, at = defaultdict(set), defaultdict(dict)
    alone = []
    for g, r, p, t in rows:
        if not t:
            continue
        if r is None or p is None:
            alone.append((g, r, t))
        else:
            every[g, r, p].add(t)
            at[g, r][p] = min(every[g, r, p])
    counts, records = defaultdict(int), defaultdict(set)
    for (g, r), terms in at.items():
        for p in terms:
            for n in range(1, max_len + 1):
                run = tuple(terms.get(p + i) for i in range(n))
                if None not in run:
                    counts[g, run] += 1
                    records[g, run].add(r)
    for (g, r, p), terms in every.items():  # the others of a place count by themselves
        for t in terms - {min(terms)}:
            counts[g, (t,)] += 1
            records[g, (t,)].add(r)
    for g, r, t in alone:
        counts[g, (t,)] += 1
        if r is not None:
            records[g, (t,)].add(r)
    return {k: (n, len(records[k])) for k, n in counts.items()}


@pytest.mark.parametrize("max_len,shard_rows", [(1, 200_000), (1, 40), (3, 200_000), (3, 40)])
def test_ngram_counts(spark, max_len, shard_rows):
    rng = random.Random(max_len)
    rows = []
    for r in range(60):
        for p in range(rng.choice([0, 1, 5, 30])):
            if rng.random() < 0.9:
                row = (rng.choice("xy") if max_len == 1 else "x", r, p, rng.choice(["a", "a", "a", "b", "c", "ż", "", None, "a b"]))
                rows += [row] * rng.choice([1, 1, 2])
    rows += [("x", None, 1, "a"), ("x", None, 1, "a"), ("x", 3, None, "q"), ("x", 7, 0, "long" * 5000)]
    df = spark.createDataFrame(rows, "g string, rec long, pos int, term string").repartition(3)
    got = {(r["g"], tuple(r["ngram"])): (r["n"], r["n_records"]) for r in ngram_counts(df, "rec", "pos", "term", max_len, ("g",), shard_rows).collect()}
    if max_len == 1:
        want = defaultdict(lambda: [set(), 0, set()])
        for i, (g, r, p, t) in enumerate(rows):
            if t:
                w = want[g, (t,)]
                w[0].add((r, p) if None not in (r, p) else i)
                if r is not None:
                    w[2].add(r)
        assert got == {k: (len(w[0]), len(w[2])) for k, w in want.items()}
    else:
        assert got == brute(rows, max_len)


def test_ngram_counts_empty(spark):
    df = spark.createDataFrame([], "rec long, pos int, term string, ngram string")
    assert ngram_counts(df, "rec", "pos", "term", 2).count() == 0


def test_stack_order():
    stack = SuffixStack(True)
    out = []
    for suffix, rec in ((["b"], 1), (["a", "c"], 2), (["a", "b"], 1), (["a", "b"], 2), (["a"], 3)):
        out += stack.add(suffix, rec)
    out += stack.cut_to(0)
    assert out == [(["b"], 1, 1), (["a", "c"], 1, 1), (["a", "b"], 2, 2), (["a"], 4, 3)]
