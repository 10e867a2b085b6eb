"""Shredding, salted aggregation and hierarchies against brute force on small inputs."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from frameloom.functions.jsontext import NotJson, _loads_deep, loads
from frameloom.operators.hierarchy import clean_edges, cycle_members, hierarchy, root_levels
from frameloom.operators.shred import children, entities, shred
from frameloom.operators.skew import keys_with_share, salted_aggregate
from frameloom.plans import general

SF = "/root/testdata/sf0.001"


def test_json_deep_and_broken():
    deep = "[" * 100_000 + "1" + "]" * 100_000
    value = loads(deep)
    depth = 0
    while isinstance(value, list):
        value, depth = value[0], depth + 1
    assert depth == 100_000
    for text in ('{"a": [1, 2.5e3, "x\\u0142", null, true], "b": {}}', "[]", ' "s" ', "-1"):
        assert _loads_deep(text) == json.loads(text)
    for text in ("", "{", '{"a":1,}', "[1 2]", "NaN", '{"a" 1}', "[1]]", '"open'):
        with pytest.raises(NotJson):
            loads(text)
        with pytest.raises(NotJson):
            _loads_deep(text)


def test_shred_small(spark):
    text = '{"chunks": [{"number": "1", "chunkType": "np", "words": [3, "4"]}, null, {"number": 2, "words": 5}, {"note": {"ok": true}}], "tail": 1}'
    rows = [(1, text, "x"), (1, text, "x"), (2, text[:-1], "x"), (3, None, "x"), (None, '{"chunks": {"vp": {"number": 7}}}', "x"), (4, "", "x"), (5, '{"chunks": "[{\\"number\\": 9, \\"chunkType\\": \\"\\ud800\\"}]"}', "x")]
    df = spark.createDataFrame(rows, "k long, t string, rec string")
    nodes = shred(df, "k", ["t"], roots=["chunks"])
    found = entities(nodes, ["number", "chunkType"], needed="number", lists=("words",)).withColumn("type", F.coalesce("chunkType", "label"))
    assert found.count() == 4  # the repeated record came once
    got = {(r["key"], r["type"], r["number"]) for r in found.collect()}
    assert got == {(1, "np", "1"), (1, "chunks", "2"), (None, "vp", "7"), (5, "�", "9")}
    words = children(found, "words", ["type", "number"], "w")
    assert {(r["key"], r["number"], r["w"]) for r in words.collect()} == {(1, "1", "3"), (1, "1", "4"), (1, "2", "5")}
    assert shred(df.limit(0), "k", ["t"]).count() == 0


def _brute_p1(rows):
    out = set()

    def chunks(o, above, inside):
        if inside and isinstance(o, str) and o[:1] in "[{" and o:
            try:
                o = json.loads(o)
            except ValueError:
                return
        if isinstance(o, dict):
            if inside and o.get("number") is not None:
                kind = o.get("chunkType") or above
                yield kind, str(o["number"]), o.get("words")
            for k, v in o.items():
                yield from chunks(v, k, inside or k == "chunks")
        elif isinstance(o, list):
            for x in o:
                yield from chunks(x, above, inside)

    for r in rows:
        for i, w in enumerate(r["words"] or []):
            if w is not None:
                out.add((r["sent_id"], "word", "", str(i)))
        for a in r["argument_structures"] or []:
            for b in (a and a["args"]) or []:
                p, s = a["pred"], b and b["span"]
                if p and s and None not in (p["left_ix"], p["right_ix"], s["left_ix"], s["right_ix"]):
                    out.add((r["sent_id"], "argument", f"{p['left_ix']}-{p['right_ix']}", f"{s['left_ix']}-{s['right_ix']}"))
        try:
            tree = json.loads(r["ccl"] or "x")
        except ValueError:
            continue
        for kind, number, words in chunks(tree, None, False):
            out.add((r["sent_id"], "chunk", kind, number))
            for w in words if isinstance(words, list) else [] if words is None else [words]:
                out.add((r["sent_id"], "chunk_word", f"{kind}:{number}", str(w)))
    return out


def test_p1_found(spark):
    rows = spark.read.parquet(f"{SF}/sentences.parquet").collect()
    got = general.p1_found(spark, SF).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == _brute_p1(rows)


def test_salted_aggregate(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        k = rng.choice(["hot", "hot", "hot", None, "a", "b", f"k{i % 50}", ""])
        row = (k, None if i % 97 == 0 else i, rng.choice([0.0, 1.0, None, float("nan")]), "x")
        rows += [row] * rng.choice([1, 1, 1, 2])
    df = spark.createDataFrame(rows, "k string, id long, v double, salt string").repartition(3)
    want = defaultdict(dict)
    for k, i, v, _ in rows:
        if i is not None:
            want[k][i] = None if v is None or v != v else v
    got = {r["k"]: (r["n"], r["n_scored"], r["total"]) for r in salted_aggregate(df, "k", "id", "v").collect()}
    assert got == {k: (len(x), sum(v is not None for v in x.values()), sum(v for v in x.values() if v is not None) if any(v is not None for v in x.values()) else None) for k, x in want.items()}
    total = sum(map(len, want.values()))
    assert {r["k"] for r in keys_with_share(df, "k", "id", 0.1).collect()} == {k for k, x in want.items() if k is not None and len(x) >= 0.1 * total}
    assert salted_aggregate(df.limit(0), "k", "id", "v").count() == 0
    assert keys_with_share(df.limit(0), "k", "id", 0.1).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy(spark, seed):
    rng = random.Random(seed)
    ids = list(range(40))
    edges = [(rng.randrange(40), rng.randrange(44)) for _ in range(38)] + [(5, 5), (None, 1), (2, None)] + [(i, i + 1) for i in range(20, 38)]
    nodes = spark.createDataFrame([(i, "x") for i in ids + [3, None]], "id long, node string")
    h = hierarchy(nodes, spark.createDataFrame(edges * 2, "c long, p long"), "id", "c", "p", True)
    kept = {(c, p) for c, p in edges if c in ids and p in ids}
    up = defaultdict(set)
    for c, p in kept:
        up[c].add(p)
    dist = {}
    for n in ids:
        level, seen, k = set(up[n]), set(), 1
        while level - seen:
            for x in level - seen:
                dist[n, x] = k
            seen |= level
            level, k = {y for x in level for y in up[x]}, k + 1
    assert {(r["node"], r["ancestor"]): r["distance"] for r in h["pairs"].collect()} == dist
    tops = {i for i in ids if not up[i]}
    assert {(r["node"], r["root"]): r["depth"] for r in h["roots"].collect()} == {k: v for k, v in dist.items() if k[1] in tops}
    assert {r["node"]: r["cycle"] for r in h["cycles"].collect()} == {n: min(x for x in ids if (n, x) in dist and (x, n) in dist) for n in ids if (n, n) in dist}

    def smallest(a, b):
        if dist[a, b] == 1:
            return [b, a]
        return smallest(min(p for p in up[a] if (p, b) in dist and dist[p, b] == dist[a, b] - 1), b) + [a]

    levels = root_levels(clean_edges(spark.createDataFrame(edges, "c long, p long"), nodes, "c", "p", "id"), True, few_edges=0)
    assert sorted(levels.where("depth > 0").collect()) == sorted(h["roots"].collect())
    for r in h["roots"].collect():
        assert r["path"] == "/".join(map(str, smallest(r["node"], r["root"])))


@pytest.mark.parametrize("seed", (1, 3))
def test_cycles_of_dense_and_chained_graphs(spark, seed):
    """Cycles within cycles, chains between them, self-loops and trees, against reachability."""
    rng = random.Random(seed)
    n = 60
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range((40, 55, 70, 110)[seed])}
    for start in (100, 120):  # a cycle of 12 with a chain to the rest and one back
        ring = list(range(start, start + 12))
        rng.shuffle(ring)
        edges |= set(zip(ring, ring[1:] + ring[:1])) | {(ring[0], 200 + start), (200 + start, rng.randrange(n)), (rng.randrange(n), ring[5]), (ring[3], ring[8])}
    up = defaultdict(set)
    for c, p in edges:
        up[c].add(p)

    def above(x):
        seen, todo = set(), list(up[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += up[y]
        return seen

    reach = {x: above(x) for x in {v for e in edges for v in e}}
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in reach if x in reach[x]}
    for few in (0, 50_000):
        rows = cycle_members(spark.createDataFrame(sorted(edges), "child long, parent long"), few).collect()
        assert len(rows) == len(want) and {r["node"]: r["cycle"] for r in rows} == want


def test_long_cycle(spark):
    """A cycle of 100,000 nodes, with a tree below it, comes out as one row per node."""
    ring = spark.range(100_000).select((F.col("id") * 7 + 5).alias("child"), (((F.col("id") + 1) % 100_000) * 7 + 5).alias("parent"))
    tree = spark.range(1000).select((F.col("id") + 1_000_000).alias("child"), (F.col("id") * 7 + 5).alias("parent"))
    rows = cycle_members(ring.unionByName(tree))
    assert rows.agg(F.count(F.lit(1)), F.countDistinct("node"), F.min("cycle"), F.max("cycle")).first()[:] == (100_000, 100_000, 5, 5)


def test_hierarchy_empty(spark):
    nodes = spark.createDataFrame([], "id long")
    h = hierarchy(nodes, spark.createDataFrame([], "c long, p long"), "id", "c", "p")
    assert all(x.count() == 0 for x in h.values())
