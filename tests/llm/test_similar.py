"""Vector search against brute force, with copies, ties and unusable vectors."""

import numpy as np

from frameloom.llm.queries import p2_found
from frameloom.llm.similar import BLOCK_ROWS, Quantiser, most_similar

SF = "/root/testdata/sf0.01"


def brute(rows, sizes, k):
    out = {}
    for f, dim in sizes.items():
        use = [(i, np.array(v, float)) for i, g, v in rows if i is not None and g == f and v is not None and len(v) == dim and all(x is not None for x in v)]
        use = [(i, v / np.linalg.norm(v)) for i, v in use if np.isfinite(v).all() and v.any()]
        for i, v in use:
            near = sorted(((-round(float(v @ w), 9), j) for j, w in use if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_small_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 1, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + i, 1, [1.0] + [0.0] * 7) for i in range(9)] + [(200, 1, [0.99, 0.1] + [0.0] * 6)]
    rows += [(300, 2, [1.0, 2.0]), (301, 2, [2.0, 4.0]), (302, 2, [1.0, 2.1])]
    rows += [(400, 1, None), (401, 1, []), (402, 1, [0.0] * 8), (403, 1, [float("nan")] * 8), (404, 1, [1.0] * 7), (405, None, [1.0] * 8), (406, 9, [1.0] * 8), (None, 1, [1.0] * 8), (407, 1, [None] + [1.0] * 7)]
    vectors = spark.createDataFrame(rows, "id long, file int, vec array<float>").selectExpr("*", "1 as cell", "2 as cosine")
    files = spark.createDataFrame([(1, 8), (2, 2), (3, 4), (None, 8)], "file int, dim int")
    got = {}
    for r in most_similar(vectors, files, "id", "file", "vec", "dim").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["cosine"]))
    want = brute([(i, f, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, f, v in rows], {1: 8, 2: 2}, 5)
    assert set(got) == set(want)
    for i, near in want.items():
        assert np.allclose(sorted(s for _, s in got[i]), sorted(s for _, s in near), atol=1e-5), i
    assert {j for j, _ in got[105]} == {100, 101, 102, 103, 104}
    assert most_similar(vectors.limit(0), files, "id", "file", "vec", "dim").count() == 0


def test_recall(spark):
    x = spark.read.parquet(f"{SF}/word_vectors.parquet").collect()
    truth = brute([(r["word_id"], r["file_id"], r["vec"]) for r in x], {1: 80, 2: 80, 3: 96}, 5)
    want = {(min(i, j), max(i, j)) for i, near in truth.items() for j, s in near if s >= 0.8}
    got = {tuple(r) for r in p2_found(spark, SF).collect()}
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.99


def test_recall_with_many_cells(spark):
    """Neighbours of all cosines in a file of many cells, where a fixed number of searched cells loses most of them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8000, 20)).astype(np.float32)
    vectors = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id long, file int, vec array<float>")
    got = {}
    for r in most_similar(vectors, spark.createDataFrame([(1, 20)], "file int, dim int"), "id", "file", "vec", "dim").collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    some = rng.choice(len(x), 400, replace=False)
    cosines = unit[some] @ unit.T
    cosines[np.arange(400), some] = -2
    want = np.argsort(-cosines, axis=1)[:, :5]
    assert sum(j in got[i] for i, near in zip(some, want) for j in near) / want.size >= 0.97


def test_every_large_cell_is_split():
    q = Quantiser([np.eye(8, dtype=np.float32)], 1)
    x = np.repeat(np.eye(8, dtype=np.float32), 50, axis=0)
    q.calibrate(x[:0], x[:0], x, 4_000_000)
    assert len(q.blocks()) == 8 and all(n >= 4_000_000 / 8 / BLOCK_ROWS for n in q.blocks().values())
