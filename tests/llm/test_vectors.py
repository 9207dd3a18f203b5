"""Near-duplicate embeddings against brute force, and connected components."""

import random

import numpy as np
import pytest

from tidewell.llm import neardup_vectors
from tidewell.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", 0) for r in rows], SCHEMA)


def brute(rows, threshold=0.98):
    n = len(rows)
    good, units = [], []
    for _, v, label in rows:
        x = np.array([np.nan if a is None else a for a in v], np.float64) if v is not None else np.zeros(0)
        ok = label is not None and len(x) and np.isfinite(x).all() and x.any()
        good.append(bool(ok))
        units.append(x / np.sqrt((x * x).sum()) if ok else None)
    up, links = list(range(n)), [0] * n

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: (links[i], low[find(i)]) for i in range(n)}


@pytest.mark.parametrize("block", [512, 8])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(12):
                rows.append([float(x) for x in np.float32(base + rng.normal(size=16) * 0.12)])
    rows = [(i, v, i % 2 if i % 17 else 0) for i, v in enumerate(rows)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]  # copies
    got = {r["vec_id"]: r for r in neardup_vectors.near_vectors(frame(spark, rows), block=block).collect()}
    want = brute(rows)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1),
        (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1),
        (12, [1.0, 0.0], 2), (13, [-0.0, 1.0], 3), (14, [0.0, 1.0], 3),
    ]
    got = {r["vec_id"]: r for r in neardup_vectors.near_vectors(frame(spark, rows)).collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == brute(rows)
    assert got[1]["n_links"] == 2 and got[14]["component_id"] == 13 and got[4]["kept"]
    none = neardup_vectors.near_vectors(frame(spark, [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)])).collect()
    assert {(r["vec_id"], r["n_links"]) for r in none} == {(None, 0), (1, 0)}


def test_empty(spark):
    assert neardup_vectors.near_vectors(frame(spark, [])).collect() == []


def test_tables_keep_recall():
    for n in (10, 10_000, 10**9):
        bits, tables = neardup_vectors.tables_for(n, 0.98, 1e-4)
        same = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - same) ** tables <= 1e-4


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(200, i) for i in range(201, 300)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want
