import numpy as np
import pytest
from brute import components, frame

from tablescout.llm.vectors import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, cosine=0.98):
    def vector(r):
        v, label = r[1], r[2]
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, np.float32).astype(float)

    vs = [vector(r) for r in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if vs[i] is not None and vs[j] is not None and rows[i][2] == rows[j][2] and len(vs[i]) == len(vs[j]):
                if vs[i] @ vs[j] / np.sqrt(vs[i] @ vs[i]) / np.sqrt(vs[j] @ vs[j]) >= cosine:
                    pairs.append((i, j))
    n = np.bincount(np.array(pairs, int).ravel(), minlength=len(rows))
    root, least = components(range(len(rows)), pairs), {}
    for k, r in root.items():
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], int(n[k]), least.get(root[k]), rows[k][0] is not None and rows[k][0] == least.get(root[k])) for k in root), key=repr)


def cloud(n, dims, seed, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, n // 4), dims))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dims)) * rng.choice([0, 0.05, 0.12, 0.4], (n, 1))
    return [(i, [float(np.float32(v)) for v in row], int(i % labels)) for i, row in enumerate(x)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    a = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [nan, 1.0, 1.0], 1), (5, [inf, 1.0, 1.0], 1), (6, [None, 1.0, 1.0], 1), (7, a, None), (8, a, None),
        (9, a, 1), (10, a, 1), (11, [2.0, 4.0, 6.0], 1), (12, [-1.0, -2.0, -3.0], 1), (13, a, 2), (14, [1.0, 2.0], 1), (15, [1.0, 2.0], 1), (16, [1.0, 2.1, 3.0], 1),
        (17, a, 3), (17, a, 3), (None, a, 4), (None, a, 4), (18, a, 4), (None, [3.0, -1.0, 0.0], 4),
    ]
    df = frame(spark, [(*r, "x") for r in rows], SCHEMA + ", node string")
    assert got(near_vectors(df)) == expected(rows)
    assert near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("cell, cells", [(2048, 1024), (40, 1024), (25, 4), (8, 3)])
def test_cells_and_blocks_lose_no_link(spark, cell, cells):
    rows = cloud(400, 12, 7)
    assert got(near_vectors(frame(spark, rows, SCHEMA), cell=cell, cells=cells)) == expected(rows)


def test_chain_of_neighbours(spark):
    angle = np.arccos(0.985)
    rows = [(i, [float(np.cos(i * angle)), float(np.sin(i * angle))], 1) for i in range(30)]
    assert got(near_vectors(frame(spark, rows, SCHEMA), cell=5, cells=64)) == expected(rows)
