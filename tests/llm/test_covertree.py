"""Embedding near-dedup against comparing all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from clausewright.llm import covertree
from clausewright.llm.covertree import Tree, forest, traverse

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=5, n=260, dims=8):
    """Clusters of several widths, exact and scaled copies, noise, a large tight group, and what links with nothing."""
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.normal(size=(12, dims))
    for i in range(n):
        v = rng.normal(size=dims) if i % 3 == 0 else centre[i % 12] + rng.normal(size=dims) * rng.choice([0.01, 0.2, 0.45])
        rows.append((1000 - i, v, int(i % 4 == 1)))
    tight = rng.normal(size=dims)
    rows += [(2000 + i, tight + rng.normal(size=dims) * 1e-3, 1) for i in range(90)]
    rows += [(3000 + i, rows[7][1], rows[7][2]) for i in range(6)] + [(3100, rows[7][1] * 4, rows[7][2]), (3101, rows[7][1], 9), (3102, -rows[7][1], rows[7][2])]
    rows = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    bad = [None, [], [0.0] * dims, [1.0] * (dims - 1) + [None], [float("nan")] * dims, [float("inf")] * dims, [1.0, 2.0], [2.0, 4.0]]
    rows += [(4000 + i, v, 0) for i, v in enumerate(bad)] + [(4100, rows[7][1], None), (4101, [0.0, -0.0, 1.0], 0), (4102, [0.0, 0.0, 2.0], 0), (None, rows[7][1], rows[7][2]), (3001, rows[0][1], rows[0][2])]
    return rows


def brute(rows, threshold=0.93):
    ok = [v is not None and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, k in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a, k) in enumerate(rows):
        for j in range(i):
            _, b, m = rows[j]
            if ok[i] and ok[j] and k == m and len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    order = lambda i: -(1 << 63) if rows[i][0] is None else rows[i][0]
    first = {}
    for i in sorted(range(len(rows)), key=order):
        first.setdefault(find(i), rows[i][0])
    return [(r[0], links[i], first[find(i)], r[0] == first[find(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 12])
def test_near_copies(spark, block):
    rows = vectors()
    got = [tuple(r) for r in covertree.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()]
    want = brute(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert max(x[1] for x in want) >= 89 and sum(x[1] > 0 for x in want) > 150


def test_other_names_types_and_empty(spark):
    rows = [("b", [1.0, 0.0], "k", 1), ("a", [1.0, 0.05], "k", 2), ("c", [0.0, 1.0], "k", 3), (None, [1e-200, 0.0], "k", 4), ("d", [1e200, 1e199], "k", 5)]
    docs = spark.createDataFrame(rows, "point string, grp array<double>, cell string, n int")
    got = sorted(map(tuple, covertree.near_copies(docs, "point", "grp", "cell").collect()), key=repr)
    assert got == sorted([("b", 3, None, False), ("a", 3, None, False), ("c", 0, "c", True), (None, 3, None, True), ("d", 3, None, False)], key=repr)
    assert covertree.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_levels():
    """Nested centres, halving radii, and covering radii that hold."""
    v = np.random.default_rng(1).normal(size=(300, 6))
    t = Tree(v)
    far = np.linalg.norm(t.unit[:, None] - t.unit[None], axis=2)
    for k in range(1, len(t.level)):
        assert set(t.centre[k - 1]) <= set(t.centre[k])
        assert (t.up[k][t.level[k]] == t.level[k - 1]).all()
        reach = far[t.centre[k][t.level[k]], np.arange(300)]
        assert (reach <= t.radius[k][t.level[k]] + 1e-7).all()
        if k < len(t.level) - 1:
            assert (reach <= 2.0 ** (1 - k) + 1e-7).all()
    again, more = Tree.load(t.dump(weight=np.arange(300)))
    assert (again.level[3] == t.level[3]).all() and more["weight"][7] == 7


@pytest.mark.parametrize("threshold", [0.5, 0.93, 0.999])
def test_traverse(threshold):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(150, 5)), rng.normal(size=(40, 5))
    b[:20] = a[:20] + rng.normal(size=(20, 5)) * 0.02
    wa, wb = rng.integers(1, 5, 150), rng.integers(1, 5, 40)
    sum_a, sum_b, root = traverse(Tree(a), Tree(b), wa, wb, threshold)
    link = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)) >= threshold
    assert (sum_a == link @ wb).all() and (sum_b == link.T @ wa).all()
    x, y = np.nonzero(link)
    assert (root == forest(190, x, 150 + y)).all()


def test_tight_cells_are_not_shipped(spark):
    """Cells that link as a whole are counted by their weights: no group compares their points."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.eye(6)[0] + rng.normal(size=6) * 1e-3], 0) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = covertree.near_copies(docs, block=10).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}
