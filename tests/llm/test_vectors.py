"""Embedding near duplicates against all pairs."""

import numpy as np
import pytest

from sitewright.llm.components import components
from sitewright.llm.vector_cells import near_duplicate_vectors


def brute(ids, vectors, threshold=0.95):
    usable = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if u else None for v, u in zip(vectors, usable)]
    links = [
        [j for j in range(len(ids)) if i != j and usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
        for i in range(len(ids))
    ]
    out = []
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((ids[i], len(links[i]), min((ids[j] for j in seen if ids[j] is not None), default=None)))
    return out


@pytest.mark.parametrize("options", [{}, {"cell": 20, "block": 16}])
def test_vector_cells(spark, options):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    vectors = [b + rng.normal(size=16) * 0.05 for b in base for _ in range(rng.integers(1, 6))]
    vectors += [base[0] + rng.normal(size=16) * 0.02 for _ in range(60)]
    vectors = [v.tolist() for v in vectors] + [vectors[0].tolist()] * 5 + [(2 * vectors[1]).tolist()]
    vectors += [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e300] * 16, [1e-300] * 16]
    ids = [10 + i for i in range(len(vectors))]
    rows = [(i, v, "x", 1) for i, v in zip(ids, vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, copies int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(table, **options).collect())
    want = brute(ids, vectors)
    assert len(got) == len(want)
    assert sum(n for _, n, _ in got) >= 0.99 * sum(n for _, n, _ in want)
    assert all(g[1] <= w[1] for g, w in zip(got, sorted(want)))
    if not options:
        assert got == sorted(want)


def test_vectors_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicate_vectors(table).count() == 0
    table = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    rows = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(table).collect()}
    assert rows == {(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
