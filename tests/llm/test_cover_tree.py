"""Near-duplicate vectors against all pairs."""

import random

import numpy as np
import pytest

from tallyhouse.llm import cover_tree
from tallyhouse.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def clouds(seed, n, dim, spread):
    """Vectors around a few directions, at many distances, with copies."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, dim))
    x = heads[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.choice(spread, (n, 1))
    x[rng.integers(0, n, n // 10)] = x[0]
    return x


def brute(rows, threshold=0.95):
    """(id, links, component, kept) of each row, by all pairs."""

    def vector(v):
        if v is None or not len(v) or any(c is None for c in v):
            return None
        x = np.array(v, np.float64)
        return x if np.isfinite(x).all() and x.any() else None

    x = [vector(v) for _, v in rows]
    linked = [[] for _ in rows]
    for i, u in enumerate(x):
        for j in range(i + 1, len(x)):
            v = x[j]
            if u is not None and v is not None and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                linked[i].append(j)
                linked[j].append(i)
    component = [None] * len(rows)
    for i in range(len(rows)):
        if component[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in linked[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            for j in seen:
                component[j] = (least,)
    return sorted(((i, len(linked[k]), component[k][0], component[k][0] == i) for k, (i, _) in enumerate(rows)), key=repr)


def awkward(n):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [nan] * 8, [inf] + [1.0] * 7, [None] * 8, [-0.0] * 8, [1.0], [3.0], [-1.0], [1e-30] + [0.0] * 7, [1e30] + [0.0] * 7]
    return [(n + i, v) for i, v in enumerate(vectors + vectors)]


def awkward_rows(seed=1):
    x = clouds(seed, 260, 8, [0.01, 0.1, 0.3, 2.0]).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + awkward(1000)
    return rows + [(None, rows[3][1]), (None, None), (5, rows[5][1]), (7, rows[9][1])]


@pytest.mark.parametrize("tree_nodes", [8192, 40])
def test_all_pairs(spark, tree_nodes):
    rows = awkward_rows()
    random.Random(2).shuffle(rows)
    made = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    made = made.withColumnsRenamed({"label": "key"})
    got = cover_tree.near_duplicates(made, tree_nodes=tree_nodes).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert max(r.n_links for r in got) > 25 and len({r.component_id for r in got}) > 20


def test_doubles_and_another_threshold(spark):
    x = clouds(4, 200, 3, [0.001, 0.05, 0.2])
    rows = [(str(i), (v * 10.0 ** (i % 400 - 200)).tolist()) for i, v in enumerate(x)]
    made = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    scaled = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    assert sorted(map(tuple, cover_tree.near_duplicates(made, 0.8, tree_nodes=30).collect()), key=repr) == brute(scaled, 0.8)


def test_empty_table(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("dense", [0, 16, 10**9])
@pytest.mark.parametrize("dim,spread", [(2, [0.01, 0.3]), (5, [0.001, 0.02, 0.1]), (40, [0.01, 0.05, 1.0])])
def test_walks(dim, spread, dense, monkeypatch):
    """Two trees, and each with itself, for many shapes and both kinds of products; the tree's own rules."""
    monkeypatch.setattr(cover_tree, "DENSE", dense)
    monkeypatch.setattr(cover_tree, "PAIRS", 500)
    for seed in range(6):
        x = cover_tree.units(clouds(seed, 300, dim, spread))
        n = [170, 130]
        grown, weights, points = [], [], []
        for part in (x[: n[0]], x[n[0] :]):
            order, table = cover_tree.Tree.grow(part)
            tree = cover_tree.Tree(part[order], table)
            assert sorted(order.tolist()) == list(range(len(part)))
            for k in range(len(tree.center)):
                near = np.sqrt(np.maximum(0, 2 - 2 * tree.points[tree.low[k] : tree.high[k]] @ tree.points[tree.center[k]]))
                assert abs(near.max() - tree.radius[k]) < 1e-6 and tree.low[k] <= tree.center[k] < tree.high[k]
                kids = range(tree.child[k], tree.end[k])
                assert not kids or (tree.low[kids[0]], tree.high[kids[-1]]) == (tree.low[k], tree.high[k]) and tree.center[k] in tree.center[kids]
            grown.append(tree)
            points.append(part[order])
            weights.append(np.arange(len(part)) % 3 + 1)
        for a, b in ((0, 1), (0, 0), (1, 1)):
            ids = [0] if a == b else [a, b]
            raw = points[a] if a == b else np.concatenate([points[a], points[b]])
            weight = weights[a] if a == b else np.concatenate([weights[a], weights[b]])
            links = cover_tree.walk(grown[a], grown[b], weight, raw, 0.95)
            near = raw @ raw.T >= 0.95
            np.fill_diagonal(near, False)
            if a != b:
                near[: n[0], : n[0]] = near[n[0] :, n[0] :] = False
            assert links.linked.tolist() == (near @ weight).tolist(), (seed, ids)
            label = np.arange(len(raw))
            for _ in range(len(raw)):
                label = np.minimum(label, np.where(near, label, len(raw)).min(axis=1))
            assert links.label.tolist() == label.tolist()


def test_query(spark, tmp_path):
    rows = [(i, v) for i, v in awkward_rows(9) if v is None or len(v) == 8]
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op13_cover_tree"](spark, str(tmp_path))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)
