"""Near-duplicate vectors: cover trees walked in pairs.

Vectors are taken to the unit sphere, where a cosine c is the distance
``sqrt(2 - 2 c)``. Equal vectors are one node with a weight. Nodes are dealt to
regions, by the nearest of a few centers, and regions with many nodes to parts;
each part becomes one *cover tree* in a task of its own. Level i of a tree has
centers more than 2 ** (1 - i) apart below one parent, every point lies within
that radius of its center, a center is its own first child, and every tree
node knows the exact distance of its farthest point.

Two trees are walked together from their roots. A pair of tree nodes is left
if the distance of its centers exceeds both radii and the threshold's distance;
if the distance and both radii together do not exceed it, all their points are
linked at once; else the pair of their children is looked at, as one matrix
product for all of them. At the leaves the cosine itself decides. Where many
points are far from each other, as in many dimensions, a root has many
children and that product is most of the work.

Pairs of regions too far apart are never dealt, by the same bound. Each pair of
trees is a group of two rows with a bounded number of points, and what leaves
its task is a row for each linked point, with the first of its component
there, never one for each link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dedup, scratch

#: Nodes and bytes of a tree, about.
TREE_NODES, TREE_BYTES = 8192, 32 << 20
#: The most regions; their centers are taken from a sample of SAMPLE nodes for each.
REGIONS, SAMPLE = 256, 4
#: Points closer than this to a center are a leaf's, in a row.
LEAF_RADIUS = 2.0**-6
#: Rows and columns of a matrix product; links that are gathered before they are merged.
ROWS, COLUMNS, EDGES = 1024, 4096, 1 << 20
#: Radii at which blocks of nodes are cut.
RADII = [0.0, *(2.0**-i for i in range(6, -1, -1))]
#: A product of all children is taken unless it has so many times the cells needed; else so many cells at a time.
DENSE, PAIRS = 16, 1 << 16
#: More than rounding can change a cosine or a distance by.
SLACK = 1e-6


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of finite, nonzero vectors as unit vectors in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with that of y, summed in one order whatever the blocks."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def net(x: np.ndarray, first: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centers more than ``radius`` apart that cover all points, each point's center, and its cosine with that.

    ``first`` is the first center; the others are taken in the points' order.
    """
    limit = 1 - radius * radius / 2
    best, owner, centers, n = x @ x[first], np.zeros(len(x), np.int64), [np.array([first])], 1
    best[first] = 1.0
    todo = np.flatnonzero(best < limit)
    while len(todo):
        block = todo[:256]
        inner = x[block] @ x[block].T
        free, picked = np.ones(len(block), bool), []
        for i in range(len(block)):
            if free[i]:
                picked.append(i)
                free &= inner[i] < limit
        new = block[picked]
        near = x[todo] @ x[new].T
        top = near.argmax(axis=1)
        value = near[np.arange(len(todo)), top]
        closer = value > best[todo]
        owner[todo[closer]], best[todo[closer]] = n + top[closer], value[closer]
        owner[new], best[new] = n + np.arange(len(new)), 1.0
        centers.append(new)
        n += len(new)
        todo = todo[best[todo] < limit]
    return np.concatenate(centers), owner, best


class Tree:
    """A cover tree over unit vectors, its points in the tree's order.

    ``center``, ``radius``, ``low`` and ``high`` (its points), ``child`` and
    ``end`` (its children) are of the nodes, level by level, the root first.
    """

    def __init__(self, points: np.ndarray, nodes: np.ndarray):
        self.points, self.single = points, points.astype(np.float32)
        self.center, self.low, self.high, self.child, self.end = nodes[:5].astype(np.int64)
        self.radius = nodes[5]

    @staticmethod
    def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the points and the table of nodes."""
        order = np.arange(len(points))
        far = float(_chord(np.min(points @ points[0])))
        nodes = [[0, 0, len(points), 0, 0, far]]  # centers as numbers of points in the order given, until the end
        level, radius = [0], 1.0
        while level:
            following = []
            for k in level:
                center, low, high, _, _, reach = nodes[k]
                if high - low < 2 or reach <= LEAF_RADIUS:
                    continue
                if reach <= radius:  # the center alone covers all: the next level decides
                    following.append(k)
                    continue
                own = order[low:high].copy()
                x = points[own]
                centers, owner, best = net(x, int(np.flatnonzero(own == center)[0]), radius)
                by = np.argsort(owner, kind="stable")
                order[low:high] = own[by]
                cut = low + np.searchsorted(owner[by], np.arange(len(centers) + 1))
                least = np.minimum.reduceat(best[by], cut[:-1] - low)
                nodes[k][3:5] = len(nodes), len(nodes) + len(centers)
                following += range(len(nodes), len(nodes) + len(centers))
                nodes += [[int(own[c]), a, b, 0, 0, r] for c, a, b, r in zip(centers, cut[:-1].tolist(), cut[1:].tolist(), _chord(least).tolist())]
            level, radius = following, radius / 2
        table = np.array(nodes, np.float64).T.copy()
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        table[0] = place[table[0].astype(np.int64)]
        return order, table


class Links:
    """Links between points: the weight linked to each, and components."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.linked = weights.astype(np.float64), np.zeros(len(weights))
        self.label = np.arange(len(weights))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.linked += np.bincount(u, self.weights[v], len(self.label)) + np.bincount(v, self.weights[u], len(self.label))
        self.join(u, v)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        self.waiting.append((u, v))
        self.held += len(u)
        if self.held > EDGES:
            self.merge()

    def merge(self) -> None:
        """Labels of components: the smallest point of each."""
        if not self.waiting:
            return
        u, v = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.held = [], 0
        while True:
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                return
            u, v = u[apart], v[apart]
            np.minimum.at(self.label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(again := self.label[self.label], self.label):
                self.label = again


def walk(a: Tree, b: Tree, weights: np.ndarray, raw: np.ndarray, threshold: float) -> Links:
    """All links between the points of two trees, or in one if ``a is b``.

    Points of b are numbered after those of a; ``weights`` and ``raw`` have
    them in this order. A tree's own copies of a point are not links here.
    """
    same, shift = a is b, 0 if a is b else len(a.points)
    links, eps = Links(weights), math.sqrt(2 - 2 * threshold)
    total = np.r_[0.0, np.cumsum(links.weights)]
    solid: set[tuple[int, int]] = set()

    def all_linked(i: np.ndarray, j: np.ndarray) -> None:
        """All points of tree nodes i with all of j; a node with itself: its points with each other."""
        edge = np.zeros(len(weights) + 1)
        il, ih, jl, jh = a.low[i], a.high[i], b.low[j] + shift, b.high[j] + shift
        for low, high, weight, other in ((il, ih, total[jh] - total[jl], j != i), (jl, jh, total[ih] - total[il], np.ones(len(j), bool))):
            other = other | (not same)
            np.add.at(edge, low[other], weight[other])
            np.add.at(edge, high[other], -weight[other])
        links.linked += np.cumsum(edge[:-1])
        itself = np.flatnonzero((i == j) & same)
        for k in i[itself].tolist():
            links.linked[a.low[k] : a.high[k]] -= links.weights[a.low[k] : a.high[k]]
        links.join(a.center[i], b.center[j] + shift)
        solid.update(zip(il.tolist(), ih.tolist()))
        solid.update(zip(jl.tolist(), jh.tolist()))

    def compare(x: np.ndarray, y: np.ndarray, upper: bool) -> None:
        """Points x of a with points y of b; with ``upper`` only those before."""
        for r in range(0, len(x), ROWS):
            for c in range(0, len(y), COLUMNS):
                u, v = x[r : r + ROWS], y[c : c + COLUMNS]
                if upper and v[-1] <= u[0]:
                    continue
                product = a.points[u] @ b.points[v].T
                i, j = np.nonzero(product >= threshold - SLACK)
                close = product[i, j] < threshold + SLACK
                u, v = u[i], v[j] + shift
                good = ~close
                good[close] = cosines(raw[u[close]], raw[v[close]]) >= threshold
                if upper:
                    good &= v > u
                if good.any():
                    links.add(u[good], v[good])

    def judge(k: np.ndarray, m: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settle pairs of tree nodes; those left need their children looked at."""
        far, reach, itself = _chord(cosine), a.radius[k] + b.radius[m], (k == m) & same
        inside = np.where(itself, reach, far + reach) + SLACK <= eps
        inside &= ~itself | (a.high[k] - a.low[k] > 1)
        if inside.any():
            all_linked(k[inside], m[inside])
        open_ = (far <= reach + eps + SLACK) & ~inside
        k, m, cosine = k[open_], m[open_], cosine[open_]
        points = (a.high[k] - a.low[k] == 1) & (b.high[m] - b.low[m] == 1)
        if points.any():
            one, two = a.center[k[points]], b.center[m[points]] + shift
            good = cosine[points] >= threshold + SLACK
            good[~good] = cosines(raw[one[~good]], raw[two[~good]]) >= threshold
            good &= one != two
            links.add(one[good], two[good])
        k, m = k[~points], m[~points]
        leaves = (a.child[k] == a.end[k]) & (b.child[m] == b.end[m])
        for i, j in zip(k[leaves].tolist(), m[leaves].tolist()):
            compare(np.arange(a.low[i], a.high[i]), np.arange(b.low[j], b.high[j]), same and i == j)
        return k[~leaves], m[~leaves]

    def near_pairs(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and cosines of all pairs of tree nodes with a cosine of ``least`` or more, and perhaps a few more.

        The product is taken in single precision, with room for its rounding; what it leaves is computed in double.
        """
        room = 1.2e-7 * (a.points.shape[1] + 2)
        p, q = np.nonzero(a.single[a.center[x]] @ b.single[b.center[y]].T >= np.float32(least - room))
        if 8 * len(p) > len(x) * len(y):
            return p, q, (a.points[a.center[x]] @ b.points[b.center[y]].T)[p, q]
        cut = range(0, len(p), PAIRS)
        exact = [np.einsum("ij,ij->i", a.points[a.center[x[p[c : c + PAIRS]]]], b.points[b.center[y[q[c : c + PAIRS]]]]) for c in cut]
        return p, q, np.concatenate([np.zeros(0), *exact])

    def alike(radius: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Places of nodes in blocks of like radius, since the largest of a block bounds what the block leaves."""
        order = np.argsort(radius, kind="stable")
        cut = [0, *np.searchsorted(radius[order], RADII, side="right").tolist(), len(order)]
        for low, high in zip(cut, cut[1:]):
            for c in range(low, high, most):
                yield order[c : min(high, c + most)]

    def children(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Children of tree nodes, a leaf being its own, with places of their parents; and how many each has."""
        leaf = tree.child[nodes] == tree.end[nodes]
        first, n = np.where(leaf, nodes, tree.child[nodes]), np.where(leaf, 1, tree.end[nodes] - tree.child[nodes])
        parent = np.repeat(np.arange(len(nodes)), n)
        return first[parent] + np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n), parent, n

    k, m = judge(np.array([0]), np.array([0]), a.points[a.center[:1]] @ b.points[b.center[0]])
    while len(k):
        left, of_left = np.unique(k, return_inverse=True)
        right, of_right = np.unique(m, return_inverse=True)
        (u, up, un), (v, vp, vn) = children(a, left), children(b, right)
        following = []
        many = un[of_left] * vn[of_right]
        if len(u) * len(v) <= DENSE * many.sum():
            # most pairs are open: one product of all children, in blocks of like radius
            opened = np.zeros((len(left), len(right)), bool)
            opened[of_left, of_right] = True
            columns = list(alike(b.radius[v], COLUMNS))
            for i in alike(a.radius[u], ROWS):
                for j in columns:
                    reach = eps + a.radius[u[i]].max() + b.radius[v[j]].max() + SLACK
                    p, q, cosine = near_pairs(u[i], v[j], 1 - reach * reach / 2 if reach < 2 else -2.0)
                    x, y = u[i[p]], v[j[q]]
                    keep = opened[up[i[p]], vp[j[q]]]
                    if same:
                        keep &= (left[up[i[p]]] != right[vp[j[q]]]) | (x <= y)
                    following.append(judge(x[keep], y[keep], cosine[keep]))
        else:
            start_u, start_v = np.cumsum(un) - un, np.cumsum(vn) - vn
            cells, r = np.r_[0, np.cumsum(many)], 0
            while r < len(k):
                end = max(r + 1, int(np.searchsorted(cells, cells[r] + PAIRS, side="right")) - 1)
                of = np.repeat(np.arange(r, end), many[r:end])
                place = np.arange(len(of)) - np.repeat(cells[r:end] - cells[r], many[r:end])
                wide = vn[of_right[of]]
                x, y = u[start_u[of_left[of]] + place // wide], v[start_v[of_right[of]] + place % wide]
                if same:
                    keep = (k[of] != m[of]) | (x <= y)
                    x, y = x[keep], y[keep]
                following.append(judge(x, y, np.einsum("ij,ij->i", a.points[a.center[x]], b.points[b.center[y]])))
                r = end
        k, m = (np.concatenate(x) for x in zip(*following))
    for low, high in solid:
        if high - low > 1:
            links.join(np.arange(low, high - 1), np.arange(low + 1, high))
    links.merge()
    return links


def _read(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, key and raw bytes of every row; no key for a vector that links with nothing."""
    kind = dict(vectors.dtypes)[vector_col]
    single = kind == "array<float>"
    number = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.cast(pa.float32() if single else pa.float64()).fill_null(float("nan"))
            x = values.to_numpy(zero_copy_only=False).astype(number) + number(0)
            bad = np.r_[0, np.cumsum(~np.isfinite(x))]
            full = np.r_[0, np.cumsum(x != 0)]
            good = (bad[at[1:]] == bad[at[:-1]]) & (full[at[1:]] > full[at[:-1]]) & ~lists.is_null().to_numpy(zero_copy_only=False)
            raw = [x[p:q].tobytes() if ok else None for p, q, ok in zip(at[:-1].tolist(), at[1:].tolist(), good.tolist())]
            key = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "raw"])

    cast = vectors[vector_col] if single else vectors[vector_col].cast("array<double>")
    picked = vectors.select(vectors[id_col].alias("id"), cast.alias("v"))
    return picked.mapInArrow(run, f"id {dict(vectors.dtypes)[id_col]}, key binary, raw binary")


def _centers(nodes: DataFrame, number: type, tree_nodes: int) -> dict[int, np.ndarray]:
    """By vector size, centers of regions: a net of the nodes with the smallest keys, as coarse as it can be."""
    regions = min(REGIONS, -(-nodes.count() // tree_nodes))
    by_size: dict[int, list[np.ndarray]] = {}
    for r in nodes.orderBy("key").limit(SAMPLE * regions).collect():
        by_size.setdefault(len(r.raw), []).append(np.frombuffer(r.raw, number))
    out = {}
    for size, sample in by_size.items():
        x, radius = units(np.array(sample)), 1.0
        found = net(x, 0, radius)[0]
        while len(found) < min(regions, len(x)) and radius > LEAF_RADIUS:
            radius /= 2
            found = net(x, 0, radius)[0]
        out[size] = x[found[:regions]]
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tree_nodes: int = TREE_NODES) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two rows are linked if the cosine of their vectors, in double precision,
    is ``threshold`` (0.5 or more) or more; equal vectors always are.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id reachable by links, ``kept`` whether that is the row's own.
    A vector that is null, empty, zero, or holds null or non-finite components
    links with nothing, copies of it included; vectors of different sizes
    don't link. Repeated ids are rows of their own; a null id is reported as
    such and never the smallest unless it is alone. Other columns are not
    read. An empty table gives an empty result.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("the threshold is a cosine from 0.5 to below 1")
    spark = vectors.sparkSession
    number = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64
    rows = scratch.table(_read(vectors, id_col, vector_col), "vector-rows")
    grouped = rows.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("raw").alias("raw"))
    nodes = scratch.table(grouped, "vector-nodes")
    sent = spark.sparkContext.broadcast(_centers(nodes, number, tree_nodes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(r) for r in raw], np.int64)
            region, far = np.full(len(raw), -1), np.full(len(raw), 2.0)
            for size in np.unique(sizes).tolist():
                centers = sent.value.get(size)
                if centers is not None:
                    of = np.flatnonzero(sizes == size)
                    near = units(np.array([np.frombuffer(raw[i], number) for i in of])) @ centers.T
                    region[of] = near.argmax(axis=1)
                    far[of] = _chord(near.max(axis=1))
            new = [pa.array(sizes, pa.int32()), pa.array(region, pa.int32()), pa.array(far)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], ["key", "n", "raw", "size", "region", "far"])

    placed = nodes.select("key", "n", "raw").mapInArrow(place, "key binary, n long, raw binary, size int, region int, far double")
    placed = scratch.table(placed, "vector-placed")
    # a row for each region and vector size
    regions = placed.groupBy("size", "region").agg(F.count(F.lit(1)).alias("c"), F.max("far").alias("far")).orderBy("size", "region").collect()
    eps, met, per_tree = math.sqrt(2 - 2 * threshold), [], [min(tree_nodes, max(1, TREE_BYTES // r["size"])) for r in regions]
    for i, r in enumerate(regions):
        for j, s in enumerate(regions):
            if r["size"] == s["size"]:
                own = sent.value.get(r["size"])
                apart = 0.0 if own is None or min(r.region, s.region) < 0 else float(np.linalg.norm(own[r.region] - own[s.region]))
                if i == j or apart <= r.far + s.far + eps + SLACK:
                    met.append((i, j, -(-s.c // per_tree[j])))
    parts = spark.createDataFrame([(r["size"], r.region, i, -(-r.c // per_tree[i])) for i, r in enumerate(regions)], "size int, region int, g int, parts long")
    partners = spark.createDataFrame(met, "g int, h int, h_parts long")

    def grow(group: pa.Table) -> pa.Table:
        raw = np.array([np.frombuffer(r, number) for r in group["raw"].to_pylist()])
        order, table = Tree.grow(units(raw))
        keys, n = group["key"].take(pa.array(order)).to_pylist(), group["n"].to_numpy()[order].astype(np.int64)
        packed = [b"".join(keys), n.tobytes(), raw[order].tobytes(), table.tobytes()]
        return pa.table([group["g"].slice(0, 1), group["part"].slice(0, 1), *([x] for x in packed)], schema=pa.schema([("g", pa.int32()), ("part", pa.int64()), *((c, pa.binary()) for c in ("keys", "weights", "points", "nodes"))]))

    dealt = placed.join(F.broadcast(parts), ["size", "region"]).select("g", F.expr("pmod(xxhash64(key), parts)").alias("part"), "key", "n", "raw")
    trees = scratch.table(dealt.groupBy("g", "part").applyInArrow(grow, "g int, part long, keys binary, weights binary, points binary, nodes binary"), "vector-trees")

    links_schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("label", pa.binary())])

    def meet(group: pa.Table) -> pa.Table:
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        both = sorted(group.select(["own", "keys", "weights", "points", "nodes"]).to_pylist(), key=lambda r: r["own"] != a)
        if len(both) == 1 and a != b:  # the other part has no nodes
            return links_schema.empty_table()
        n = [len(r["keys"]) // 16 for r in both]
        raw = [np.frombuffer(r["points"], number).reshape(k, -1) for r, k in zip(both, n)]
        grown = [Tree(units(x), np.frombuffer(r["nodes"], np.float64).reshape(6, -1)) for r, x in zip(both, raw)]
        raw = np.concatenate(raw).astype(np.float64)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        links = walk(grown[0], grown[-1], np.concatenate([np.frombuffer(r["weights"], np.int64) for r in both]), raw, threshold)
        keys = b"".join(r["keys"] for r in both)
        at = np.flatnonzero(links.linked > 0)
        name = [[keys[16 * i : 16 * i + 16] for i in x.tolist()] for x in (at, links.label[at])]
        return pa.table([pa.array(name[0], pa.binary()), pa.array(links.linked[at].astype(np.int64)), pa.array(name[1], pa.binary())], schema=links_schema)

    own, other = F.struct("g", "part"), F.struct(F.col("h").alias("g"), F.col("q").alias("part"))
    pairs = trees.join(F.broadcast(partners), "g").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h_parts") - 1)))
    pairs = pairs.select(F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), own.alias("own"), "keys", "weights", "points", "nodes")
    found = scratch.table(pairs.groupBy("a", "b").applyInArrow(meet, "key binary, links long, label binary"), "vector-links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    labels = near_dedup.components(found.filter("key <> label").select(F.col("key").alias("a"), F.col("label").alias("b")).distinct())
    known = nodes.select("key", "n", "least").join(counts, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left")
    known = scratch.table(known.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "key").alias("root")), "vector-known")
    smallest = scratch.table(known.groupBy("root").agg(F.min("least").alias("component_id")), "vector-components")
    judged = scratch.table(known.join(smallest, "root").select("key", "n_links", "component_id"), "vector-judged")
    out = rows.select("id", "key").join(judged.withColumnRenamed("key", "j_key"), F.col("key") == F.col("j_key"), "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
