"""Near-duplicate classes: ProbMinHash, banding, verification, components.

A text is its 5-word shingles (A-Z lower-cased); a shingle weighs one plus the
decimal logarithm of its count. Every shingle sends exponential arrivals at a
rate of its weight to random registers; the earliest arrival names the
register's shingle, so two texts agree in a register with the probability
Jaccard similarity of their weighted shingles. A shingle stops when its next
arrival is later than every register's earliest. Weights choose candidates
only: pairs stay if the plain Jaccard similarity of their shingle sets reaches
the threshold.

Equal shingle sets are one *node*. Nodes that share a band form a bucket, and
each bucket has a *hub*, its most popular node. Every node is compared with
its hub once: one row per node, however large a bucket of copies is. From the
differences a *center* is made, the hub with all corrected in which most of a
few of its nodes differ from it, and the node nearest to the center, the
*core*, is compared with all. What is left are pairs of which one node is not
linked to the core. With D(x) the symmetric difference of x and the center, a
pair's own difference is ``|D(u)| + |D(v)| - 2 |D(u) & D(v)|``, so the sizes
give a lower bound on the common part of D(u) and D(v), and both share one of
the first few elements of D in any common order (prefix filter). The nodes that
share one meet in a task, or, if they are many, in several, each with two
parts of them. The sizes of all ``D(u) & D(v)`` are one matrix product there,
and what leaves the task is each node with the first of its component, never a
row for each link. No pair of a bucket is left out, and texts just below the
threshold, each with edits of its own, mostly meet nobody.

With c = (1 - t) / (1 + t) for the threshold t, nodes u and v are linked if
``|u ^ v| <= c (|u| + |v|)``. The core is the node with the least
``d - c n`` (d the size of D, n of the node); call that value m. Then
``2 |D(u) & D(v)| >= d_u - c n_u + m`` for every link of u, and
``2 |D(u) & D(v)| > d_v - c n_v - m`` if u is not linked to the core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import scratch

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 5
#: Similarity 4/5, as whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: c = _P / _Q in whole numbers.
_P, _Q = DENOMINATOR - NUMERATOR, DENOMINATOR + NUMERATOR
#: Nodes that are looked at for a center; any choice is right, a good one leaves fewer pairs.
ORDER_SLOTS = 16
#: Nodes with an element in common that meet in one task; more are parted.
PART_NODES = 2048
#: Elements whose nodes are held as a matrix at a time.
ELEMENTS = 2048
_EMPTY = hashlib.blake2b(b"no words", digest_size=16).digest()


def weighted_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle and count of every distinct shingle of a block, by document."""
    start, end, doc = K.words(data, offsets)
    h, d, _ = K.shingles(K.word_hashes(data, start, end), doc, SHINGLE_WORDS)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if not len(h):
        return d, h, d
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    return d[new], h[new], np.diff(np.r_[new, len(h)])


def prob_min_hash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The shingle that each register of each document holds (0 where it has none)."""
    first = np.full(n_docs * registers, np.inf)
    held = np.zeros(n_docs * registers, np.uint64)
    d, h, w, x = doc, shingle, weight, np.zeros(len(doc))
    done = 0
    while len(d):
        points = max(1, min(64, 65536 // len(d)))
        t = np.arange(done + 1, done + points + 1, dtype=np.uint64)
        done += points
        bits = K.mix(h[:, None] + t * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((bits >> np.uint64(24)).astype(float) + 0.5) / 2.0**40) / w[:, None]
        at = x[:, None] + np.cumsum(gap, axis=1)
        place = d[:, None] * registers + (((bits & np.uint64(0xFFFFFF)) * np.uint64(registers)) >> np.uint64(24)).astype(np.int64)
        better = at < first[place]
        p, a = place[better], at[better]
        np.minimum.at(first, p, a)
        own = np.broadcast_to(h[:, None], at.shape)[better]
        win = first[p] == a
        held[p[win]] = own[win]
        x = at[:, -1]
        late = first.reshape(n_docs, registers).max(axis=1)
        go = x < late[d]
        d, h, w, x = d[go], h[go], w[go], x[go]
    return held.reshape(n_docs, registers)


def band_hashes(held: np.ndarray) -> np.ndarray:
    cells = held.reshape(len(held), BANDS, ROWS)
    g = K.mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :] + np.zeros((len(held), 1), np.uint64)
    for r in range(ROWS):
        g = K.mix(g * np.uint64(0xD6E8FEB86659FD93) + cells[:, :, r])
    return g


def _set_ids(doc: np.ndarray, shingle: np.ndarray, n_docs: int) -> list[bytes]:
    """128-bit identity of each document's shingle set."""
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    raw = shingle.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else _EMPTY for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table: id, key, node, bands of every row; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(2))
            for a, b, raw, o in K.blocks(data, offsets):
                doc, shingle, count = weighted_sets(raw, o)
                held = prob_min_hash(doc, shingle, 1 + np.log10(count), b - a, BANDS * ROWS)
                some = np.bincount(doc, minlength=b - a) > 0
                at = np.cumsum(np.r_[0, some * BANDS])
                bands = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(band_hashes(held[some]).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(_set_ids(doc, shingle, b - a), pa.binary()), bands],
                    ["id", "key", "node", "bands"],
                )

    picked = docs.select(docs[id_col].alias("id"), scratch.text_key(text_col).alias("key"), docs[text_col].cast("string").alias("text"))
    return scratch.table(picked.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, key binary, node binary, bands array<long>"), "near-signatures")


def _shingle_sets(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """Written table: node and shingle set, one text each, for the (key, node) of ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            for a, b, raw, o in K.blocks(data, offsets):
                doc, shingle, _ = weighted_sets(raw, o)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                sets = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(shingle.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], ["t_key", "shingles"])

    keyed = docs.select(scratch.text_key(text_col).alias("t_key"), docs[text_col].cast("string").alias("text"))
    wanted = keyed.join(nodes.select(F.col("key").alias("t_key")), "t_key", "left_semi")
    once = wanted.groupBy("t_key").agg(F.first("text").alias("text"))
    sets = once.mapInArrow(run, "t_key binary, shingles array<long>")
    return scratch.table(sets.join(nodes, F.col("t_key") == F.col("key")).select("node", "shingles"), "near-sets")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    cut = column.offsets.to_numpy()
    return cut - cut[0], column.values.to_numpy(zero_copy_only=False)[cut[0] : cut[-1]]


def _ragged(parts: list[np.ndarray]) -> pa.Array:
    """One list of int64 for each array."""
    cut = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").filter(small * DENOMINATOR >= large * NUMERATOR)
    found = both.filter(common * DENOMINATOR >= (F.size("x") + F.size("y") - common) * NUMERATOR)
    return found.select("a", "b")


def _compared(star: DataFrame, sets: DataFrame) -> DataFrame:
    """Written table: for each (node, hub) the size of the node, whether they are linked, and what the node added and lacks.

    The hubs are among the nodes, each with nothing added or lacking.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x_cut, x), (y_cut, y) = _lists(batch.column(2)), _lists(batch.column(3))
            n, m = np.diff(x_cut), np.diff(y_cut)
            more = [np.setdiff1d(x[a:b], y[c:d], assume_unique=True) for a, b, c, d in zip(x_cut[:-1], x_cut[1:], y_cut[:-1], y_cut[1:])]
            less = [np.setdiff1d(y[c:d], x[a:b], assume_unique=True) for a, b, c, d in zip(x_cut[:-1], x_cut[1:], y_cut[:-1], y_cut[1:])]
            linked = np.array([len(a) + len(b) for a, b in zip(more, less)], np.int64) * _Q <= (n + m) * _P
            columns = [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(linked), _ragged(more), _ragged(less)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "hub", "n", "linked", "more", "less"])

    star = star.unionByName(star.select(F.col("hub").alias("node"), "hub").distinct())
    hubs = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("y"))
    joined = star.join(sets, "node").join(hubs, "hub").select("node", "hub", F.col("shingles").alias("x"), "y")
    return scratch.table(joined.mapInArrow(run, "node binary, hub binary, n long, linked boolean, more array<long>, less array<long>"), "near-star")


def _loose_hubs(rows: DataFrame) -> DataFrame:
    """The rows of hubs with three nodes or more of which one is not linked."""
    counts = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("k"), F.bool_or(~F.col("linked")).alias("loose"))
    return rows.join(counts.filter("loose and k > 2").select("hub"), "hub", "left_semi")


def _centers(rows: DataFrame) -> DataFrame:
    """(c_hub, put, drop, element, times): what to put into a hub and drop from it for its center, and how many of the looked at nodes differ from that in an element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            put, drop, element, times = [], [], [], []
            for slots in batch.column(1).to_pylist():
                sides = []
                for side in ("more", "less"):
                    e, n = np.unique(np.concatenate([np.array(x[side], np.int64) for x in slots]), return_counts=True)
                    most = 2 * n > len(slots)
                    sides.append((e, np.where(most, len(slots) - n, n), e[most]))
                put.append(sides[0][2])
                drop.append(sides[1][2])
                e, n = (np.concatenate([x[i] for x in sides]) for i in (0, 1))
                order = np.argsort(e)
                order = order[n[order] > 1]
                element.append(e[order])
                times.append(n[order])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(_ragged, (put, drop, element, times))], ["c_hub", "put", "drop", "element", "times"])

    slot = F.pmod(F.xxhash64("node"), F.lit(ORDER_SLOTS)).alias("slot")
    few = rows.groupBy("hub", slot).agg(F.max_by(F.struct("more", "less"), "node").alias("one")).groupBy("hub").agg(F.collect_list("one").alias("slots"))
    return few.mapInArrow(run, "c_hub binary, put array<long>, drop array<long>, element array<long>, times array<long>")


def _centered(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """Written table: the rows with ``more`` and ``less`` against the center, and ``rank``, by which the core is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_lists(batch.column(i)) for i in range(3, 7)]
            all_more, all_less = [], []
            for i in range(batch.num_rows):
                more, less, put, drop = (v[cut[i] : cut[i + 1]] for cut, v in lists)
                all_more.append(np.r_[np.setdiff1d(more, put, True), np.setdiff1d(drop, less, True)])
                all_less.append(np.r_[np.setdiff1d(less, drop, True), np.setdiff1d(put, more, True)])
            d = np.array([len(a) + len(b) for a, b in zip(all_more, all_less)], np.int64)
            rank = pa.array(_Q * d - _P * batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), _ragged(all_more), _ragged(all_less), rank], ["node", "hub", "n", "more", "less", "rank"])

    named = rows.join(centers, F.col("hub") == F.col("c_hub")).select("node", "hub", "n", "more", "less", "put", "drop")
    return scratch.table(named.mapInArrow(run, "node binary, hub binary, n long, more array<long>, less array<long>, rank long"), "near-centered")


def _prefixes(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """Written table: links to the core (``element`` null), and the first elements of each node's difference from the center.

    ``role`` has bit 1 if the element is in the prefix that a node not linked
    to the core needs, and bit 2 if in the one that its partner needs.
    """
    names = ["node", "core", "hub", "element", "role"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank, core_n, core_rank = (batch.column(i).to_numpy() for i in (2, 5, 7, 8))
            lists = [_lists(batch.column(i)) for i in (3, 4, 9, 10, 11)]
            of, elements, roles, linked = [], [], [], np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                more, less, core, known, seen = (v[cut[i] : cut[i + 1]] for cut, v in lists)
                own = np.r_[more, less]
                away = len(own) + len(core) - 2 * len(np.intersect1d(own, core, True))
                linked[i] = away * _Q <= (n[i] + core_n[i]) * _P
                # least common part with a partner not linked to the core; for a node not linked itself, with any
                as_v = max(1, (rank[i] - core_rank[i]) // (2 * _Q) + 1)
                as_u = len(own) + 1
                if not linked[i]:
                    as_u = max(1, -(-(rank[i] + core_rank[i]) // (2 * _Q)))
                    as_v = max(as_v, as_u)
                take_u, take_v = len(own) - as_u + 1, len(own) - as_v + 1
                if max(take_u, take_v) <= 0:
                    continue
                weight = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    weight = np.where(known[at] == own, seen[at], 0)
                # what a node added is likeliest its own, so that comes first
                first = np.lexsort((own, weight, np.arange(len(own)) >= len(more)))[: max(take_u, take_v)]
                place = np.arange(len(first))
                elements.append(own[first])
                roles.append((place < take_u) + 2 * (place < take_v))
                of.append(np.full(len(first), i))
            hits = np.flatnonzero(linked)
            at = pa.array(np.concatenate([hits, *of]).astype(np.int64))
            element = pa.array(np.concatenate([np.zeros(len(hits), np.int64), *elements]), mask=np.arange(len(at)) < len(hits))
            role = pa.array(np.concatenate([np.zeros(len(hits)), *roles]).astype(np.int32))
            take = lambda c: c.take(at)
            yield pa.RecordBatch.from_arrays([take(batch.column(0)), take(batch.column(6)), take(batch.column(1)), element, role], names)

    core = rows.groupBy(F.col("hub").alias("k_hub")).agg(F.min(F.struct("rank", "node")).alias("k"))
    own = rows.select("hub", "node", "n", F.concat("more", "less").alias("away")).join(core, (F.col("hub") == F.col("k_hub")) & (F.col("node") == F.col("k.node")))
    own = own.select("k_hub", F.col("node").alias("core"), F.col("n").alias("core_n"), F.col("k.rank").alias("core_rank"), "away")
    told = own.join(centers.select("c_hub", "element", "times"), F.col("k_hub") == F.col("c_hub")).drop("c_hub")
    named = rows.join(told, F.col("hub") == F.col("k_hub")).select("node", "hub", "n", "more", "less", "rank", "core", "core_n", "core_rank", "away", "element", "times")
    schema = "node binary, core binary, hub binary, element long, role int"
    return scratch.table(named.mapInArrow(run, schema), "near-prefixes")


def _settle(group: pa.Table) -> pa.Table:
    """Nodes of one element, of which some (``as_u``) are held against others (``as_v``): each linked node and the first of its component."""
    group = group.combine_chunks()
    n = group.column("n").to_numpy()
    sides = [_lists(group.column(x)) for x in ("more", "less")]
    d = np.diff(sides[0][0]) + np.diff(sides[1][0])
    row = np.concatenate([np.repeat(np.arange(len(n)), np.diff(cut)) for cut, _ in sides])
    # an element of one node alone is in no common part; what one adds another can't lack
    _, word, times = np.unique(np.concatenate([v for _, v in sides]), return_inverse=True, return_counts=True)
    held = times[word] > 1
    column = np.cumsum(times > 1) - 1
    row, column = row[held], column[word[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    u, v = (np.flatnonzero(group.column(x).to_numpy(zero_copy_only=False)) for x in ("as_u", "as_v"))
    first = np.arange(len(n))
    common = np.zeros((len(u), len(v)), np.float32)
    for c in range(0, int((times > 1).sum()), ELEMENTS):  # however many elements there are, so many of them are held at a time
        low, high = np.searchsorted(column, [c, c + ELEMENTS])
        holds = np.zeros((len(n), ELEMENTS), np.float32)
        holds[row[low:high], column[low:high] - c] = 1
        common += holds[u] @ holds[v].T
    links = [np.zeros((2, 0), np.int64)]
    for a in range(0, len(u), 256):
        part = u[a : a + 256]
        i, j = np.nonzero((d[part][:, None] + d[v][None, :] - 2 * common[a : a + 256]) * _Q <= (n[part][:, None] + n[v][None, :]) * _P)
        links.append(np.stack([part[i], v[j]]))
    x, y = np.concatenate(links, axis=1)
    while len(x):  # smallest number of each component
        before = first.copy()
        low = np.minimum(first[x], first[y])
        np.minimum.at(first, x, low)
        np.minimum.at(first, y, low)
        first = first[first]
        if (first == before).all():
            break
    moved = np.flatnonzero(first != np.arange(len(n)))
    node = group.column("node")
    return pa.table([node.take(pa.array(moved)), node.take(pa.array(first[moved]))], names=["a", "b"])


def _hub_links(star: DataFrame, sets: DataFrame) -> DataFrame:
    """Of all (node, hub): links (a, b) that connect all nodes of a hub that are linked."""
    star = _compared(star, sets)
    rows = _loose_hubs(star)
    centers = scratch.table(_centers(rows), "near-centers")
    rows = _centered(rows, centers)
    keyed = _prefixes(rows, centers)
    ends = lambda df, other: df.select(F.col("node").alias("a"), F.col(other).alias("b")).filter("a <> b")
    direct = ends(star.filter("linked"), "hub").unionByName(ends(keyed.filter("element is null"), "core"))
    keyed = keyed.filter("element is not null").drop("core")
    as_u, as_v = F.col("role") % 2 == 1, F.col("role") >= 2
    groups = keyed.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("k"), F.count_if(as_u).alias("us"), F.count_if(as_v).alias("vs"), F.sum(F.xxhash64("node", "role").cast("decimal(38,0)")).alias("who"))
    groups = groups.filter("k > 1 and us > 0 and vs > 0")
    # elements with the same nodes, as those of one edit are, need one of them
    groups = groups.groupBy("hub", "k", "who").agg(F.min("element").alias("g_element")).select(F.col("hub").alias("g_hub"), "g_element", F.ceil(F.col("k") / PART_NODES).cast("int").alias("parts"))
    groups = scratch.table(groups, "near-groups")
    met = keyed.join(groups, (F.col("hub") == F.col("g_hub")) & (F.col("element") == F.col("g_element"))).select("hub", "element", "node", as_u.alias("as_u"), as_v.alias("as_v"), "parts")
    own, every = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda i, j, u, v: F.struct(i.alias("i"), j.alias("j"), u.alias("as_u"), v.alias("as_v"))
    no, u, v = F.lit(False), F.col("as_u"), F.col("as_v")
    apart = F.concat(F.transform(every, lambda j: cell(own, j, u, no)), F.transform(every, lambda i: cell(i, own, no, v)))
    cells = F.when(F.col("parts") == 1, F.array(cell(F.lit(0), F.lit(0), u, v))).otherwise(F.filter(apart, lambda c: c["as_u"] | c["as_v"]))
    dealt = met.select("hub", "element", "node", F.inline(cells))
    own_rows = rows.select(F.col("hub").alias("r_hub"), F.col("node").alias("r_node"), "n", "more", "less")
    dealt = dealt.join(own_rows, (F.col("hub") == F.col("r_hub")) & (F.col("node") == F.col("r_node")))
    found = dealt.select("hub", "element", "i", "j", "node", "as_u", "as_v", "n", "more", "less").groupBy("hub", "element", "i", "j").applyInArrow(_settle, "a binary, b binary")
    return direct.unionByName(found)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component.

    Each round takes the neighbours' smallest label, then the label's label;
    a round's table is deleted once the next is written.
    """
    both = scratch.table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = scratch.table(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = scratch.table(step.join(jump, "label").select("node", F.col("next").alias("label"), "old"), "labels")
        scratch.remove(labels)
        labels = after.select("node", "label")
        if after.filter("label <> old").limit(1).count() == 0:
            return labels


def links(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Written table: pairs (a, b) of linked nodes, enough to connect all that share a bucket and a link.

    ``buckets`` has band, node and popular. A bucket's hub is its most popular
    node, the one that shares most bands with most others: in a group of
    edited copies that is the text they were made from, or one close to it. A
    hub that is linked to the most popular of its own hubs hands its buckets
    over to that one, so that a group has few hubs.
    """
    rank = F.struct("popular", "node")
    hub = buckets.groupBy("band").agg(F.max(rank).alias("h")).select("band", F.col("h.node").alias("hub"), F.col("h.popular").alias("hub_popular"))
    placed = buckets.join(hub, "band").groupBy("node", "hub").agg(F.max("hub_popular").alias("hub_popular"))
    placed = scratch.table(placed, "near-hubs")
    best = placed.groupBy("node").agg(F.max(F.struct("hub_popular", "hub"))["hub"].alias("top"))
    handed = placed.select(F.col("hub").alias("node")).distinct().join(best, "node").filter("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b"))
    handed = scratch.table(verified(handed, sets), "near-handed")
    star = placed.join(handed.select(F.col("a").alias("hub"), F.col("b").alias("top")), "hub", "left").select("node", F.coalesce("top", "hub").alias("hub"))
    found = _hub_links(star.filter("node <> hub").distinct(), sets)
    return scratch.table(found.unionByName(handed).distinct(), "near-links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, class_key, class_id and class_size of every row.

    Two texts are linked if their shingle sets have a Jaccard similarity of
    0.8 or more; a class is a connected component; class_id is its smallest
    id. Texts of 1 to 4 words have one shingle; all texts without words, null
    and empty ones included, are one class. A class without ids has a null
    class_id. Repeated rows are in one class. Other columns are not read. An
    empty table gives an empty result.
    """
    signed = signatures(docs, id_col, text_col)
    # texts of one shingle set can differ in their counts, and so in their bands
    variants = scratch.table(signed.groupBy("node", F.xxhash64("bands").alias("sig")).agg(F.first("bands").alias("bands")), "near-nodes")
    members = variants.select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").withColumnRenamed("band", "s_band")
    together = scratch.table(members.join(shared, F.col("band") == F.col("s_band")).select("band", "node", "c"), "near-members")
    popular = together.groupBy("node").agg(F.sum("c").alias("popular"))
    buckets = scratch.table(together.select("band", "node").join(popular, "node"), "near-buckets")
    wanted = signed.groupBy("node").agg(F.min("key").alias("key")).join(popular.select("node"), "node", "left_semi")
    labels = components(links(buckets, _shingle_sets(docs, wanted, text_col)))
    placed = signed.select("id", "key", "node").join(labels, "node", "left")
    placed = scratch.table(placed.select("id", "key", F.coalesce("label", "node").alias("class_key")), "near-placed")
    # written, so that the members of a large class can be split in the join
    sizes = scratch.table(placed.groupBy("class_key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "near-sizes")
    return placed.join(sizes, "class_key").select(F.col("id").alias(id_col), "key", "class_key", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all columns: the one with the smallest id (of
    several, or where no id is known, one of those with the smallest text key;
    of rows with one id and text, the one with the smallest hash of all columns).

    Null, empty and very long texts, repeated rows and other columns are as in
    ``classes``; columns may have any names. An empty table stays empty.
    """
    found = classes(docs, id_col, text_col)
    best = found.groupBy("class_key").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("i"), F.col("key").alias("k"))).alias("best"))
    own_key, want_id, want_key, row = scratch.free_names(docs, 4)
    best = best.select(F.col("best.i").alias(want_id), F.col("best.k").alias(want_key))
    keyed = docs.select(F.struct("*").alias(row), docs[id_col].alias(id_col), scratch.text_key(text_col).alias(own_key))
    kept = keyed.join(best, (F.col(own_key) == F.col(want_key)) & F.col(id_col).eqNullSafe(F.col(want_id)), "left_semi")
    # rows with one id and text are what is left to tell apart
    one = kept.groupBy(id_col, own_key).agg(F.min_by(row, F.xxhash64(row)).alias(row))
    return one.select(f"{row}.*")
