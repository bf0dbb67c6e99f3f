"""Near duplicates among embeddings: cover trees over bounded cells, met by dual traversal.

Within a label, equal vectors are one node with a count.  Cells of more than ``BLOCK`` nodes are split by pivots, each cell
keeping the largest distance to its pivot, until a cell fits one tree.  Pairs of cells go down from the labels to these
cells and are dropped where the distance of two pivots exceeds both radii and the threshold, so a pair of cells is one row
and no row is a pair of vectors.  A tree is built once for a cell; a task then meets the trees of a pair of cells.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.llm.common import Scratch, checkpointed, join_facts
from ripplemark.llm.ngram_join import _grouped, _roots, contracted

#: Least cosine of a link.
THRESHOLD = 0.93
#: Nodes of a tree; pivots of a split; splits before the rest is dealt by hash.
BLOCK, FAN, DEEPEST = 2048, 16, 12
#: Distances are compared with bounds up to this error, cosines exactly.
ERROR = 1e-6
#: Pairs of nodes whose distances are taken at once.
CHUNK = 1 << 16

_TREE = "cell string, k binary, weight binary, v binary, parent binary, sizes array<int>, radii binary"


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square overflows or vanishes."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _far(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def _slack(size: int) -> float:
    """How far two distances of the same vectors may be apart by rounding: near 0 this is the root of the error of a cosine."""
    return math.sqrt(4 * (size + 4) * np.finfo(np.float64).eps)


class CoverTree:
    """Nested levels over unit vectors: level i has radius 2 / 2**i, its nodes are the first ``sizes[i]`` vectors.

    The vectors stand in farthest-first order, so those whose distance to all before them exceeds the radius of a level come first:
    they are further apart than that radius and every vector is within it of one of them.  A node stays a node on all
    lower levels.  A vector hangs on the nearest node of the level above the one it first appears on.  ``radii[i]`` are the
    largest distances of nodes to what hangs below them, widened by what rounding may take from a distance.  Levels halve
    down to ``finest``; the last level has all vectors.
    """

    def __init__(self, vectors: np.ndarray, weight: np.ndarray, parent: np.ndarray, sizes: list[int], radii: list[np.ndarray]):
        self.vectors, self.weight, self.parent, self.sizes, self.radii = vectors, weight, parent, sizes, radii
        n = len(vectors)
        self.above = [np.zeros(0, np.int64)] * len(sizes)  # node of each vector on each level
        own = np.arange(n)
        for i in reversed(range(len(sizes))):
            own = np.where(own < sizes[i], own, parent[own])
            self.above[i] = own
        self.weights = [np.bincount(a, weight, s).astype(np.int64) for a, s in zip(self.above, sizes)]
        self.children = []
        for i in range(len(sizes) - 1):
            up = self.above[i][: sizes[i + 1]]
            order = np.argsort(up, kind="stable")
            self.children.append((order, np.searchsorted(up[order], np.arange(sizes[i] + 1))))

    @staticmethod
    def order(vectors: np.ndarray, finest: float) -> tuple[np.ndarray, np.ndarray, list[int], list[np.ndarray]]:
        """The farthest-first order, the parents (in that order), the sizes of the levels and the radii."""
        n = len(vectors)
        far = _far(vectors @ vectors.T)
        near = far[0].copy()
        near[0] = -1.0
        order, apart = [0], [math.inf]
        for _ in range(n - 1):
            j = int(np.argmax(near))
            order.append(j)
            apart.append(near[j])
            near = np.minimum(near, far[j])
            near[j] = -1.0
        order = np.array(order)
        far = far[np.ix_(order, order)]
        sizes, radius = [1], 2.0
        while radius > finest and sizes[-1] < n:
            radius /= 2
            sizes.append(int(np.searchsorted(-np.array(apart), -radius, "left")))
        if sizes[-1] < n:
            sizes.append(n)
        parent = np.zeros(n, np.int64)
        for a, b in zip(sizes, sizes[1:]):
            if b > a:
                parent[a:b] = np.argmin(far[a:b, :a], axis=1)
        radii, own = [], np.arange(n)
        for s in reversed(sizes):
            own = np.where(own < s, own, parent[own])
            largest = np.zeros(s)
            np.maximum.at(largest, own, far[np.arange(n), own])
            radii.append(largest + _slack(vectors.shape[1]))
        return order, parent, sizes, radii[::-1]

    def level(self, i: int) -> int:
        return min(i, len(self.sizes) - 1)

    def below(self, nodes: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the children (on level i + 1) of each node of level i begin in ``self.children[i]``, and how many there are."""
        if i >= len(self.sizes) - 1:
            return nodes, np.ones(len(nodes), np.int64)
        starts = self.children[i][1]
        return starts[nodes], starts[nodes + 1] - starts[nodes]

    def child(self, places: np.ndarray, i: int) -> np.ndarray:
        return places if i >= len(self.sizes) - 1 else self.children[i][0][places]


def _expanded(a: CoverTree, b: CoverTree, i: int, x: np.ndarray, y: np.ndarray, same: bool):
    """Pairs of children with the cosines of their vectors, piece by piece."""
    (ax, nx), (by, ny) = a.below(x, i), b.below(y, i)
    count = nx * ny

    def kept(p, q, dots, twin):
        ok = ~twin | (p <= q)  # of a node with itself each pair of children once
        return p[ok], q[ok], dots[ok]

    wide = count >= 1024
    for j in np.flatnonzero(wide).tolist():
        p, q = a.child(np.arange(ax[j], ax[j] + nx[j]), i), b.child(np.arange(by[j], by[j] + ny[j]), i)
        dots = a.vectors[p] @ b.vectors[q].T
        pp, qq = np.repeat(p, len(q)), np.tile(q, len(p))
        yield kept(pp, qq, dots.ravel(), np.full(len(pp), same and x[j] == y[j]))
    rest = np.flatnonzero(~wide)
    ends = np.cumsum(count[rest])
    at = 0
    while at < len(rest):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        part = rest[at:to]
        n = count[part]
        row = np.repeat(part, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p, q = a.child(ax[row] + k // ny[row], i), b.child(by[row] + k % ny[row], i)
        yield kept(p, q, np.einsum("ij,ij->i", a.vectors[p], b.vectors[q]), (x[row] == y[row]) if same else np.zeros(len(row), bool))
        at = to


def links(a: CoverTree, b: CoverTree, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the vectors of each tree the weight of those of the other that are linked to it, and link pairs that join the same vectors as all links.

    ``same``: both are one tree, a pair counts once for either end and a vector is not its own partner.  Link pairs name
    the vectors of ``b`` from ``len(a.vectors)`` on, or as those of ``a`` if they are one tree.
    """
    t = math.sqrt(2 - 2 * threshold)
    shift = 0 if same else len(a.vectors)
    last = max(len(a.sizes), len(b.sizes)) - 1
    counts = [[np.zeros(s, np.int64) for s in tree.sizes] for tree in (a, b)]
    joined: list[np.ndarray] = []
    own = np.zeros(len(a.vectors), np.int64)

    def whole(tree, level, nodes, offset):
        """Every vector below these nodes is linked with all that the node is linked with."""
        mark = np.zeros(tree.sizes[level], bool)
        mark[nodes] = True
        below = np.flatnonzero(mark[tree.above[level]])
        joined.append(np.stack([below, tree.above[level][below]], 1) + offset)

    x = y = np.zeros(1, np.int64)
    for i in range(-1, last):
        if i < 0:  # the roots themselves
            pieces = [(x, y, np.einsum("ij,ij->i", a.vectors[:1], b.vectors[:1]))]
        else:
            pieces = _expanded(a, b, i, x, y, same)
        la, lb = a.level(i + 1), b.level(i + 1)
        leaf = i + 1 >= last  # nodes are vectors there, so the cosine itself decides
        next_x, next_y = [], []
        for p, q, dots in pieces:
            twin = (p == q) if same else np.zeros(len(p), bool)
            reach = a.radii[la][p] + b.radii[lb][q]
            far = np.where(twin, 0.0, _far(dots))
            inner = np.zeros(len(p), bool) if leaf else far + reach <= t - ERROR
            inside = ~twin & (dots >= threshold) if leaf else inner
            go = ~inner & (not leaf) & (far <= reach + t + ERROR)
            ip, iq, it = p[inside], q[inside], twin[inside]
            np.add.at(counts[0][la], ip, b.weights[lb][iq])
            np.add.at(counts[1][lb], iq[~it], a.weights[la][ip[~it]])
            if it.any():
                mark = np.zeros(a.sizes[la], bool)
                mark[ip[it]] = True
                own += np.where(mark[a.above[la]], a.weight, 0)
            joined.append(np.stack([ip, iq + shift], 1))
            whole(a, la, p[inner], 0)
            whole(b, lb, q[inner], shift)
            next_x.append(p[go])
            next_y.append(q[go])
        x, y = np.concatenate(next_x or [x[:0]]), np.concatenate(next_y or [y[:0]])
        if not len(x):
            break
    down = [sum(c[level][above] for level, above in enumerate(tree.above)) for tree, c in zip((a, b), counts)]
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *joined])
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    if same:
        return down[0] + down[1] - own, np.zeros(0, np.int64), pairs
    return down[0], down[1], pairs


def _row(cell: str, k: list[bytes], weight: list[int], v: list[bytes], kind, finest: float) -> list:
    vectors = unit(np.frombuffer(b"".join(v), kind).reshape(len(v), -1))
    order, parent, sizes, radii = CoverTree.order(vectors, finest)
    o = order.tolist()
    return [cell, b"".join(k[j] for j in o), np.array(weight, np.int64)[order].tobytes(), b"".join(v[j] for j in o), parent.astype(np.int32).tobytes(), sizes, np.concatenate(radii).tobytes()]


def _tree(row: dict, side: str, kind) -> tuple[CoverTree, list[bytes]]:
    weight, sizes = np.frombuffer(row[f"weight{side}"], np.int64), row[f"sizes{side}"]
    radii = np.split(np.frombuffer(row[f"radii{side}"]), np.cumsum(sizes)[:-1])
    vectors = unit(np.frombuffer(row[f"v{side}"], kind).reshape(len(weight), -1))
    k = row[f"k{side}"]
    return CoverTree(vectors, weight, np.frombuffer(row[f"parent{side}"], np.int32).astype(np.int64), sizes, radii), [k[j : j + 16] for j in range(0, len(k), 16)]


def _built(kind, finest: float):
    def run(batches):
        for g in _grouped(batches, "cell"):
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, _row(g["cell"][0], g["k"], g["copies"], g["v"], kind, finest)))], schema=_ARROW)

    return run


_ARROW = pa.schema([("cell", pa.string()), ("k", pa.binary()), ("weight", pa.binary()), ("v", pa.binary()), ("parent", pa.binary()), ("sizes", pa.list_(pa.int32())), ("radii", pa.binary())])


def _met(kind, threshold: float, same: bool):
    """For each vector with links in a pair of trees their number, and the next vector of its component there."""

    def run(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                row = batch.slice(j, 1).to_pylist()[0]
                a, ka = _tree(row, "", kind)
                b, kb = (a, []) if same else _tree(row, "_b", kind)
                na, nb, pairs = links(a, b, threshold, same)
                k, n = ka + kb, np.concatenate([na, nb])
                some = np.flatnonzero(n)
                label = np.array(_roots(len(k), pairs))[some] if len(some) else some
                chain = some[np.argsort(label, kind="stable")]
                label = np.sort(label, kind="stable")
                to = [k[y] if same_class else None for y, same_class in zip(chain[1:].tolist(), (label[1:] == label[:-1]).tolist())] + [None] * bool(len(chain))
                yield pa.RecordBatch.from_arrays([pa.array([k[x] for x in chain.tolist()], pa.binary()), pa.array(n[chain], pa.int64()), pa.array(to, pa.binary())], names=["k", "n", "to"])

    return run


def _split(kind):
    """Each row to the nearest pivot of its cell (ties: the first), with its distance."""

    def run(batches):
        for batch in batches:
            x = unit(np.stack([np.frombuffer(v, kind) for v in batch.column("v").to_pylist()])) if batch.num_rows else None
            cells = batch.column("cell").to_pylist()
            pivots = batch.column("pivots").to_pylist()
            rows: dict = {}
            for i, c in enumerate(cells):
                rows.setdefault(c, []).append(i)
            to, far = np.zeros(len(cells), np.int64), np.zeros(len(cells))
            for own in rows.values():
                dots = x[own] @ unit(np.stack([np.frombuffer(p, kind) for p in pivots[own[0]]])).T
                to[own] = np.argmax(dots, axis=1)
                far[own] = _far(dots.max(axis=1))
            names = [f"{c}/{t}" for c, t in zip(cells, to.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("v"), batch.column("copies"), pa.array(names, pa.string()), pa.array(far)], names=["k", "v", "copies", "cell", "far"])

    return run


def _close(kind, t: float):
    """Pairs of cells whose pivots are near enough for a link; a cell that has none is near everything."""

    def run(batches):
        for batch in batches:
            keep = []
            for ca, cb, ra, rb in zip(*(batch.column(n).to_pylist() for n in ("centre_a", "centre_b", "radius_a", "radius_b"))):
                far = 0.0 if ca is None or cb is None else float(_far((unit(np.frombuffer(ca, kind)[None]) * unit(np.frombuffer(cb, kind)[None])).sum()))
                keep.append(far <= ra + rb + t + ERROR)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "done"])

    return run


def _cells(scratch: Scratch, nodes: DataFrame, kind, threshold: float, block: int, fan: int, deepest: int) -> tuple[DataFrame, DataFrame]:
    """``k, v, copies, cell`` of all nodes in cells of at most about ``block``, and the pairs ``a, b`` of cells that links may join."""
    t = math.sqrt(2 - 2 * threshold)
    held = nodes.select("k", "v", "copies", F.col("space").alias("cell"), F.lit(0.0).alias("far"))
    facts = scratch.keep(held.groupBy("cell").agg(F.count("*").alias("n")).select("cell", "cell", "n", F.lit(None).cast("binary").alias("centre"), F.lit(2.0).alias("radius")).toDF("parent", "cell", "n", "centre", "radius"))
    pairs = facts.select(F.col("cell").alias("a"), F.col("cell").alias("b"), (F.col("n") <= block).alias("done"))
    leaves = facts.where(F.col("n") <= block)
    total = None
    done_rows, done_pairs = [], []
    for level in range(deepest + 1):
        large = facts.where(F.col("n") > block)
        if large.isEmpty():
            break
        total = facts.agg(F.sum("n")).first()[0]
        rows = join_facts(held, facts.select("cell", "n"), "cell", "n", total)
        done_rows.append(rows.where(F.col("n") <= block).select("k", "v", "copies", "cell"))
        rows = rows.where(F.col("n") > block).drop("n")
        if level < deepest:
            first = Window.partitionBy("cell").orderBy(F.xxhash64("k", F.lit(level)), "k")
            wanted = rows.select("cell", "k", "v").withColumn("place", F.row_number().over(first)).where(F.col("place") <= fan)
            pivots = wanted.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("p"))
            pivots = large.select("cell", "n").join(pivots, "cell").select("cell", "n", F.slice("p.v", F.lit(1), F.least(F.lit(fan), F.ceil(2 * F.col("n") / block)).cast("int")).alias("pivots"))
            pivots = scratch.keep(pivots)
            held = scratch.keep(join_facts(rows, pivots, "cell", "n", total).select("k", "v", "copies", "cell", "pivots").mapInArrow(_split(kind), "k binary, v binary, copies bigint, cell string, far double"))
            centres = pivots.select(F.col("cell").alias("parent"), F.posexplode("pivots").alias("at", "centre")).withColumn("cell", F.concat_ws("/", "parent", F.col("at").cast("string")))
        else:  # these no longer get smaller: parts by hash, each as wide as the whole
            parts = large.select("cell", "n", F.ceil(2 * F.col("n") / block).cast("int").alias("parts"), "centre")
            rows = join_facts(rows, parts, "cell", "n", total)
            held = scratch.keep(rows.select("k", "v", "copies", F.concat_ws("/", "cell", F.pmod(F.xxhash64("k", F.lit("part")), F.col("parts")).cast("string")).alias("cell"), "far"))
            centres = parts.select(F.col("cell").alias("parent"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at"), "centre").withColumn("cell", F.concat_ws("/", "parent", F.col("at").cast("string")))
        sizes = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        facts = scratch.keep(centres.join(sizes, "cell").select("parent", "cell", "n", "centre", "radius"))
        small = (F.col("n") <= block) | F.lit(level == deepest)
        kids = facts.withColumn("leaf", small).unionByName(leaves.withColumn("parent", F.col("cell")).withColumn("leaf", F.lit(True)))
        leaves = leaves.unionByName(facts.where(small))
        done_pairs.append(pairs.where("done").select("a", "b"))
        side = lambda s: kids.select(F.col("parent").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "centre", "radius", "leaf")])
        grown = pairs.where(~F.col("done")).join(side("a"), "a").join(side("b"), "b").where((F.col("a") != F.col("b")) | (F.col("cell_a") <= F.col("cell_b")))
        grown = grown.select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b"), (F.col("leaf_a") & F.col("leaf_b")).alias("done"), "centre_a", "centre_b", "radius_a", "radius_b")
        pairs = scratch.keep(grown.mapInArrow(_close(kind, t), "a string, b string, done boolean"))
    rows = held.select("k", "v", "copies", "cell")
    for part in done_rows:
        rows = rows.unionByName(part)
    pairs = pairs.select("a", "b")
    for part in done_pairs:
        pairs = pairs.unionByName(part)
    return rows, pairs


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK, fan: int = FAN, deepest: int = DEEPEST) -> DataFrame:
    """``id, n_links, component_id`` of every row: all pairs of one label with a cosine of at least ``threshold`` are links.

    A null label, a null, empty or zero vector and one with a null or non-finite component link with nothing; vectors of
    different lengths do not either.  Repeated rows, and others of one vector and label, are linked with each other;
    each has a row.  ``component_id`` is the least id of the linked rows, null ids aside; a row without links has its own
    id.  No pair is left out: bounds only drop pairs of nodes that cannot reach the threshold.  An empty table gives no
    rows.  Of the columns only the three named ones are read.
    """
    v = F.col(embedding)
    kind = "double" if vectors.select(v.alias("v")).schema["v"].dataType.elementType.simpleString() != "float" else "float"
    rows = vectors.select(F.col(vec_id).alias("id"), v.cast(f"array<{kind}>").alias("v"), F.col(label).cast("string").alias("l"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    fit = F.coalesce(F.col("l").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("fit", fit)
    id_kind = rows.schema["id"].dataType.simpleString()
    np_kind = np.float32 if kind == "float" else np.float64

    def keyed(batches):
        for batch in batches:
            space = [f"{n}|{name}" for n, name in zip(batch.column("size").to_pylist(), batch.column("l").to_pylist())]
            column = batch.column("v")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np_kind), np.cumsum([0, *batch.column("size").to_pylist()])
            raw = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            k = [hashlib.blake2b(s.encode() + b"\0" + r, digest_size=16).digest() for s, r in zip(space, raw)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(space, pa.string()), pa.array(k, pa.binary()), pa.array(raw, pa.binary())], names=["id", "space", "k", "v"])

    worded = rows.where("fit").select("id", "l", "v", F.size("v").alias("size")).mapInArrow(keyed, f"id {id_kind}, space string, k binary, v binary")
    with Scratch(vectors.sparkSession) as scratch:
        nodes = worded.groupBy("k").agg(F.first("space").alias("space"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("first"))
        nodes = scratch.keep(nodes)
        held, pairs = _cells(scratch, nodes, np_kind, threshold, block, fan, deepest)
        finest = math.sqrt(2 - 2 * threshold) / 64
        trees = scratch.keep(held.repartition("cell").sortWithinPartitions("cell", "k").mapInArrow(_built(np_kind, finest), _TREE))
        out = "k binary, n bigint, `to` binary"
        met = trees.mapInArrow(_met(np_kind, threshold, True), out)
        two = pairs.where(F.col("a") != F.col("b")).join(trees.withColumnRenamed("cell", "a"), "a")
        two = two.join(trees.select(*[F.col(c).alias("b" if c == "cell" else f"{c}_b") for c in trees.columns]), "b")
        found = scratch.keep(met.unionByName(two.mapInArrow(_met(np_kind, threshold, False), out)))
        labels = contracted(found.where(F.col("to").isNotNull()).select(F.col("k").alias("a"), F.col("to").alias("b")))
        counts = found.groupBy("k").agg(F.sum("n").alias("links"))
        classes = nodes.select("k", "first", "copies").join(counts, "k", "left").join(labels.withColumnRenamed("v", "k"), "k", "left")
        classes = scratch.keep(classes.select("k", "first", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("label", "k").alias("label")))
        heads = classes.groupBy("label").agg(F.min("first").alias("component"), F.count("*").alias("nodes"))
        classes = checkpointed(join_facts(classes, heads, "label", "nodes", classes.count()).select("k", "copies", "links", "component"))
    linked = join_facts(worded.select("id", "k"), classes, "k", "copies", classes.agg(F.sum("copies")).first()[0] or 0)
    alone = rows.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.select("id", F.col("links").alias("n_links"), F.coalesce("component", "id").alias("component_id")).unionByName(alone)


def op11_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query 11 over all vectors."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
