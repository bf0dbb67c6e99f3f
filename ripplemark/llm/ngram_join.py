"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; texts with equal sets are one node.  A set stands in the recursion as its
MinHash values.  A run picks one coordinate at each step of its path and splits a bucket by the value there, so two
sets stay together with the probability of their similarity; buckets of at most ``bucket`` sets are compared by brute
force, larger ones are split again.  Runs repeat until a pair at the threshold is together in some bucket with the
target recall.  A bucket that is still large at the last split is dealt into blocks, and every two blocks are compared
in a cell of their own.

A pair belongs to the first run in which its sets share a bucket, so each pair is looked at and counted once.  In a
cell, sets are first compared by their sketches; those that can reach the threshold form groups, and in each group
every pair of that cell is compared exactly on whole shingle sets.  A group keeps a spanning forest of its verified
links (the most similar first) and each set's number of verified partners, which add up over the groups: no class is
lost and no group writes all its pairs.  Classes are the connected components of the links, by randomised contraction.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemark.llm.common import Scratch, checkpointed, free, join_facts, mixed, slices
from ripplemark.llm.substrings import _BASES, Words

SHINGLE = 5
THRESHOLD = 0.8
SKETCH = 128
BUCKET = 1024
#: So many shingles count as one more set where a bucket is measured, so a bucket is bounded in bytes too.
LONG = 16_384
SLICE_ROWS, SLICE_BYTES = 1000, 8_000_000
_RANDOM = np.random.default_rng(20240101)
_FACTORS = _RANDOM.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def runs_for(recall: float, threshold: float = THRESHOLD, depth: int = 2) -> int:
    """How many runs find a pair at the threshold with ``recall`` when buckets take ``depth`` splits."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of one to four words is one shingle of all its words."""
    words = Words(texts)
    h = words.rolling(words.a, SHINGLE, _BASES[1])
    out = []
    for start, n in zip(words.starts.tolist(), words.counts.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(h[start : start + n - SHINGLE + 1]))
        elif n:
            short = hashlib.blake2b(b" ".join(words.tokens[start : start + n]), digest_size=8).digest()
            out.append(np.frombuffer(short, np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _key(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row for each set (no set may be empty)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), SKETCH), np.uint64)
    for i in range(SKETCH):
        out[:, i] = np.minimum.reduceat(flat * _FACTORS[i] + _TERMS[i], starts)
    return out


def sketched(docs: DataFrame, runs: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id``, ``h`` (hash of the text), ``k`` (identity of the shingle set, null if it is empty), ``weight`` (1, and 1 more
    for each ``LONG`` shingles), first ``nodes`` of every run, ``sketch``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", SLICE_ROWS, SLICE_BYTES):
                sets = shingle_sets([t or "" for t in part.column(2).to_pylist()])
                full = [s for s in sets if len(s)]
                minima = _minima(full) if full else np.empty((0, SKETCH), np.uint64)
                nodes = mixed(minima[:, :runs] + np.arange(runs, dtype=np.uint64) * np.uint64(_BASES[0])).astype(np.int64)
                small = (mixed(minima) & np.uint64(255)).astype(np.uint8)
                rows = iter(range(len(full)))
                which = [next(rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([_key(s) for s in sets], pa.binary()), pa.array([1 + len(s) // LONG for s in sets], pa.int64()), pa.array([None if i is None else nodes[i] for i in which], pa.list_(pa.int64())), pa.array([None if i is None else small[i].tobytes() for i in which], pa.binary())],
                    names=["id", "h", "k", "weight", "nodes", "sketch"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, h long, k binary, weight long, nodes array<long>, sketch binary")


def _grouped(batches, key: str):
    """Runs of equal ``key`` in sorted rows, as dicts of lists; a run may cross batches."""
    held: list[dict] = []

    def joined(parts):
        return {n: [x for p in parts for x in p[n]] for n in parts[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        keys = cols[key]
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            part = {n: v[a:b] for n, v in cols.items()}
            if held and held[-1][key][0] != part[key][0]:
                yield joined(held)
                held = []
            held.append(part)
    if held:
        yield joined(held)


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    """The component of each of ``n`` things that ``pairs`` link, by its least member."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[pairs[:, 0]], least)
        np.minimum.at(new, label[pairs[:, 1]], least)
        new = new[new]
        if (new == label).all():
            return label.tolist()
        label = new


def _alike(sketches: np.ndarray, least: int, split: int = 0) -> np.ndarray:
    """Pairs (rows a < b) that agree in at least ``least`` places; with ``split`` only those of a row before it and one from it on."""
    out = []
    for a in range(split or len(sketches) - 1):
        first = max(a + 1, split)
        b = np.flatnonzero(np.count_nonzero(sketches[first:] == sketches[a], axis=1) >= least)
        out.append(np.stack([np.full(len(b), a), b + first], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _met(paths: list[list[int | None]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each set in the runs before ``run``, and where it was alone in that run."""
    own = [[x or 0 for x in p[:run]] for p in paths]
    alone = np.array([[x is None for x in p[:run]] for p in paths], bool).reshape(len(paths), run)
    return np.array(own, np.int64).reshape(len(paths), run), alone


def _new(met: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows ``a``, ``b`` shared no bucket in an earlier run."""
    buckets, alone = met
    out = np.ones(len(a), bool)
    for r in range(buckets.shape[1]):
        out &= (buckets[a, r] != buckets[b, r]) | alone[a, r] | alone[b, r]
    return out


_MEMBERS = "name binary, k binary, run int, block int, path array<long>"


def _groups(least: int):
    """In every cell the groups of two or more that may hold new links, one row for each member."""

    def run(batches):
        out: list[tuple] = []

        def table():
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["name", "k", "run", "block", "path"])

        for g in _grouped(batches, "cell"):
            n = len(g["k"])
            if n < 2:
                continue
            order = sorted(range(n), key=lambda i: (g["block"][i], g["k"][i]))
            split = sum(b == g["block"][order[0]] for b in g["block"]) % n
            if not split and g["block"][0] != g["other"][0]:
                continue
            pairs = _alike(np.frombuffer(b"".join(g["sketch"][i] for i in order), np.uint8).reshape(-1, SKETCH), least, split)
            if len(pairs) and g["run"][0]:
                pairs = pairs[_new(_met([g["path"][i] for i in order], g["run"][0]), pairs[:, 0], pairs[:, 1])]
            if not len(pairs):
                continue
            member: dict[int, list[int]] = {}
            for i, r in zip(order, _roots(n, pairs)):
                member.setdefault(r, []).append(i)
            for m in member.values():
                if len(m) > 1:
                    name = hashlib.blake2b(b"%d" % g["cell"][0] + b"".join(g["k"][i] for i in m), digest_size=16).digest()
                    out += [(name, g["k"][i], g["run"][i], g["block"][i], g["path"][i]) for i in m]
            if len(out) >= 4000:
                yield table()
                out = []
        yield table()

    return run


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarity of every two sets."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[where]
    row, column = row[keep], number[where[keep]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, 8_000_000 // len(sets))
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[row[lo:hi], column[lo:hi] - a] = 1
        both += dense @ dense.T
    size = np.array([len(s) for s in sets], np.float32)
    return both / (size[:, None] + size[None, :] - both)


def _links(threshold: float):
    """In every group the verified links of a spanning forest, and each member's number of verified partners.

    Only the pairs that belong to the group's cell: new in its run and, between two blocks, one set of each.
    """

    def run(batches):
        for g in _grouped(batches, "name"):
            own = {k: i for i, k in enumerate(g["k"])}
            keys = sorted(own)
            if len(keys) < 2:
                continue
            s = similarities([np.frombuffer(g["own"][own[k]], np.uint64) for k in keys])
            near = np.triu(s >= threshold - 1e-6, 1)
            block = np.array([g["block"][own[k]] for k in keys])
            if (block != block[0]).any():
                near &= block[:, None] != block[None, :]
            a, b = np.nonzero(near)
            new = _new(_met([g["path"][own[k]] for k in keys], g["run"][0]), a, b)
            a, b = a[new], b[new]
            partners = np.bincount(a, minlength=len(keys)) + np.bincount(b, minlength=len(keys))
            order = np.argsort(-s[a, b], kind="stable")
            parent = list(range(len(keys)))
            tree = []
            for i, j in zip(a[order].tolist(), b[order].tolist()):
                x, y = i, j
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    tree.append((i, j))
            if tree:
                to: dict[int, list[bytes]] = {}
                for i, j in tree:
                    to.setdefault(i, []).append(keys[j])
                own_rows = sorted({x for p in tree for x in p})
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own_rows], pa.binary()), pa.array([int(partners[i]) for i in own_rows], pa.int64()), pa.array([to.get(i, []) for i in own_rows], pa.list_(pa.binary()))], names=["k", "n", "to"])

    return run


def contracted(links: DataFrame) -> DataFrame:
    """``v, label`` for every end of the links ``a, b``: equal labels within a connected component.

    Every vertex joins its neighbour (or itself) of the least hash, the links between joined vertices go on; a constant
    share of the vertices is expected to vanish each round, whatever the shape of the graph.
    """
    with Scratch(links.sparkSession) as scratch:
        links = scratch.keep(links.where(F.col("a") != F.col("b")).distinct())
        labels = links.select(F.col("a").alias("v")).union(links.select("b")).distinct().withColumn("label", F.col("v"))
        step = 0
        while not links.isEmpty():
            both = links.union(links.select("b", "a"))
            best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(step)).alias("h"), F.col("b"))).alias("m"))
            mine = F.struct(F.xxhash64("a", F.lit(step)).alias("h"), F.col("a").alias("b"))
            move = scratch.keep(best.select(F.col("a").alias("v"), F.least("m", mine)["b"].alias("w")))
            labels = labels.join(move.select(F.col("v").alias("label"), "w"), "label", "left").select("v", F.coalesce("w", "label").alias("label"))
            links = links.join(move.select(F.col("v").alias("a"), F.col("w").alias("x")), "a").join(move.select(F.col("v").alias("b"), F.col("w").alias("y")), "b")
            links = scratch.keep(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where(F.col("a") != F.col("b")).distinct())
            labels = scratch.keep(labels)
            step += 1
        return checkpointed(labels)


def _buckets(nodes: DataFrame, sketches: DataFrame, bucket: int, depth: int) -> DataFrame:
    """``run, node, k, n`` of all final buckets of weight ``n``, singles left out: over ``bucket`` only after ``depth`` splits.

    What is known of a bucket reaches its rows without bringing them together (see :func:`common.join_facts`).
    """
    done = None
    for level in range(1, depth + 1):
        sizes = checkpointed(nodes.groupBy("node").agg(F.count("*").alias("rows"), F.sum("weight").alias("n")).where(F.col("rows") > 1))
        total = sizes.agg(F.sum("rows")).first()[0] or 0
        nodes = checkpointed(join_facts(nodes, sizes, "node", "rows", total).where(F.col("n").isNotNull()))
        small = (nodes.where(F.col("n") <= bucket) if level < depth else nodes).select("run", "node", "k", "n")
        done = small if done is None else done.unionByName(small)
        large = nodes.where(F.col("n") > bucket)
        if level == depth or large.isEmpty():
            return done
        at = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(SKETCH)).cast("int") + 1
        value = F.expr(f"substring(sketch, cast(pmod(xxhash64(node, {level}), {SKETCH}) as int) + 1, 1)")
        nodes = large.join(sketches, "k").select("run", F.xxhash64("node", at, value).alias("node"), "k", "weight")
    return done


def _cells(final: DataFrame, sketches: DataFrame, runs: int, bucket: int) -> DataFrame:
    """The rows of every cell: ``cell, k, run, block, other, path, sketch``.

    A bucket of a weight of at most ``bucket`` is one cell.  A larger one is dealt into blocks of about half of that by a hash of
    the set, and each two blocks, and each block with itself, are a cell.  ``path`` has a set's bucket in every run.
    """
    path = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.element_at("by_run", r)["node"])
    paths = final.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("run", F.struct("node", "n")))).alias("by_run")).join(sketches, "k")
    each = paths.select("k", "sketch", path.alias("path"), F.explode("by_run").alias("run", "at")).select("k", "sketch", "path", "run", "at.*")
    blocks = F.when(F.col("n") > bucket, F.ceil(2 * F.col("n") / bucket)).otherwise(1).cast("int")
    each = each.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("k", F.lit("block")), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "k", "run", "block", "other", "path", "sketch")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, recall: float = 0.999, bucket: int = BUCKET, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """``id, k`` for every row, and the classes ``k, first, copies, links, class_k, class_id`` of the distinct sets.

    ``k`` is null for texts without words (null, empty): such rows are in no class.  Rows with equal shingle sets are
    copies.  ``first`` is a set's least id (null ids last), ``links`` the number of its distinct verified partners,
    ``class_id`` the least id of the class.  Very long texts are taken whole.  An empty table gives two empty results;
    only the two named columns are read, so others may have any name.

    ``recall`` is the least probability with which a pair at the threshold shares a bucket in some run after ``depth``
    splits; buckets that are still large are compared whole, block by block, so their size does not lower it.
    """
    runs = runs_for(recall, threshold, depth)
    rows = checkpointed(sketched(docs, runs, text, doc_id))
    full = rows.where(F.col("k").isNotNull())
    least_row = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("h"))).alias("row")
    nodes = full.groupBy("k").agg(least_row, F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"))
    nodes = checkpointed(nodes.select("k", F.col("row.id").alias("first"), F.col("row.h").alias("h"), "copies", "weight", "nodes", "sketch"))
    sketches = nodes.select("k", "sketch")
    final = _buckets(nodes.select(F.posexplode("nodes").alias("run", "node"), "k", "weight"), sketches, bucket, depth)
    least = math.floor(SKETCH * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)))
    held = _cells(final, sketches, runs, bucket).repartition("cell").sortWithinPartitions("cell")
    members = checkpointed(held.mapInArrow(_groups(least), _MEMBERS))
    wanted = members.select("k").distinct().join(nodes.select("k", "first", "h"), "k").withColumnRenamed("first", "id")

    def own_sets(batches):
        for batch in batches:
            for part in slices(batch, "t", SLICE_ROWS, SLICE_BYTES):
                sets = shingle_sets(part.column(1).to_pylist())
                keep = [(k, s.tobytes()) for k, s in zip(part.column(0).to_pylist(), sets) if k == _key(s)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.binary()), pa.array([s for _, s in keep], pa.binary())], names=["k", "own"])

    # One text of each wanted set: that of its least row, by id and hash, as ids may be null or repeat.
    texts = docs.select(F.col(doc_id).alias("own_id"), F.xxhash64(text).alias("own_h"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    same_row = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h"))
    sets = wanted.join(texts, same_row).select("k", "t").dropDuplicates(["k"]).mapInArrow(own_sets, "k binary, own binary")
    linked = members.join(sets, "k").repartition("name").sortWithinPartitions("name").mapInArrow(_links(threshold), "k binary, n long, `to` array<binary>")
    linked = checkpointed(linked)
    labels = contracted(linked.select(F.col("k").alias("a"), F.explode("to").alias("b")))
    counts = linked.groupBy("k").agg(F.sum("n").alias("links"))
    classes = nodes.select("k", "first", "copies").join(labels.withColumnRenamed("v", "k"), "k", "left").join(counts, "k", "left")
    classes = classes.select("k", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "k").alias("label"))
    heads = classes.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "k")).alias("h"))
    heads = heads.select("label", F.col("h.k").alias("class_k"), F.col("h.first").alias("class_id"))
    classes = classes.join(heads, "label").select("k", "first", "copies", "links", "class_k", "class_id")
    return rows.select("id", "k"), checkpointed(classes)


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All documents with the class and the number of links of each; copies are counted apart, not as links.

    A document without words is its own class.
    """
    rows, classes = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = rows.join(classes, "k", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one document of each class: its row of the least id.  Rows without words all stay.

    Of several rows of one id and one set the one of the least hash stays; wholly equal rows are one.  Null ids come
    after all others.  The columns are those of ``docs``, whatever their names; an empty table stays empty.
    """
    _, classes = near_duplicates(docs, text, doc_id, **how)
    key, place, row = (free(n, docs.columns) for n in ("_shingle_set", "_place", "_row_hash"))
    losers = classes.where(F.col("k") != F.col("class_k")).select(F.col("k").alias(key))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{key}` binary"])

    def with_key(batches):
        for batch in batches:
            for part in slices(batch, text, SLICE_ROWS, SLICE_BYTES):
                keys = [_key(s) for s in shingle_sets([t or "" for t in part.column(text).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=[*part.schema.names, key])

    worded = F.coalesce(F.col(f"`{text}`").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    keyed = docs.where(worded).mapInArrow(with_key, schema).withColumn(row, F.xxhash64(*hashed))
    first = Window.partitionBy(key).orderBy(F.col(f"`{doc_id}`").asc_nulls_last(), row)
    full = keyed.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    full = full.join(losers, key, "left_anti")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return full.select(*names).unionByName(docs.where(~worded).select(*names))
