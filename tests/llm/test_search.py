"""Embedding links, centroids and ranked search against brute force, on odd rows: nulls, empty and long values, ties, repeated rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from ripplemark.llm import centroids, covertree, lexical

RND = np.random.default_rng(3)
VECTORS = "vec_id bigint, embedding array<double>, label int, id string, k binary, cell string, n_links int, own int"


def vector_rows():
    """Families of near copies around few directions in three labels, a hot family, and every kind of vector that has no link."""
    rows = []
    for i in range(900):
        family = i % 9 if i % 3 else 99  # a third of all rows is one family
        base = np.random.default_rng(family).normal(size=8)
        rows.append((i, (base + RND.normal(size=8) * (0.02 if family == 99 else 0.25)).tolist(), i % 3))
    far = RND.normal(size=8).tolist()
    odd = [None, [], [0.0] * 8, [None] + far[1:], [math.nan] + far[1:], [math.inf] + far[1:], far[:5]]
    rows += [(1000 + j, v, 1) for j, v in enumerate(odd)]
    rows += [rows[3], rows[3], (None, rows[3][1], 0), (None, far, 0), (2000, rows[3][1], None), (2001, [x * 1e300 for x in rows[3][1]], 0), (2002, [x * 1e-300 for x in rows[3][1]], 0)]
    return rows


def linked(rows, threshold=0.93):
    """``id, n_links, component`` of every row by all pairs of a label."""
    fit = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / max(map(abs, rows[i][1])) for i in fit}
    unit = {i: u / np.sqrt((u * u).sum()) for i, u in unit.items()}
    near: dict = {i: [] for i in range(len(rows))}
    for i in fit:
        for j in fit:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                near[i].append(j)
    seen: dict = {}
    for i in near:
        if i not in seen:
            reach, todo = {i}, [i]
            while todo:
                new = [j for j in near[todo.pop()] if j not in reach]
                reach.update(new)
                todo += new
            least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
            seen.update(dict.fromkeys(reach, least))
    return Counter((r[0], len(near[i]), seen[i] if seen[i] is not None else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block,fan,deepest", [(2048, 16, 12), (60, 4, 12), (60, 3, 1), (60, 3, 0)])
def test_links(spark, block, fan, deepest):
    """In one tree, in cells of several splits, and in parts by hash where splits end; hot families outgrow a cell."""
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", b"k", "c", 5, 6) for r in rows], VECTORS).repartition(3)
    got = covertree.near_vectors(df, block=block, fan=fan, deepest=deepest)
    expected = linked(rows)
    assert Counter(map(tuple, got.collect())) == expected
    assert max(n for _, n, _ in expected) > 60


def test_links_of_no_rows(spark):
    assert covertree.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    none = spark.createDataFrame([(1, None, None, None, None, None, None, None)] * 2, VECTORS)
    assert [tuple(r) for r in covertree.near_vectors(none).collect()] == [(1, 0, 1)] * 2


@pytest.mark.parametrize("spread", [0.01, 0.2, 1.0])
def test_levels(spread):
    """Nodes of a level are further apart than its radius, every vector is that near to one, radii cover what hangs below."""
    base = RND.normal(size=(6, 5))
    x = covertree.unit(base[RND.integers(0, 6, 300)] + RND.normal(size=(300, 5)) * spread)
    order, parent, sizes, radii = covertree.CoverTree.order(x, 0.01)
    x = x[order]
    tree = covertree.CoverTree(x, np.ones(300, np.int64), parent, sizes, radii)
    far = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    assert sizes[0] == 1 and sizes[-1] == 300 and sizes == sorted(sizes)
    for i, s in enumerate(sizes[:-1]):
        r = 2.0 / 2**i
        assert (far[:, :s].min(axis=1) <= r + 1e-9).all()
        if s > 1:
            assert far[:s, :s][np.triu_indices(s, 1)].min() > r - 1e-6
    for s, above, radius in zip(sizes, tree.above, radii):
        assert (above[:s] == np.arange(s)).all()  # nested
        assert (far[np.arange(300), above] <= radius[above] + 1e-12).all()


def test_links_at_the_threshold():
    """Cosines that miss or exceed the threshold by 1e-8 to 1e-11, in one tree and between two."""
    rnd = np.random.default_rng(9)
    for _ in range(60):
        base = covertree.unit(rnd.normal(size=(1, 8)))[0]
        rows = [base]
        for off in (1e-8, 1e-9, 1e-10, 1e-11, -1e-8, -1e-9, -1e-10, -1e-11):
            side = rnd.normal(size=8)
            side -= side @ base * base
            cosine = 0.93 + off
            rows.append(cosine * base + math.sqrt(1 - cosine * cosine) * side / np.sqrt(side @ side))
        x = covertree.unit(np.array(rows))
        near = x @ x.T >= 0.93
        assert near[0].sum() == 5
        trees = []
        for part in (np.arange(9), np.arange(1), np.arange(1, 9)):
            order, parent, sizes, radii = covertree.CoverTree.order(x[part], 0.01)
            trees.append((covertree.CoverTree(x[part][order], np.ones(len(part), np.int64), parent, sizes, radii), part[order]))
        (all_, own), (one, _), (others, rest) = trees
        assert covertree.links(all_, all_, 0.93, True)[0].tolist() == (near.sum(axis=1) - 1)[own].tolist()
        left, right, _ = covertree.links(one, others, 0.93, False)
        assert left.tolist() == [4] and right.tolist() == near[0][rest].astype(int).tolist()


def whole(v):
    return [math.floor(Fraction(x) * 64) for x in v]


def by_hand(rows, k=16, rounds=3):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for t in range(rounds + 1):
        own = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
        if t < rounds:
            groups = [[v for (_, v), o in zip(kept, own) if o == j] for j in range(len(c))]
            c = [[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(groups, c)]
    return Counter((i, o, d if d < 1 << 63 else None) for (i, v), o in zip(kept, own) for d in [far(v, c[o])]), c


def cluster_rows(big=False):
    base = RND.normal(size=(7, 64)) / 8
    rows = [(i, (base[i % 7 if i % 3 else 0] + RND.normal(size=64) * 0.02).tolist()) for i in range(300)]
    rows += [(400 + i, [0.25] * 64) for i in range(30)]  # ties in plenty
    rows += [rows[5], rows[5], (None, rows[6][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [None] + [1.0] * 63), (504, [math.nan] * 64), (505, [math.inf] * 64)]
    return rows + ([(600, [1e12] * 64), (601, [-1e300] * 64), (602, [2.0**60] + [0.1] * 63)] if big else [])


@pytest.mark.parametrize("big,k", [(False, 16), (False, 3), (False, 1), (True, 16), (False, 1000)])
def test_clusters(spark, big, k):
    rows = cluster_rows(big)
    df = spark.createDataFrame([(i, v, 1, "x", b"k", "c", 5, 6) for i, v in rows], VECTORS).repartition(3)
    found, last = centroids.clusters(df, k=k)
    expected, c = by_hand(rows, k)
    assert Counter(map(tuple, found.collect())) == expected and last == c


def test_clusters_of_no_rows(spark):
    found, last = centroids.clusters(spark.createDataFrame([(1, None, 1, None, None, None, None, None)], VECTORS))
    assert found.count() == 0 and last == []


def test_exponion_scans_few():
    """Bounds decide for most vectors of separate groups, and what they decide is what a scan of all centroids finds."""
    base = RND.integers(-400, 400, (16, 64))
    x = (np.repeat(base, 200, axis=0) + RND.integers(-9, 9, (3200, 64))).astype(np.int64)
    c = centroids.Centroids((base + 20).tolist())
    state = c.plain(x)
    moved = c.next(base.tolist())
    calls = []
    plain, centroids.squares = centroids.squares, lambda a, b: calls.append(len(a)) or plain(a, b)
    try:
        got = moved.assign(x, *state)
    finally:
        centroids.squares = plain
    assert (got[0] == moved.plain(x)[0]).all()
    assert sum(calls) < len(x) * 4
    upper, lower = (np.sqrt(np.sort(((x[:, None] - moved.values[None]) ** 2).sum(axis=2), axis=1)[:, j]) for j in (0, 1))
    assert (got[1] >= upper - 1e-6).all() and (got[2] <= lower + 1e-6).all()


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def ranked(docs, items, top=10):
    split = lambda t: TERM.findall((t or "").translate(UPPER))
    texts = [(i, Counter(split(t))) for i, t in docs]
    big_n, big_l = sum(bool(c) for _, c in texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = Counter()
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in texts:
            m = 25 + (75 * c.total() * big_n) // big_l if big_l else 0
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            scores += [(-s, i is None, i or 0, i)] if s > 0 else []
        out.update((item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1))
    return out


DOCS, ITEMS = "doc_id bigint, text string, item bigint, score double, term string, rank int", "item_id string, text string, i int, t int"


@pytest.fixture(scope="module")
def library():
    rnd = random.Random(9)
    words = [f"Wort{i}" for i in range(60)] + ["Été", "naïve", "日本", "x2"]
    draw = lambda n: " ".join(rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=n))
    docs = [(i, draw(rnd.randint(1, 80))) for i in range(700)] + [(700 + i, "the same words, each time") for i in range(30)]
    docs += [docs[5], docs[5], (None, docs[6][1]), (None, None), (900, None), (901, ""), (902, " -\n_!"), (903, draw(30_000)), (904, "wort1" * 5000)]
    items = [(f"i{i}", draw(rnd.randint(1, 40))) for i in range(25)] + [("copy", "same WORDS"), ("copy", "same WORDS"), ("copy", "wort3 wort3 Wort3 wort4"), (None, "each time"), ("no", None), ("none", "..."), ("absent", "nowhere"), ("long", draw(5000))]
    return docs, items


@pytest.mark.parametrize("shard,passes,top", [(16_384, 200_000, 10), (64, 200_000, 10), (50, 1000, 3)])
def test_search(spark, library, monkeypatch, shard, passes, top):
    """In one shard for each partition, in many small ones, and with the items in several passes."""
    docs, items = library
    df = spark.createDataFrame([(*r, 1, 2.0, "x", 3) for r in docs], DOCS).repartition(3)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    found = lexical.search(df, spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS), top=top, words_per_pass=passes)
    assert Counter(map(tuple, found.collect())) == ranked(docs, items, top)


def test_search_of_no_rows(spark, library):
    docs, items = (spark.createDataFrame(rows, schema) for rows, schema in (([(1, "a", 1, 1.0, "", 1)], DOCS), ([("i", "a", 1, 1)], ITEMS)))
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items).collect()[0][:3] == ("i", 1, 1)


def test_block_borders():
    """The dynamic programming is as cheap as the best of all cuts, and blocks that cannot matter are not read."""
    for _ in range(30):
        x = RND.integers(1, 50, RND.integers(1, 10))
        price = 2.0 * x.mean()
        ends = lexical.block_ends(x, np.array([0]), np.array([len(x)]), longest=6, cost=2.0)
        paid = lambda cuts: sum((b - a) * x[a:b].max() - x[a:b].sum() + price for a, b in zip(cuts, cuts[1:])) if all(b - a <= 6 for a, b in zip(cuts, cuts[1:])) else math.inf
        best = min(paid([0, *[i + 1 for i in range(len(x) - 1) if bits >> i & 1], len(x)]) for bits in range(1 << len(x) - 1))
        assert abs(paid([0, *(np.flatnonzero(ends) + 1).tolist()]) - best) < 1e-9
    n = 20_000
    x = np.where(np.arange(n) < 50, 900, RND.integers(1, 30, n))
    shard = lexical.Shard(np.zeros(n, np.int64), np.arange(n), x)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at)) if isinstance(at, np.ndarray) else None
            return np.asarray(super().__getitem__(at))

    shard.x = shard.x.view(Watched)
    docs, scores = shard.search([(0, 1)])
    assert docs.tolist() == list(range(10)) and set(scores.tolist()) == {900}
    assert sum(read) < 1000
