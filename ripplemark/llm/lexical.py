"""Ranked lexical search: variable blocks chosen by dynamic programming, block-max WAND in every shard.

Two passes over the documents for a block of items.  The first counts what the weights need (documents, terms, the
documents of each asked term), the second reads the documents again, makes an index of the asked terms of each shard (a
bounded run of documents within a partition), searches it for every item and hands on the best of each item.  Nothing but
these best rows and the counts of asked terms is shuffled, and no index is kept, so a lost executor's shards are made again.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.llm.common import slices

#: Best documents of an item.
TOP = 10
#: A shard has at most so many documents and, but for its last document, so many postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
#: Longest block that the dynamic programming looks at, and what a block costs in mean scores of its list.
LONGEST, BLOCK_COST = 64, 4.0

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    return (text or b"").translate(_KEPT).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def block_ends(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int = LONGEST, cost: float = BLOCK_COST) -> np.ndarray:
    """A flag for the last posting of every block; ``x`` holds the scores of all lists, one after another.

    For each list the blocks of at most ``longest`` postings minimise the bound error, which is the sum over postings of
    (largest score of the block - own score), plus ``cost`` mean scores for each block.  All lists advance together.
    """
    order = np.argsort(-sizes, kind="stable")
    price = (cost * np.add.reduceat(x.astype(np.float64), starts) / sizes)[order]
    starts, sizes = starts[order], sizes[order]
    back = np.zeros(len(x), np.int32)
    lengths = np.arange(1, longest + 1, dtype=np.float64)
    # best[:, l - 1]: least cost of the postings before the last l; largest[:, l - 1]: largest score of the last l.
    best = np.full((len(sizes), longest), np.inf)
    best[:, 0] = 0
    largest = np.zeros((len(sizes), longest))
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j, "left"))
        best, largest = best[:n], largest[:n]
        score = x[starts[:n] + j].astype(np.float64)
        largest = np.maximum(np.concatenate([np.zeros((n, 1)), largest[:, :-1]], axis=1), score[:, None])
        total = best + largest * lengths
        length = np.argmin(total, axis=1)
        back[starts[:n] + j] = length + 1
        best = np.concatenate([(total[np.arange(n), length] + price[:n])[:, None], best[:, :-1]], axis=1)
    ends = np.zeros(len(x), bool)
    left = sizes.copy()
    while len(left):
        at = starts + left - 1
        ends[at] = True
        left = left - back[at]
        starts, left = starts[left > 0], left[left > 0]
    return ends


class Shard:
    """The postings of a run of documents in ascending order, in blocks of variable length with their largest scores.

    ``term`` and ``doc`` name each posting's term and document (a position in the run), ``x`` its score without weight.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, x: np.ndarray, longest: int = LONGEST):
        order = np.lexsort((doc, term))
        term, self.doc, self.x = term[order], doc[order], x[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        sizes = np.diff(np.append(first, len(term)))
        ends = np.flatnonzero(block_ends(self.x, first, sizes, longest))
        self.begin = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
        self.end = ends + 1
        self.most = np.maximum.reduceat(self.x, self.begin) if len(ends) else self.x
        own = np.searchsorted(self.begin, first)
        limits = np.append(own, len(ends))
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(term[first], limits, limits[1:])}
        self.largest = {t: int(self.most[a:b].max()) for t, (a, b) in self.lists.items()}

    def search(self, query: list[tuple[int, int]], top: int = TOP, run: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``top`` best for ``query`` (term, weight); ties go to the earlier document.

        As in block-max WAND, documents are passed in order with a threshold, the least score still wanted.  The block
        borders of the query's lists cut the documents into stretches within which every list stays in one block; a
        stretch whose blocks cannot exceed the threshold is skipped unread.  In the others a document is a pivot if the
        bounds of the blocks that hold it add up to more than the threshold, and only pivots are scored.  The threshold
        is renewed after a run of stretches; runs grow from ``run`` documents to twice the run before.
        """
        query = [(t, w) for t, w in query if w > 0 and t in self.lists]
        docs, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not query:
            return docs, scores
        spans = [self.lists[t] for t, _ in query]
        block = np.concatenate([np.arange(a, b) for a, b in spans])
        factor = np.repeat(np.array([w for _, w in query], np.int64), [b - a for a, b in spans])
        first, last = self.doc[self.begin[block]].astype(np.int64), self.doc[self.end[block] - 1].astype(np.int64)
        bound = self.most[block] * factor
        edges = np.unique(np.concatenate([first, last + 1]))
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, np.searchsorted(edges, first), bound)
        np.add.at(change, np.searchsorted(edges, last + 1), -bound)
        stretch = np.cumsum(change)
        whole = sum(self.largest[t] * w for t, w in query)
        at = 0
        while at < len(edges) - 1 and whole > threshold:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + run, "left")))
            to, run = min(to, len(edges) - 1), run * 2
            live = stretch[at:to] > threshold
            if live.any():
                low, high = edges[at], edges[to]
                met = np.flatnonzero((first < high) & (last >= low))
                alive = np.concatenate([[0], np.cumsum(live)])  # a block is read if one of its stretches is live
                met = met[alive[np.clip(np.searchsorted(edges, last[met], "right") - at, 0, to - at)] > alive[np.clip(np.searchsorted(edges, first[met]) - at, 0, to - at)]]
                length = self.end[block[met]] - self.begin[block[met]]
                posting = np.repeat(self.begin[block[met]] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                which = np.repeat(met, length)
                doc = self.doc[posting]
                inside = (doc >= low) & (doc < high)
                inside[inside] = live[np.searchsorted(edges, doc[inside], "right") - 1 - at]
                posting, which, doc = posting[inside], which[inside], doc[inside] - low
                bounds = np.zeros(high - low, np.int64)
                np.add.at(bounds, doc, bound[which])
                pivot = bounds > threshold
                scored = pivot[doc]
                exact = np.zeros(high - low, np.int64)
                np.add.at(exact, doc[scored], self.x[posting[scored]] * factor[which[scored]])
                new = np.flatnonzero(exact > threshold)
                docs, scores = np.concatenate([docs, new + low]), np.concatenate([scores, exact[new]])
                best = np.lexsort((docs, -scores))[:top]
                docs, scores = docs[best], scores[best]
                threshold = int(scores[-1]) if len(scores) == top else 0
            at = to
        return docs, scores


def _counts(shared, text: str):
    """For each asked term the documents of the partition that hold it; as terms -1 and -2 its documents and all their terms."""

    def run(batches):
        ids = shared.value[0]
        holding = np.zeros(len(ids), np.int64)
        documents = every = 0
        for batch in batches:
            for part in slices(batch, text, 4096, 16_000_000):
                for raw in _raw(part.column(text)):
                    found = terms(raw)
                    documents, every = documents + bool(found), every + len(found)
                    own = [ids[t] for t in set(found) if t in ids]
                    holding[own] += 1
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]]), pa.int64()), pa.array(np.concatenate([holding[some], [documents, every]]), pa.int64())], names=["term", "n"])

    return run


def _best(shared, doc_id: str, text: str, documents: int, every: int, top: int):
    """The best documents of every item in every shard."""

    def run(batches):
        ids, queries = shared.value
        held: dict = {}

        def clear():
            held.update(docs=[], n=[], term=[], tf=[], postings=0)

        def found():
            own = pa.concat_arrays(held["docs"])
            order = pc.sort_indices(own, null_placement="at_end").to_numpy()
            n = np.concatenate(held["n"])
            term = np.concatenate([np.fromiter(t, np.int64, len(t)) for t in held["term"]])
            tf = np.concatenate([np.fromiter(t, np.int64, len(t)) for t in held["tf"]])
            position = np.empty(len(own), np.int64)
            position[order] = np.arange(len(own))
            m = 25 + (75 * n * documents) // max(every, 1)
            row = np.repeat(np.arange(len(own)), [len(t) for t in held["term"]])
            shard = Shard(term, position[row], (1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            out = [(i, *shard.search(q, top)) for i, q in enumerate(queries)]
            clear()
            item = np.repeat([i for i, _, _ in out], [len(d) for _, d, _ in out])
            docs = own.take(pa.array(order[np.concatenate([d for _, d, _ in out])]))
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), docs, pa.array(np.concatenate([s for _, _, s in out]), pa.int64())], names=["item", "doc_id", "score"])

        clear()
        for batch in batches:
            for part in slices(batch, text, 1024, 8_000_000):
                counts = [Counter(terms(raw)) for raw in _raw(part.column(text))]
                held["docs"].append(part.column(doc_id))
                held["n"].append(np.array([c.total() for c in counts], np.int64))
                for c in counts:
                    own = [(ids[t], k) for t, k in c.items() if t in ids]
                    held["term"].append([t for t, _ in own])
                    held["tf"].append([k for _, k in own])
                    held["postings"] += len(own)
                if held["postings"] >= SHARD_POSTINGS or sum(map(len, held["n"])) >= SHARD_DOCS:
                    yield found()
        if held["docs"]:
            yield found()

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, words_per_pass: int = 200_000, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item with a score above 0, equal scores by ascending id.

    A null or empty text, or one without letters and digits, has no terms: such a document is not counted and never
    found, such an item finds nothing.  Texts of any length are taken whole.  Repeated documents count and are found
    each; null ids come after all others.  Wholly equal items are one; items of one id and different texts are searched
    apart, under the same id.  An empty table gives no rows.  Of the columns only the named ones are read.  One pair of
    passes over ``docs`` for each block of about ``words_per_pass`` item words.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    words = asked.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(words / 6 / words_per_pass))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = []
    for block in range(blocks):
        part = sorted(asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect(), key=lambda r: (str(r.i), r.t))
        own = [Counter(terms(r.t.encode())) for r in part]
        ids = {t: k for k, t in enumerate(sorted(set().union(*own)))}
        if not ids:
            continue
        asked_terms = spark.sparkContext.broadcast((ids, None))
        counts = docs.mapInArrow(_counts(asked_terms, "text"), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        held = {r.term: r.n for r in counts.collect()}
        documents, every = held.get(-1, 0), held.get(-2, 0)
        queries = [[(ids[t], c * weight(documents, held.get(ids[t], 0))) for t, c in sorted(q.items())] for q in own]
        shared = spark.sparkContext.broadcast((ids, queries))
        best = docs.mapInArrow(_best(shared, "doc_id", "text", documents, every, top), f"item bigint, doc_id {kind}, score bigint")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for keys in (["item", F.pmod(F.hash("doc_id"), F.lit(32))], ["item"]):  # first within parts of an item
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, r.i) for k, r in enumerate(part)], f"item bigint, item_id {asked.schema['i'].dataType.simpleString()}")
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    none = spark.createDataFrame([], f"item_id {asked.schema['i'].dataType.simpleString()}, rank int, doc_id {kind}, score bigint")
    return reduce(DataFrame.unionByName, found) if found else none


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """Contract query 13: all documents ranked for every benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)
