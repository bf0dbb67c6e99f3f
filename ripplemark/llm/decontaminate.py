"""Benchmark decontamination by Wu-Manber search over words.

The test strings are the 10-word windows of the benchmark's items (an item of fewer words is one window of its own
length).  Windows of one length form a table with three parts, all over words as letters: the block shift table says
how far a search may jump when it has just seen a two-word block, the suffix table lists the windows that end in a
block whose shift is 0, and comparing the words directly confirms an occurrence.  A block that no window holds lets the
search jump almost a whole window, so most words of a clean text are never looked at.

Windows are taken to the executors in blocks of about ``windows_per_pass``, a window of two items being two, so what is
broadcast has a fixed bound however large the benchmark is; every block passes over all documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplemark.llm.common import checkpointed, slices

WINDOW = 10
#: A to Z in lower case, other ASCII that is neither digit nor letter as a blank; bytes over 127 stay.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8 (null: none)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Windows of one length, with the items each belongs to."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.items = [(p, frozenset(i)) for p, i in patterns.items()]
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.suffix: dict = {}
        for at, (p, _) in enumerate(self.items):
            for end in range(self.block, length + 1):
                key = p[end - 1] if self.block == 1 else (p[end - 2], p[end - 1])
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.suffix.setdefault(key, []).append(at)

    def search(self, text: list[bytes]):
        """Start and items of every occurrence."""
        length, shift, default, one = self.length, self.shift.get, self.default, self.block == 1
        end, n = length - 1, len(text)
        while end < n:
            key = text[end] if one else (text[end - 1], text[end])
            jump = shift(key, default)
            if jump:
                end += jump
                continue
            start = end - length + 1
            window = tuple(text[start : end + 1])
            for at in self.suffix[key]:
                if self.items[at][0] == window:
                    yield start, self.items[at][1]
            end += 1


def windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``pattern`` (words joined by a blank, as binary), ``n`` words and ``item`` of every window, once each (the id may be null)."""

    def split(batches):
        for batch in batches:
            pattern, n, item = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(t)
                for k in range(max(1, len(w) - window + 1) if w else 0):
                    part = w[k : k + window]
                    pattern.append(b" ".join(part)), n.append(len(part)), item.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.binary()), pa.array(n, pa.int32()), pa.array(item, pa.string())], names=["pattern", "n", "item"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    return rows.mapInArrow(split, "pattern binary, n int, item string").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, windows_per_pass: int = 200_000, item_id: str = "item_id", text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the columns ``n_words``, ``hits`` (word spans ``start, end``, merged) and ``items`` (sorted ids).

    Each new name gets ``prefix``; no column of ``docs`` may have one of them.  Null or empty text: no words, no hits;
    very long texts are searched whole.  Empty tables: no rows, or no hits anywhere.  Repeated items share their windows
    and are all reported; an item without an id counts as hits but can be named nowhere, so it is in no ``items``.  No
    shuffle of documents; one pass over them for each block of about ``windows_per_pass`` windows (of one item each),
    adding to the spans and items of the one before.
    """
    spark = docs.sparkSession
    found = checkpointed(windows(benchmark, window, item_id))
    blocks = max(1, -(-found.count() // windows_per_pass))
    names = [f"{prefix}{c}" for c in ("n_words", "hits", "items")]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = docs.withColumns({names[0]: F.lit(None).cast("long"), names[1]: F.array().cast(span), names[2]: F.array().cast("array<string>")})
    for block in range(blocks):
        part = found.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == block).collect()
        tables: dict[int, dict] = {}
        for r in part:
            own = tables.setdefault(r.n, {}).setdefault(tuple(bytes(r.pattern).split(b" ")), set())
            own.update([r["item"]] if r["item"] is not None else [])
        shared = spark.sparkContext.broadcast(tables)
        out = _search(out, shared, names, text)
    return out


def _search(docs: DataFrame, shared, names: list[str], text: str) -> DataFrame:
    schema = docs.schema

    def run(batches):
        searchers = [WuManber(n, p) for n, p in shared.value.items()]
        for batch in (part for b in batches for part in slices(b, text, 1500, 8_000_000)):
            old = [batch.column(n).to_pylist() for n in names[1:]]
            count, hits, items = [], [], []
            for t, h, i in zip(batch.column(text).to_pylist(), *old, strict=True):
                w = words(t)
                spans, ids = [(s["start"], s["end"]) for s in h], set(i)
                for s in searchers:
                    for start, own in s.search(w):
                        spans.append((start, start + s.length))
                        ids |= own
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                count.append(len(w))
                hits.append([{"start": a, "end": b} for a, b in merged])
                items.append(sorted(ids))
            new = dict(zip(names, (count, hits, items), strict=True))
            kinds = {names[0]: pa.int64(), names[1]: pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), names[2]: pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], kinds[c]) if c in new else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query 6 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
