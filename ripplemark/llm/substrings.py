"""Exact substring deduplication with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words, which are indexed, and is
probed with every rolling window of that length.  A repeat of ``window`` words holds one whole reference block of each
of its places, so the block meets the other place's rolling window: both places are anchored.  An anchor is extended by
looking at every ``window``-word string around it; those that start in two places join up to the maximal exact repeats.

Blocks and windows meet as codes (see :mod:`repeats`): documents are dealt into chunks once, 4 bytes a word go out for
the anchors and 12 bytes for each distinct window around an anchor, and as many come back.  Windows are compared by 95
bits of two independent polynomial hashes of the words' 128-bit digests and by the bucket, which other bits give; all of
these bits are compared in the buckets and again where the answers are applied.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ripplemark.llm.common import mixed
from ripplemark.llm.repeats import bucket_count, chunked, member, packed, repeated

WINDOW = 35
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STRONG = np.dtype([("high", "<u8"), ("low", "<u4")])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Words:
    """The words of a chunk's texts, one after another, as two 64-bit numbers each."""

    def __init__(self, texts: list[str]):
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.tokens = [w for s in split for w in s]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.tokens), np.int64, len(self.tokens))
        digest = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in known), np.uint64).reshape(-1, 2)
        self.a, self.b = (digest[ids, 0], digest[ids, 1]) if len(ids) else (np.empty(0, np.uint64),) * 2

    def rolling(self, values: np.ndarray, length: int, base: int) -> np.ndarray:
        """The hash of every string of ``length`` words; those that run over the end of a text are not to be used."""
        n = len(values) - length + 1
        if n < 1:
            return np.empty(0, np.uint64)
        out, power = np.zeros(n, np.uint64), _powers(base, length)
        for i in range(length):
            out += values[i : i + n] * power[i]
        return mixed(out)

    def inside(self, length: int) -> np.ndarray:
        """Where strings of ``length`` words of one text start."""
        room = np.maximum(self.counts - length + 1, 0)
        at = np.repeat(self.starts - np.concatenate([[0], np.cumsum(room)])[:-1], room)
        return at + np.arange(room.sum())


def _anchors(words: Words, window: int, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rolling windows in texts of at least ``window`` words, with their codes and buckets."""
    long = words.counts >= window
    at = words.inside(block)
    offset = at - np.repeat(words.starts, np.maximum(words.counts - block + 1, 0))
    ok = np.repeat(long, np.maximum(words.counts - block + 1, 0))
    at, offset = at[ok], offset[ok]
    h = words.rolling(words.a, block, _BASES[0])[at]
    code = ((h >> np.uint64(34)) << np.uint64(2)).astype(np.uint32) | (offset % block == 0).astype(np.uint32)
    return at, code, ((h & np.uint64(0x3FFFFFFFF)) % np.uint64(buckets)).astype(np.int32)


def _near(words: Words, window: int, block: int, at: np.ndarray) -> np.ndarray:
    """Starts of the ``window``-word strings that hold an anchor starting in ``at``."""
    edge = np.zeros(len(words.tokens) + 1, np.int32)
    text = np.searchsorted(words.starts, at, "right") - 1
    low = np.maximum(at + block - window, words.starts[text])
    np.add.at(edge, low, 1)
    np.add.at(edge, at + 1, -1)
    held = np.cumsum(edge[:-1]) > 0
    inside = words.inside(window)
    return inside[held[inside]]


def _strong(words: Words, window: int, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.empty(len(at), _STRONG)
    out["high"] = words.rolling(words.a, window, _BASES[0])[at]
    low = words.rolling(words.b, window, _BASES[1])[at]
    out["low"] = (low & np.uint64(0xFFFFFFFE)).astype(np.uint32)
    return out, ((low >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _texts(table: pa.Table) -> list[str]:
    return table.column("text").to_pylist()


def _found(replies: pa.Table, dtype) -> dict[int, np.ndarray]:
    return {b: np.frombuffer(c, dtype) for b, c in zip(replies.column("bucket").to_pylist(), replies.column("codes").to_pylist())}


def _rows(chunk: int, sent: tuple[list[int], list[bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([chunk] * len(sent[0]), pa.int32()), "bucket": pa.array(sent[0], pa.int32()), "codes": pa.array(sent[1], pa.binary())})


_SENT = "chunk int, bucket int, codes binary"


def repeated_spans(docs: DataFrame, key: list[str], rows, schema: str, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``rows(texts, tokens, flags)`` for every chunk, beside the ``key`` columns.

    ``tokens`` are the words of each text and ``flags`` tells which of them lie in a ``window``-word string whose words
    also start anywhere else, in the same document or another, judged on the input.  Null and empty texts and texts of
    fewer words have no such string.  Repeated rows repeat each other.  ``key`` may hold nulls and repeats.
    """
    block = (window + 1) // 2
    dealt, total = chunked(docs, key, text)
    groups = dealt.groupBy("chunk")
    buckets = bucket_count(total // 5)

    def probe(table: pa.Table) -> pa.Table:
        _, code, bucket = _anchors(Words(_texts(table)), window, block, buckets)
        order = np.lexsort((code, bucket))
        code, bucket = code[order], bucket[order]
        plain = code & ~np.uint32(3)
        first = np.ones(len(code), bool)
        first[1:] = (plain[1:] != plain[:-1]) | (bucket[1:] != bucket[:-1])
        starts = np.flatnonzero(first)
        if not len(starts):
            return _rows(0, ([], []))
        merged = np.bitwise_or.reduceat(code, starts) | np.where(np.diff(np.append(starts, len(code))) > 1, np.uint32(2), np.uint32(0))
        return _rows(table.column("chunk")[0].as_py(), packed(merged, bucket[starts]))

    anchors = repeated(groups.applyInArrow(probe, _SENT), np.dtype("<u4"), lambda x: x & np.uint32(0xFFFFFFFC), indexed=1, multi=2)

    def near(words: Words, replies: pa.Table) -> np.ndarray:
        at, code, bucket = _anchors(words, window, block, buckets)
        known = [(np.uint64(b) << np.uint64(32)) | (c & np.uint32(0xFFFFFFFC)).astype(np.uint64) for b, c in _found(replies, np.dtype("<u4")).items()]
        if not known:
            return at[:0]
        hit = np.isin((bucket.astype(np.uint64) << np.uint64(32)) | (code & np.uint32(0xFFFFFFFC)).astype(np.uint64), np.concatenate(known))
        return _near(words, window, block, at[hit])

    def extend(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _rows(0, ([], []))
        words = Words(_texts(table))
        strong, bucket = _strong(words, window, near(words, replies), buckets)
        order = np.lexsort((strong["low"], strong["high"], bucket))
        strong, bucket = strong[order], bucket[order]
        first = np.ones(len(strong), bool)
        first[1:] = strong[1:] != strong[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return _rows(0, ([], []))
        merged = strong[starts]
        merged["low"] |= (np.diff(np.append(starts, len(strong))) > 1).astype(np.uint32)
        return _rows(table.column("chunk")[0].as_py(), packed(merged, bucket[starts]))

    def plain(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), _STRONG)
        out["high"], out["low"] = x["high"], x["low"] & np.uint32(0xFFFFFFFE)
        return out.view("V12").ravel()

    windows = groups.cogroup(anchors.groupBy("chunk")).applyInArrow(extend, _SENT)
    again = repeated(windows, _STRONG, plain, multi=1)
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*key).schema.fields}

    def mark(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t.type) for n, t in zip(key, [table.column(k) for k in key])} | rows([], [], []))
        texts = _texts(table)
        words = Words(texts)
        covered = np.zeros(len(words.tokens), bool)
        known = _found(replies, _STRONG)
        if known:
            inside = words.inside(window)
            strong, bucket = _strong(words, window, inside, buckets)
            full = lambda low, b: (low & np.uint32(0xFFFFFFFE)).astype(np.uint64) | (np.asarray(b).astype(np.uint64) << np.uint64(32))
            lows = np.concatenate([full(x["low"], np.full(len(x), b)) for b, x in known.items()])
            at = inside[member(strong["high"], full(strong["low"], bucket), np.concatenate([x["high"] for x in known.values()]), lows)]
            edge = np.zeros(len(words.tokens) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
        ends = (words.starts + words.counts).tolist()
        spans = list(zip(words.starts.tolist(), ends))
        out = rows(texts, [words.tokens[a:b] for a, b in spans], [covered[a:b] for a, b in spans])
        return pa.table({k: table.column(k) for k in key} | out)

    full = ", ".join([*(f"`{n}` {kinds[n]}" for n in key), schema])
    return groups.cogroup(again.groupBy("chunk")).applyInArrow(mark, full)


def dedup_substrings(docs: DataFrame, key: list[str], window: int = WINDOW, text: str = "text", kept_text: bool = False) -> DataFrame:
    """``key`` columns with ``n_words``, ``n_removed``, the hash of the kept words joined by a blank, and they if asked.

    Null and empty texts have no words; texts of any length are taken whole; wholly repeated rows repeat each other, so
    all their windows go.  An empty table gives an empty result.  Only ``key`` and ``text`` are read; ``key`` columns may
    not be named ``chunk`` or as the new columns.
    """

    def rows(texts, tokens, flags):
        kept = [b" ".join([w for w, f in zip(t, g.tolist()) if not f]) if g.any() else b" ".join(t) for t, g in zip(tokens, flags)]
        out = {
            "n_words": pa.array(map(len, tokens), pa.int64()),
            "n_removed": pa.array([int(g.sum()) for g in flags], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        return out | ({"kept_text": pa.array([k.decode() for k in kept], pa.string())} if kept_text else {})

    return repeated_spans(docs, key, rows, "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * kept_text, window, text)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query 5 over all documents."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
