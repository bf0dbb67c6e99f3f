"""Which hashes occur more than once in a corpus, without bringing their owners together.

Documents are dealt into chunks of bounded size.  A chunk sends each of its distinct codes once, packed by bucket; a
bucket finds the codes that occur in two places and answers each chunk with its own; the chunk then finds the places
again.  So a window that a third of all documents hold costs one code a chunk and not one row a place, and no pair of
places is ever made.  Chunks and buckets grow in number with the data and are bounded in size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 6_000_000
BUCKET_ENTRIES = 1_000_000
LEAST = 192
#: A chunk with so many places of one code says so.
MANY = 8


def chunked(docs: DataFrame, key: list[str], text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``key`` columns, text and a ``chunk`` number for every document, and the total size of the texts in bytes.

    The chunk follows from the whole row, so null or repeated ids do not gather in one chunk.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(LEAST, math.ceil(total / chunk_bytes))
    return docs.select(F.pmod(F.xxhash64(*key, text), F.lit(chunks)).cast("int").alias("chunk"), *key, F.coalesce(text, F.lit("")).alias("text")), total


def bucket_count(entries: int, bucket_entries: int = BUCKET_ENTRIES) -> int:
    return max(256, math.ceil(entries / bucket_entries))


def member(high: np.ndarray, low: np.ndarray, known_high: np.ndarray, known_low: np.ndarray) -> np.ndarray:
    """Which pairs ``high, low`` are among the known pairs, all bits compared."""
    if not len(known_high):
        return np.zeros(len(high), bool)
    order = np.lexsort((known_low, known_high))
    known_high, known_low = known_high[order], known_low[order]
    at = np.searchsorted(known_high, high)
    found = np.zeros(len(high), bool)
    open_ = np.flatnonzero(at < len(known_high))
    open_ = open_[known_high[at[open_]] == high[open_]]
    while len(open_):  # goes on past known pairs of one high half
        found[open_] |= known_low[at[open_]] == low[open_]
        at[open_] += 1
        open_ = open_[~found[open_] & (at[open_] < len(known_high))]
        open_ = open_[known_high[at[open_]] == high[open_]]
    return found


def packed(codes: np.ndarray, buckets: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Bucket numbers and the bytes of the codes in each; codes come ordered by bucket."""
    if not len(codes):
        return [], []
    cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
    return buckets[cuts[:-1]].tolist(), [codes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def repeated(sent: DataFrame, dtype: np.dtype, code_of, indexed: int = 0, multi: int = 0, many: int = 0, most: int = 0) -> DataFrame:
    """Of rows ``chunk, bucket, codes``: ``chunk, bucket, codes`` again, cut down to the codes found in two places.

    ``code_of(array)`` takes the flag bits off a code.  ``multi`` is the flag of a code that its chunk holds twice or
    more.  With ``indexed`` given, one of the places must carry that flag.  With ``many`` given, a code's flag ``many``
    counts as ``MANY`` places of its chunk, and the answers have it for all codes of over ``most`` places.
    """

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        parts = [np.frombuffer(b, dtype) for b in table.column("codes").to_pylist()]
        every = np.concatenate(parts)
        plain = code_of(every)
        order = np.argsort(plain, kind="stable")
        ordered = plain[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(new)
        places = np.diff(np.append(starts, len(ordered)))
        twice = places > 1
        flags = every[order] if every.dtype.names is None else every["low"][order]
        if multi:
            twice |= np.bitwise_or.reduceat(flags & flags.dtype.type(multi), starts) > 0
        if indexed:
            twice &= np.bitwise_or.reduceat(flags & flags.dtype.type(indexed), starts) > 0
        keep = np.empty(len(every), bool)
        keep[order] = np.repeat(twice, places)
        if many:
            hot = places + (MANY - 1) * np.add.reduceat((flags & flags.dtype.type(many)) > 0, starts, dtype=np.int64) > most
            answers = np.empty_like(every)
            answers[order] = ordered | np.where(np.repeat(hot, places), every.dtype.type(many), every.dtype.type(0))
            cuts = np.cumsum([len(p) for p in parts])[:-1]
            parts = np.split(answers, cuts)
        ends = np.cumsum([len(p) for p in parts])
        out = [(c, p[keep[e - len(p) : e]]) for c, p, e in zip(chunks, parts, ends.tolist())]
        out = [(c, p.tobytes()) for c, p in out if len(p)]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "codes": pa.array([p for _, p in out], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "chunk int, bucket int, codes binary")
