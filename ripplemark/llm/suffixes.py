"""Suffix-array deduplication of long byte strings.

``suffix_array`` is the linear grouping construction: suffixes are grouped by their longest Lyndon prefix while groups
are processed in descending order with previous-smaller pointers, and a second pass emits the order inside each group
from the pointers alone; no suffix is renamed recursively.

A suffix array needs its strings in one place, and a corpus does not fit in one.  So strings are brought together by an
anchor: of the ``GRAM``-byte grams in a ``length``-byte string, the one with the least hash (leftmost on a tie).  Equal
strings have equal anchors at equal offsets.  Consecutive strings with one anchor in the same half of their length form
a segment, all strings of which share a core of over half their length; equal strings lie in segments with equal cores.
Segments whose core occurs once are ruled out first (see :mod:`repeats`).  What remains is sent once for each distinct
segment of a chunk to the bucket of its core, where identical segments are one and different segments with one core go
into a suffix array: strings that start twice are neighbours there, and neighbours are compared byte by byte.

The core keeps buckets small where many near copies share an anchor: copies that differ inside the core part ways, and
copies that agree around it too are one segment.  A core of over ``MOST`` places (a passage that a large part of the
corpus holds, in other surroundings each time) does not go into one array: its strings are dealt by two hashes of their
own and meet as 16-byte codes, once a chunk each.  Equal segments are settled by counting; the array orders different
segments of one core, so it decides the repeats at the ends of shared passages.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ripplemark.llm.common import mixed
from ripplemark.llm.repeats import MANY, bucket_count, chunked, member, packed, repeated

LENGTH = 400
GRAM = 64
#: Not in any UTF-8 text.
PARTING = b"\xff"
_BASE = 0x9E3779B97F4A7C15
_OTHER_BASE = 0xC2B2AE3D27D4EB4F
#: Places of a core up to which its segments are compared in one suffix array (at most 170 kB at the default length).
MOST = 256
_STRING = np.dtype([("high", "<u8"), ("low", "<u8")])


def _powers(base: int, n: int) -> np.ndarray:
    power = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    power[0] = 1
    return np.cumprod(power, out=power)


def suffix_array(s: bytes) -> list[int]:
    """The suffixes of ``s`` in ascending order (a suffix that is a prefix of another comes first)."""
    n = len(s)
    by_byte: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_byte.setdefault(c, []).append(i)
    members = [by_byte[c] for c in sorted(by_byte)]
    group = [0] * n
    for k, own in enumerate(members):
        for i in own:
            group[i] = k
    size = [len(own) for own in members]
    above, below = [*range(1, len(members)), -1], list(range(-1, len(members) - 1))
    done = [False] * len(members)
    smaller = [-1] * n  # the nearest smaller suffix to the left
    descending = []
    at = len(members) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at], done[at] = own, True
        descending.append(at)
        children: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                children[p] = children.get(p, 0) + 1
        # Places of one group with equally many children here grow by the same word: they part from it, upwards.
        parting: dict[tuple[int, int], list[int]] = {}
        for p, k in children.items():
            parting.setdefault((k, group[p]), []).append(p)
        for k, g in sorted(parting, reverse=True):
            moved = parting[k, g]
            if len(moved) == size[g]:
                continue  # nothing is left below them
            new = len(members)
            members.append(moved)
            done.append(False)
            size.append(len(moved))
            size[g] -= len(moved)
            over = above[g]
            above.append(over)
            below.append(g)
            above[g] = new
            if over >= 0:
                below[over] = new
            for p in moved:
                group[p] = new
        at = below[at]
    start, total = [0] * len(members), 0
    for g in reversed(descending):
        start[g] = total
        total += len(members[g])
    out = [-1] * n
    placed = [False] * n

    def place(j: int) -> None:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = True
            j = smaller[j]

    place(n - 1)  # what comes before the empty suffix
    for k in range(n):
        place(out[k] - 1)
    return out


def twice(segments: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each of different segments, the ranges of offsets whose ``length``-byte strings start in another place too."""
    s = PARTING.join(segments) + PARTING
    order = suffix_array(s)
    starts = np.cumsum([0, *(len(x) + 1 for x in segments)])
    room = np.zeros(len(s), bool)
    for b, x in zip(starts.tolist(), segments):
        room[b : b + len(x) - length + 1] = True
    sa = np.array(order, np.int64)
    pairs = np.flatnonzero(room[sa[1:]] & room[sa[:-1]])
    found = np.zeros(len(s) + 1, np.int8)
    for k in pairs.tolist():
        i, j = order[k], order[k + 1]
        if s[i : i + length] == s[j : j + length]:
            found[i] = found[j] = 1
    edges = np.flatnonzero(np.diff(found, prepend=0))
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
        k = int(np.searchsorted(starts, i, "right")) - 1
        out[k].append((i - int(starts[k]), j - int(starts[k])))
    return out


class Segments:
    """The segments of a chunk's texts: ``begin``, ``end`` and the hash of the ``core`` of each."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.data = b"".join(texts)
        self.counts = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        room = np.maximum(self.counts - length + 1, 0)
        at = np.repeat(self.starts - np.concatenate([[0], np.cumsum(room)])[:-1], room) + np.arange(room.sum())
        self.begin = self.end = self.core = np.empty(0, np.int64)
        if not len(at):
            return
        n, width = len(self.data), length - gram + 1
        total, power = self._sums(_BASE)
        grams = mixed((total[gram:] - total[:-gram]) * power[: n - gram + 1])
        keys = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        del grams
        blocks = np.full(-(-len(keys) // width) * width, ~np.uint64(0), np.uint64)
        blocks[: len(keys)] = keys
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[at], ahead[at + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        half = -(-width // 2)
        side = (anchor - at) // half
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (side[1:] != side[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        self.begin, self.end = at[first], at[last] + length
        core = anchor[first] - side[first] * half  # inside every string of the segment
        self.core = mixed((total[core + length - half + 1] - total[core]) * power[core] + side[first].astype(np.uint64))

    def _sums(self, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the bytes times growing powers of ``base`` the sums up to each place, and the inverse powers."""
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(np.frombuffer(self.data, np.uint8) * _powers(base, len(self.data)), out=total[1:])
        return total, _powers(pow(base, -1, 1 << 64), len(self.data))

    def hashes(self, at: np.ndarray, length: int, base: int) -> np.ndarray:
        """The hash of the ``length``-byte string at each place."""
        total, power = self._sums(base)
        return mixed((total[at + length] - total[at]) * power[at])

    def strings(self, which: np.ndarray, length: int) -> np.ndarray:
        """The places of the strings of the segments ``which``."""
        count = self.end[which] - self.begin[which] - length + 1
        return np.repeat(self.begin[which] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())

    def text(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.end[k]]


def _digest(segment: bytes) -> bytes:
    return hashlib.blake2b(segment, digest_size=16).digest()


_SENT = "chunk int, bucket int, codes binary"
_TEXTS = "chunk int, bucket int, cores binary, multi binary, segments array<binary>, strings binary, hot binary"
_REPLY = "chunk int, bucket int, cores binary, digests binary, ranges binary, strings binary, hot binary"


def repeated_bytes(docs: DataFrame, key: list[str], rows, schema: str, length: int = LENGTH, gram: int = GRAM, text: str = "text", chunk_bytes: int = 3_000_000, most: int = MOST) -> DataFrame:
    """``rows(texts, flags)`` for every chunk, beside the ``key`` columns.

    ``texts`` are UTF-8 and ``flags`` tell which bytes lie in a ``length``-byte string that also starts anywhere else,
    in the same text or another, judged on the input.  Null texts are empty; texts of under ``length`` bytes have no
    such string.  Repeated rows repeat each other.  ``key`` may hold nulls and repeats.
    """
    dealt, total = chunked(docs, key, text, chunk_bytes)
    groups = dealt.groupBy("chunk")
    buckets = bucket_count(total // 40)

    def segments(table: pa.Table) -> tuple[list[bytes], Segments]:
        texts = [t.encode() for t in table.column("text").to_pylist()]
        return texts, Segments(texts, length, gram)

    def coded(core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (core >> np.uint64(34)).astype(np.uint32) << np.uint32(2), ((core & np.uint64(0x3FFFFFFFF)) % np.uint64(buckets)).astype(np.int32)

    def cores(table: pa.Table) -> pa.Table:
        code, bucket = coded(segments(table)[1].core.astype(np.uint64))
        order = np.lexsort((code, bucket))
        code, bucket = code[order], bucket[order]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])
        starts = np.flatnonzero(first)
        places = np.diff(np.append(starts, len(code)))
        merged = code[starts] | (places > 1).astype(np.uint32) | ((places >= MANY).astype(np.uint32) << np.uint32(1))
        numbers, codes = packed(merged, bucket[starts])
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(numbers), pa.int32()), "bucket": pa.array(numbers, pa.int32()), "codes": pa.array(codes, pa.binary())})

    known = repeated(groups.applyInArrow(cores, _SENT), np.dtype("<u4"), lambda x: x & np.uint32(0xFFFFFFFC), multi=1, many=2, most=most)

    def dealt_strings(own: Segments, which: np.ndarray) -> tuple[list[int], list[bytes]]:
        """The codes of the strings of hot cores, once each: the lowest bit tells that the chunk has two."""
        at = own.strings(which, length)
        codes = np.empty(len(at), _STRING)
        codes["high"], codes["low"] = own.hashes(at, length, _BASE), own.hashes(at, length, _OTHER_BASE) & ~np.uint64(1)
        bucket = (codes["low"] >> np.uint64(1)) % np.uint64(buckets)
        order = np.lexsort((codes["low"], codes["high"], bucket))
        codes, bucket = codes[order], bucket[order].astype(np.int32)
        first = np.ones(len(codes), bool)
        first[1:] = codes[1:] != codes[:-1]
        starts = np.flatnonzero(first)
        merged = codes[starts]
        merged["low"] |= (np.diff(np.append(starts, len(codes))) > 1).astype(np.uint64)
        return packed(merged, bucket[starts])

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        by_bucket: dict[int, dict[tuple[int, bytes], bool]] = {}
        numbers: list[int] = []
        strings: list[bytes] = []
        marks: list[bytes] = []  # the hot cores themselves, which come back to the chunk beside the answers
        if table.num_rows and replies.num_rows:
            _, own = segments(table)
            core = own.core.astype(np.uint64)
            code, bucket = coded(core)
            full = np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(c, "<u4").astype(np.uint64) for b, c in zip(replies.column("bucket").to_pylist(), replies.column("codes").to_pylist())])
            asked = (bucket.astype(np.uint64) << np.uint64(32)) | code.astype(np.uint64)
            hot = np.isin(asked | np.uint64(2), full)
            if hot.any():
                numbers, strings = dealt_strings(own, np.flatnonzero(hot))
                numbers, strings, marks = [*numbers, table.column("chunk")[0].as_py() % buckets], [*strings, b""], [b""] * len(strings) + [np.unique(core[hot]).tobytes()]
            hits = np.flatnonzero(np.isin(asked, full))
            for k, c, b in zip(hits.tolist(), core[hits].tolist(), bucket[hits].tolist()):
                at = by_bucket.setdefault(b, {})
                it = (c, own.text(k))
                at[it] = it in at
        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        none = [b""] * len(numbers)
        return pa.table({
            "chunk": pa.array([chunk] * (len(by_bucket) + len(numbers)), pa.int32()),
            "bucket": pa.array([*by_bucket, *numbers], pa.int32()),
            "cores": pa.array([*(np.array([c for c, _ in x], np.uint64).tobytes() for x in by_bucket.values()), *none], pa.binary()),
            "multi": pa.array([*(bytes(x.values()) for x in by_bucket.values()), *none], pa.binary()),
            "segments": pa.array([*([s for _, s in x] for x in by_bucket.values()), *([] for _ in numbers)], pa.list_(pa.binary())),
            "strings": pa.array([*(b"" for _ in by_bucket), *strings], pa.binary()),
            "hot": pa.array([*(b"" for _ in by_bucket), *marks], pa.binary()),
        })

    def repeated_strings(chunks: list[int], sent: list[bytes]) -> list[tuple[int, bytes]]:
        """For each chunk its codes that are found in two places."""
        parts = [(c, np.frombuffer(x, _STRING)) for c, x in zip(chunks, sent) if x]
        if not parts:
            return []
        every = np.concatenate([p for _, p in parts])
        low = every["low"] & ~np.uint64(1)
        order = np.lexsort((low, every["high"]))
        new = np.ones(len(every), bool)
        new[1:] = (every["high"][order][1:] != every["high"][order][:-1]) | (low[order][1:] != low[order][:-1])
        starts = np.flatnonzero(new)
        places = np.diff(np.append(starts, len(every)))
        keep = np.empty(len(every), bool)
        keep[order] = np.repeat((places > 1) | (np.bitwise_or.reduceat(every["low"][order] & np.uint64(1), starts) > 0), places)
        ends = np.cumsum([len(p) for _, p in parts]).tolist()
        return [(c, p[k].tobytes()) for (c, p), e in zip(parts, ends) if (k := keep[e - len(p) : e]).any()]

    def compare(table: pa.Table) -> pa.Table:
        by_core: dict[int, dict[bytes, list]] = {}
        for chunk, c, multi, parts in zip(*(table.column(n).to_pylist() for n in ("chunk", "cores", "multi", "segments"))):
            for core, many, s in zip(np.frombuffer(c, np.uint64).tolist(), multi, parts):
                at = by_core.setdefault(core, {}).setdefault(s, [False, []])
                at[0] |= bool(many) or bool(at[1])
                at[1].append(chunk)
        out: dict[int, list[tuple[int, bytes, int, int]]] = {}
        for core, own in by_core.items():
            different = list(own)
            ranges = [[] for _ in own] if len(own) < 2 else twice(different, length)
            for s, found in zip(different, ranges):
                many, chunks = own[s]
                if many:
                    found = [(0, len(s) - length + 1)]
                digest = _digest(s) if found else b""
                for c in chunks if found else ():
                    out.setdefault(c, []).extend((core, digest, a, b) for a, b in found)
        strings = [(c, x, b"") for c, x in repeated_strings(table.column("chunk").to_pylist(), table.column("strings").to_pylist())]
        strings += [(c, b"", h) for c, h in zip(table.column("chunk").to_pylist(), table.column("hot").to_pylist()) if h]
        none = [b""] * len(strings)
        return pa.table({
            "chunk": pa.array([*out, *(c for c, _, _ in strings)], pa.int32()),
            "bucket": pa.array([table.column("bucket")[0].as_py()] * (len(out) + len(strings)), pa.int32()),
            "cores": pa.array([*(np.array([x[0] for x in v], np.uint64).tobytes() for v in out.values()), *none], pa.binary()),
            "digests": pa.array([*(b"".join(x[1] for x in v) for v in out.values()), *none], pa.binary()),
            "ranges": pa.array([*(np.array([x[2:] for x in v], np.uint32).tobytes() for v in out.values()), *none], pa.binary()),
            "strings": pa.array([*(b"" for _ in out), *(x for _, x, _ in strings)], pa.binary()),
            "hot": pa.array([*(b"" for _ in out), *(h for _, _, h in strings)], pa.binary()),
        })

    sent = groups.cogroup(known.groupBy("chunk")).applyInArrow(send, _TEXTS)
    found = sent.groupBy("bucket").applyInArrow(compare, _REPLY)
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*key).schema.fields}

    def mark(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: table.column(k) for k in key} | rows([], []))
        texts = [t.encode() for t in table.column("text").to_pylist()]
        starts = np.cumsum([0, *map(len, texts)])
        covered = np.zeros(int(starts[-1]), bool)
        if replies.num_rows:
            own = Segments(texts, length, gram)
            core = own.core.astype(np.uint64)
            answers: dict[bytes, list[tuple[int, int]]] = {}
            for d, r in zip(replies.column("digests").to_pylist(), replies.column("ranges").to_pylist()):
                for k, (a, b) in enumerate(np.frombuffer(r, np.uint32).reshape(-1, 2).tolist()):
                    answers.setdefault(d[16 * k : 16 * k + 16], []).append((a, b))
            asked = np.concatenate([np.frombuffer(c, np.uint64) for c in replies.column("cores").to_pylist()])
            edge = np.zeros(len(covered) + 1, np.int32)
            for k in np.flatnonzero(np.isin(core, asked)).tolist():
                for a, b in answers.get(_digest(own.text(k)), ()):
                    edge[own.begin[k] + a] += 1
                    edge[own.begin[k] + b - 1 + length] -= 1
            known = np.concatenate([np.frombuffer(x, _STRING) for x in replies.column("strings").to_pylist()])
            if len(known):
                hot = np.concatenate([np.frombuffer(x, np.uint64) for x in replies.column("hot").to_pylist()])
                at = own.strings(np.flatnonzero(np.isin(core, hot)), length)
                high = own.hashes(at, length, _BASE)
                some = np.isin(high, known["high"])
                at, high = at[some], high[some]
                at = at[member(high, own.hashes(at, length, _OTHER_BASE) & ~np.uint64(1), known["high"], known["low"] & ~np.uint64(1))]
                edge[at] += 1  # places are distinct
                edge[at + length] -= 1
            covered = np.cumsum(edge[:-1]) > 0
        flags = [covered[a:b] for a, b in zip(starts.tolist(), starts[1:].tolist())]
        return pa.table({k: table.column(k) for k in key} | rows(texts, flags))

    full = ", ".join([*(f"`{n}` {kinds[n]}" for n in key), schema])
    return groups.cogroup(found.groupBy("chunk")).applyInArrow(mark, full)


def dedup_suffixes(docs: DataFrame, key: list[str], length: int = LENGTH, text: str = "text", kept_bytes: bool = False) -> DataFrame:
    """``key`` columns with ``n_bytes``, ``n_removed``, ``n_spans`` and the hash of the kept bytes, and they if asked.

    Null and empty texts have no bytes; texts of any length are taken whole; wholly repeated rows repeat each other, so
    all their strings go.  An empty table gives an empty result.  Only ``key`` and ``text`` are read; ``key`` columns may
    not be named ``chunk`` or as the new columns.
    """

    def rows(texts, flags):
        kept = [np.frombuffer(t, np.uint8)[~f].tobytes() if f.any() else t for t, f in zip(texts, flags)]
        out = {
            "n_bytes": pa.array(map(len, texts), pa.int64()),
            "n_removed": pa.array([int(f.sum()) for f in flags], pa.int64()),
            "n_spans": pa.array([int(np.count_nonzero(np.diff(f.astype(np.int8), prepend=0) == 1)) for f in flags], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        return out | ({"kept_bytes": pa.array(kept, pa.binary())} if kept_bytes else {})

    return repeated_bytes(docs, key, rows, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * kept_bytes, length, text=text)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query 9 over all documents."""
    return dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
