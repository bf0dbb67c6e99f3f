"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a stretch of texts are laid out as one linked list of symbols.  An index maps each adjacent pair
to all its positions.  The ranks of the pairs present wait in a heap; the lowest active rank is applied at all its
positions at once (numpy), and only the lists of the pairs beside those positions are updated.  Pieces do not share pairs, so
this gives each piece the same ids as merging it alone, while a rank is looked up once for a whole stretch of texts.

Pieces are cut by the usual byte-level pattern.  A single blank between two other characters always starts a piece, so
texts are first split at blanks and every distinct part is cut and merged once for each task (a cache of bounded size).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ripplemark.llm.common import map_texts

_WS = "\t-\r \x85\xa0  -     　"
#: Fixed: the published pattern of byte-level BPE, with white space written out.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_WS_SET = frozenset(c for c in map(chr, range(0x3001)) if regex.match(f"[{_WS}]", c))


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_model(path: str) -> dict:
    """What encoding and decoding need of a byte-level BPE ``tokenizers`` JSON file; read once, on the driver."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model = j["model"]
    names = _byte_names()
    ids = {tuple(names[c] for c in token): i for token, i in model["vocab"].items()}
    table = {i: bytes(t) for t, i in ids.items()}
    merges = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
    special = {t["content"]: t["id"] for t in j["added_tokens"]}
    table |= {i: c.encode() for c, i in special.items()}
    return {"bytes": [ids[b,] for b in range(256)], "merges": merges, "table": table, "special": special}


class Merges:
    """The merge table as sorted arrays, for looking up many pairs at once.  A pair is ``left << 32 | right``."""

    def __init__(self, merges: dict):
        keys = np.fromiter(((a << 32) | b for a, b in merges), np.int64, len(merges))
        values = np.array(list(merges.values()), np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        self.keys, self.rank, self.new = keys[order], values[order, 0], values[order, 1]
        self.by_rank = np.argsort(self.rank)

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.rank[at], -1)


def merge_pieces(pieces: list[bytes], model: dict) -> list[bytes]:
    """The ids (32-bit, as bytes) of every piece, all merged together through the pair occurrence index."""
    if not pieces:
        return []
    merges: Merges = model["pairs"]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = np.array(model["bytes"], np.int32)[raw]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols[starts + sizes] = -1  # parts the pieces: no pair holds it
    n = len(symbols)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    where: dict[int, list[np.ndarray]] = {}  # by rank, as a rank is a pair
    active: list[int] = []

    def paired(places: np.ndarray) -> np.ndarray:
        return symbols[places].astype(np.int64) << 32 | symbols[after[places]]

    def listed(pairs: np.ndarray, places: np.ndarray) -> None:
        """Adds places to the lists of their pairs; a rank whose list was empty becomes active."""
        rank = merges.ranks(pairs)
        known = rank >= 0
        rank, places = rank[known], places[known]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, places = rank[order], places[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(rank)]
        firsts = rank[bounds[:-1]].tolist()
        for k, r in enumerate(firsts):
            part = places[bounds[k] : bounds[k + 1]]
            if r in where:
                where[r].append(part)
            else:
                where[r] = [part]
                heapq.heappush(active, r)

    first = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0)).astype(np.int32)
    listed(paired(first), first)
    while active:
        rank = heapq.heappop(active)
        lists = where.pop(rank)
        at = merges.by_rank[rank]
        a, b, new = int(merges.keys[at]) >> 32, int(merges.keys[at]) & 0xFFFFFFFF, merges.new[at]
        places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        places = places[symbols[places] == a]
        second = after[places]
        here = symbols[second] == b
        places, second = places[here], second[here]
        if a == b and len(places) > 1:  # of overlapping pairs the leftmost goes first
            free, keep = -1, []
            for k, (i, j) in enumerate(zip(places.tolist(), second.tolist())):
                if i != free:
                    keep.append(k)
                    free = j
            places, second = places[keep], second[keep]
        if not len(places):
            continue
        symbols[places], symbols[second] = new, -2
        third = after[second]
        after[places], before[third] = third, places  # every piece ends in a parting symbol, so there is a third
        left = before[places]
        left = left[(left >= 0) & (symbols[left] >= 0)]
        right = places[symbols[third] >= 0]
        sources = np.concatenate([left, right])
        listed(paired(sources), sources)
    alive = symbols >= 0
    flat = symbols[alive].tobytes()
    ends = (4 * np.cumsum(alive)[starts + sizes]).tolist()
    return [flat[i:j] for i, j in zip([0, *ends[:-1]], ends)]


class Encoder:
    """Encodes texts a batch at a time; keeps the ids of up to ``cached`` distinct parts between batches."""

    def __init__(self, model: dict, cached: int = 250_000):
        self.model, self.most = model, cached
        self.model.setdefault("pairs", Merges(model["merges"]))
        self.spaced: dict[str, bytes] = {}  # parts after a blank
        self.exact: dict[str, bytes] = {}  # pieces as they stand
        self.odd: set[str] = set()  # parts with white space at an end, before which no text is cut
        names = sorted(model["special"], key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.special_ids = {c: np.int32(i).tobytes() for c, i in model["special"].items()}

    def _learn(self, spaced: set[str], exact: list[str]) -> None:
        alone = [p for p in spaced if p.isalpha()]
        mixed = [p for p in spaced if not p.isalpha()]
        cut = [PIECES.findall(" " + p) for p in mixed]
        others = list({*chain.from_iterable(cut), *exact})
        ids = merge_pieces([(" " + p).encode() for p in alone] + [p.encode() for p in others], self.model)
        self.spaced.update(zip(alone, ids))
        of = dict(zip(others, ids[len(alone) :])).__getitem__
        self.spaced.update((p, b"".join(map(of, own))) for p, own in zip(mixed, cut))
        self.exact.update((p, of(p)) for p in exact)

    def encode(self, texts: list[str]):
        """Yields the ids of each text; unseen parts of all are learned before the first."""
        if len(self.spaced) + len(self.exact) + len(self.odd) > self.most:
            for known in (self.spaced, self.exact, self.odd):
                known.clear()
        named = self.special_ids
        cuts = [[s for s in self.special.split(t) if s] if self.special and any(s in t for s in named) else [t] if t else [] for t in texts]
        seen: set[str] = set()
        for cut in cuts:
            for s in cut:
                seen.update(s.split(" ")[1:])
        seen.difference_update(self.spaced, self.odd)
        odd = {p for p in seen if not p or p[0] in _WS_SET or p[-1] in _WS_SET}
        self.odd |= odd
        exact: set[str] = set()
        heads = []
        for cut in cuts:
            own = []
            for s in cut:
                head, *rest = [s] if s in named else s.split(" ")
                whole = bool(rest) and (bool(head and head[-1] in _WS_SET) or not self.odd.isdisjoint(rest))
                own.append((None if s in named else PIECES.findall(s if whole else head), whole))
                exact.update(own[-1][0] or ())
            heads.append(own)
        self._learn(seen - odd, [p for p in exact if p not in self.exact])
        spaced, exactly = self.spaced.__getitem__, self.exact.__getitem__
        for cut, own in zip(cuts, heads):
            out = []
            for s, (pieces, whole) in zip(cut, own):
                if pieces is None:
                    out.append(named[s])
                    continue
                out += map(exactly, pieces)
                if not whole:
                    out += map(spaced, s.split(" ")[1:])
            yield np.frombuffer(b"".join(out), np.int32)


def decode(ids, model: dict) -> str:
    return b"".join(map(model["table"].__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


def tokenize(docs: DataFrame, path: str, columns: list[str], text: str = "text", ids: bool = False, stretch: int = 6_000_000) -> DataFrame:
    """``columns`` of ``docs`` with ``n_tokens``, the hashes of the ids and of the decoded text, and the ``ids`` if asked.

    ``path``: a byte-level BPE file of the tokenizers library; it is read on the driver and broadcast (its size is that
    of the vocabulary, not of the data).  A null text counts as empty: no ids, and the hashes of empty strings.  Texts
    are encoded whole, in stretches of about ``stretch`` characters; one pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(path))

    def rows():
        model = shared.value
        encoder = Encoder(model)
        name = {i: str(i) for i in model["table"]}.__getitem__
        table = model["table"].__getitem__

        def run(texts):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if ids else {})
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= stretch):
                    size += len(texts[end])
                    end += 1
                for found in encoder.encode(texts[at:end]):
                    own = found.tolist()
                    out["n_tokens"].append(len(own))
                    out["ids_sha256"].append(hashlib.sha256(",".join(map(name, own)).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(b"".join(map(table, own)).decode("utf-8", "replace").encode()).hexdigest())
                    if ids:
                        out["ids"].append(found)
                at = end
            kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32())}
            return {n: pa.array(v, kinds[n]) for n, v in out.items()}

        return run

    return map_texts(docs, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids, rows, text)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query 7 over all documents."""
    import public_tokenizers

    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
