"""Toxicity by a learned lexicon, misspellings included, weighed by context.

The lexicon is learned from labelled texts: terms that mark one label, and stems that many such words begin with.  All
words within one edit of a term are read by one automaton, the Levenshtein automaton of every term intersected with the
trie of the lexicon; its states are made when first entered.  Each hit has a weight, the share of toxic uses seen in
training, lowered if the window around it reads as a quotation or a report.  A text's score joins its hits as
independent evidence.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import checkpointed, held_out, map_texts

WORD = re.compile(r"[^\W\d_]+")
#: Terms of fewer letters are matched as they are: most short words are one edit apart.
FUZZY_LETTERS = 5
STEM_LETTERS = 5
PREDICTED = 0.3
#: Fixed word list: verbs and nouns that introduce what someone else has said.
REPORTING = frozenset("said says wrote writes quote quoted quotes reported called sagte schrieb zitat zitierte dit écrit cité citation dijo escribió cita citó".split())
#: The signs that close a quotation which a sign opens; a straight sign and, in some languages, others go both ways.
_CLOSING = {'"': '"', "“": "”", "„": "“”", "”": "”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "‹": "›", "›": "‹"}
_SIGNS = re.compile(f"[{''.join(_CLOSING)}’\\n]")


class Lexicon:
    """Reads words: the weight of the term or stem that a word matches, or 0.

    A state of the automaton is a set of pairs (trie node, edits spent).  ``terms`` and ``stems`` map to weights,
    ``known`` overrides the weight of single words, and ``fuzzy`` scales the weight of a misspelling not in it.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], known: dict[str, float], fuzzy: float = 0.9):
        self.stems, self.known, self.fuzzy = stems, known, fuzzy
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in sorted(terms):
            at = 0
            for c in t:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                at = self.child[at][c]
            self.term[at] = t
        self.terms = terms
        self.start = self._closed({(0, 0)})
        self.moves: dict[frozenset, dict[str, frozenset]] = {}
        self.ends: dict[frozenset, tuple[float, bool]] = {}
        self.short = min(map(len, stems), default=0)

    def _closed(self, pairs: set) -> frozenset:
        """With the places reached by leaving out a letter of the term."""
        return frozenset(pairs | {(c, 1) for node, e in pairs if not e for c in self.child[node].values()})

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in state:
            if c in self.child[node]:
                out.add((self.child[node][c], e))
            if not e:
                out.add((node, 1))  # a letter too many
                out.update((x, 1) for x in self.child[node].values())  # another letter
        return self._closed(out)

    def _end(self, state: frozenset) -> tuple[float, bool]:
        found = [(e, self.term[node]) for node, e in state if self.term[node] and (not e or len(self.term[node]) >= FUZZY_LETTERS)]
        if not found:
            return 0.0, False
        edits = min(e for e, _ in found)
        return max(self.terms[t] for e, t in found if e == edits) * (self.fuzzy if edits else 1.0), bool(edits)

    def read(self, word: str) -> tuple[float, bool]:
        """The weight of ``word``, and whether it is a misspelling."""
        state = self.start
        for c in word:
            moves = self.moves.setdefault(state, {})
            state = moves.get(c)
            if state is None:
                if len(self.moves) > 50_000:  # bounded; states are made again when needed
                    self.moves.clear()
                    self.ends.clear()
                return self._slow(word)
            if not state:
                break
        if state:
            if state not in self.ends:
                self.ends[state] = self._end(state)
            weight, fuzzy = self.ends[state]
        else:
            weight, fuzzy = 0.0, False
        return self._joined(word, weight, fuzzy)

    def _slow(self, word: str) -> tuple[float, bool]:
        state = self.start
        for c in word:
            moves = self.moves.setdefault(state, {})
            if c not in moves:
                moves[c] = self._step(state, c)
            state = moves[c]
            if not state:
                return self._joined(word, 0.0, False)
        return self._joined(word, *self._end(state))

    def _joined(self, word: str, weight: float, fuzzy: bool) -> tuple[float, bool]:
        if fuzzy and word in self.known:
            weight = self.known[word]
        if self.short and len(word) >= self.short:
            for n in range(self.short, len(word) + 1):
                stem = self.stems.get(word[:n])
                if stem is not None:
                    return max(weight, stem), False
        return weight, fuzzy


def quotations(text: str) -> list[tuple[int, int]]:
    """Where quotations open and close, in order of the openings; a sign between two letters is an apostrophe, and none goes past its line."""
    out, opened = [], []
    for m in _SIGNS.finditer(text):
        q, at = m.group(), m.start()
        if q == "\n":
            opened = []
        elif not (text[at - 1 : at].isalpha() and text[at + 1 : at + 2].isalpha()):
            closes = next((k for k in range(len(opened) - 1, -1, -1) if q in _CLOSING[opened[k][0]]), None)
            if closes is not None:
                out.append((opened[closes][1], at))
                del opened[closes:]
            elif q in _CLOSING:
                opened.append((q, at))
    return sorted(out)


def quoted(text: str, start: int, end: int, reach: int = 60, pairs: list[tuple[int, int]] | None = None) -> bool:
    """Whether the window around ``text[start:end]`` shows it as someone else's words; ``pairs`` are the text's quotations."""
    pairs = quotations(text) if pairs is None else pairs
    near = pairs[bisect_left(pairs, (start - reach, 0)) : bisect_left(pairs, (start, 0))]
    return any(end <= close < end + reach for _, close in near) or any(w in REPORTING for w in WORD.findall(text[max(0, start - reach) : start].lower())[-4:])


class Scorer:
    def __init__(self, lexicon: Lexicon, quotation: float = 0.3, least: float = 0.15, cached: int = 500_000):
        self.lexicon, self.quotation, self.least, self.most = lexicon, quotation, least, cached
        self.seen: dict[str, float] = {}

    def score(self, text: str) -> float:
        """From 0 (no evidence; also texts without words) to 1."""
        lower = text.lower()
        words = WORD.findall(lower)
        new = set(words).difference(self.seen)
        if len(self.seen) + len(new) > self.most:
            self.seen.clear()
            new = set(words)
        for w in new:
            weight = self.lexicon.read(w)[0]
            self.seen[w] = weight if weight >= self.least else 0.0
        hits = {w for w in set(words) if self.seen[w]}
        if not hits:
            return 0.0
        rest, pairs = 1.0, quotations(lower)
        for m in WORD.finditer(lower):
            if m.group() in hits:
                weight = self.seen[m.group()] * (self.quotation if quoted(lower, m.start(), m.end(), pairs=pairs) else 1.0)
                rest *= 1 - min(weight, 0.99)
        return 1 - rest


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, min_contexts: int = 5, purity: float = 0.9, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> dict:
    """Terms, stems and known words with their weights, from labelled rows that are not held out.

    The sample is bounded: about ``sample_rows`` labelled ids by hash, broadcast to the documents.  A term needs
    ``min_contexts`` different pairs of neighbours in toxic texts (so copies of one text count once) and a ``purity``.
    Labels that are null are left out; of contradicting labels the highest counts.  Every term, stem and near word of the
    sample that passes its test is learned: their number is bounded by the sample's.
    """
    ids = labels.where(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("toxic"))
    n = ids.count()
    if n > sample_rows:
        ids = ids.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    rows = docs.select(F.col(doc_id).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("t")).join(F.broadcast(ids), "id")
    words = rows.select("toxic", F.regexp_extract_all("t", F.lit(r"\p{L}+"), F.lit(0)).alias("a"))
    left, right = F.concat(F.array(F.lit("")), F.col("a")), F.concat(F.expr("slice(a, 2, greatest(size(a) - 1, 0))"), F.array(F.lit("")))
    words = words.select("toxic", F.inline(F.arrays_zip(F.col("a").alias("w"), left.alias("left"), right.alias("right"))).alias("w", "left", "right"))
    table = words.where(F.length("w") >= 3).groupBy("w", "toxic").agg(F.approx_count_distinct(F.xxhash64("left", "right")).alias("n")).groupBy("w")
    table = table.agg(F.sum(F.when(F.col("toxic") >= 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") >= 1, 0).otherwise(F.col("n"))).alias("neg"))
    table = checkpointed(table)
    sums = table.agg(F.sum("pos"), F.sum("neg"), F.count_if(F.col("pos") + F.col("neg") >= min_contexts)).first()
    if not sums[0] or not sums[1]:
        return {"terms": {}, "stems": {}, "known": {}, "fuzzy": 0.5}
    base, tests = sums[0] / (sums[0] + sums[1]), max(1, sums[2])

    def marks(doubt: float):
        """Pure, and by the divergence of its share from that of all words not to be expected among so many words."""
        every, share = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
        divergence = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0)
        return (F.col("pos") >= min_contexts) & (share >= purity) & (every * divergence >= math.log(tests / doubt))

    weight = (F.col("pos") + 0.2) / (F.col("pos") + F.col("neg") + 1)
    terms = {r.w: r.weight for r in table.where(marks(0.01)).select("w", weight.alias("weight")).collect()}
    prefixes = table.select(F.explode(F.sequence(F.lit(STEM_LETTERS), F.greatest(F.lit(STEM_LETTERS), F.length("w")))).alias("k"), "w", "pos", "neg").where(F.length("w") >= F.col("k"))
    prefixes = prefixes.groupBy(F.expr("left(w, k)").alias("stem")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum((F.col("pos") > 0).cast("int")).alias("words"))
    stems: dict[str, float] = {}
    for r in prefixes.where(marks(0.0001) & (F.col("words") >= 3)).select("stem", weight.alias("weight")).collect():
        stems[r.stem] = r.weight
    stems = {s: w for s, w in stems.items() if not any(s[:k] in stems for k in range(STEM_LETTERS, len(s)))}
    near: list = []
    if terms:
        shared = docs.sparkSession.sparkContext.broadcast((terms, stems))

        def close(batches):
            lexicon = Lexicon(*shared.value, {})
            for b in batches:
                yield b.filter(pa.array([lexicon.read(w)[1] for w in b.column(0).to_pylist()], pa.bool_()))

        near = table.where(F.length("w") >= FUZZY_LETTERS - 1).mapInArrow(close, table.schema).collect()
    toxic = sum(r.pos > r.neg for r in near)
    return {"terms": terms, "stems": stems, "known": {r.w: (r.pos + 0.2) / (r.pos + r.neg + 1) for r in near if r.neg or r.pos > 1}, "fuzzy": (toxic + 0.5) / (len(near) + 1)}


def score(docs: DataFrame, model: dict, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with the toxicity ``score`` of every whole text; one pass, no shuffle.

    The broadcast model is bounded by :func:`fit`.  Null and empty texts score 0; so does all with nothing learned.  Very
    long texts are scored whole; repeated rows score alike (ties keep no order); an empty table gives an empty result.
    ``columns`` may have no column ``score``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows():
        m = shared.value
        scorer = Scorer(Lexicon(m["terms"], m["stems"], m["known"], m["fuzzy"]))
        return lambda texts: {"score": pa.array([scorer.score(t) for t in texts], pa.float64())}

    return map_texts(docs, columns, "score double", rows, text)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query 10 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))
