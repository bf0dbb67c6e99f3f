"""Language identification by cross-parsing.

For each labelled language a suffix automaton of labelled text is built.  A text is parsed greedily against each into
longest matches; a language whose text explains it well needs few phrases.  ``phrases * log2(reference length) /
text length`` estimates the cross entropy in bits a character, and the least one names the language.
"""

from __future__ import annotations

import gc
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.llm.common import held_out, map_texts


_OTHERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """``text`` in lower case, with a blank for what lies between its letters: numbers and signs tell no language."""
    return _OTHERS.sub(" ", text.lower())


def suffix_automaton(text: str) -> dict:
    """The root of an automaton that reads every substring of ``text``; a state is a dict from character to state."""
    states: list[dict] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in text:
        cur = len(states)
        states.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in states[p]:
            states[p][c] = cur
            p = link[p]
        if p >= 0:
            q = states[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(states)
                states.append(dict(states[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and states[p].get(c) == q:
                    states[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    for s in states:
        for c, t in s.items():
            s[c] = states[t]
    return states[0]


def phrases(text: str, root: dict, most: float = math.inf) -> int:
    """How many longest matches a greedy parse of ``text`` needs; a character that the reference lacks is one.

    Stops with what it has once that is over ``most``.
    """
    n, state = 0, root
    for c in text:
        step = state.get(c)
        if step is None:
            if state is not root:
                n += 1
            step = root.get(c)
            if step is None:
                n += 1
                step = root
            if n > most:
                return n
        state = step
    return n + (state is not root)


#: Labels with their shares are broadcast up to this size.
LABEL_BYTES = 4_000_000


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample_docs: int = 80, sample_chars: int = 60_000, longest: int = 10_000, total_chars: int = 6_000_000) -> dict[str, str]:
    """Reference text of each language, of equal length, from rows that are not held out.

    Every label with any text is learned.  The sample is bounded: of each label ``sample_docs`` texts in hash order, of
    each the first ``longest`` characters, up to ``sample_chars`` characters a label or, with very many labels,
    ``total_chars`` among them all.  A language with few rows gives less.  Repeated rows and texts count once; ties in the
    hash go by the text that sorts first.  Without labelled rows, or with an empty table, nothing is learned.
    """
    rows = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.left(F.col(text), F.lit(longest)).alias("text"))
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect())
    if not counts:
        return {}
    most = max(200, min(sample_chars, total_chars // len(counts)))
    some_docs = max(2, min(sample_docs, sample_docs * 4 * most // sample_chars))
    # So many texts pass on average that a label with more of them is left without any once in e**46.
    share = [(name, min(1_000_000, math.ceil(1_000_000 * (3 * some_docs + 40) / n))) for name, n in counts]
    shares = docs.sparkSession.createDataFrame(share, f"lang {rows.schema['lang'].dataType.simpleString()}, share long")
    bounded = sum(len(str(name)) + 16 for name, _ in share) <= LABEL_BYTES  # else there are many labels, and they meet in a shuffle
    some = rows.join(F.broadcast(shares) if bounded else shares, "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("share"))
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text"))  # texts, not copies
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= some_docs)
    some = some.select("lang", "k", F.left("text", F.lit(most)).alias("text"))
    found: dict[str, list[str]] = {}
    for r in sorted(some.collect(), key=lambda r: r["k"]):
        found.setdefault(r["lang"], []).append(letters(r["text"]))
    joined = {name: "\n".join(t) for name, t in found.items()}
    size = min(most, max(map(len, joined.values())))
    return {name: joined[name][:size] for name in sorted(joined)}


_LOADED: dict = {}


def _automata(references: dict[str, str]) -> list[tuple[str, dict, float]]:
    """Built once in each Python worker."""
    key = tuple(references.items())
    if key not in _LOADED:
        _LOADED.clear()
        gc.disable()
        _LOADED[key] = [(name, suffix_automaton(t), math.log2(len(t) + 2)) for name, t in references.items()]
        gc.freeze()
        gc.enable()
    return _LOADED[key]


def predict(text: str, automata: list[tuple[str, dict, float]], first: str | None = None) -> tuple[str, float]:
    """The language and a score from 0 to 1: by how much the runner-up needs more bits.

    ``und`` with score 0 if the text has no letter or nothing was learned.  On a tie the name that sorts first.  A
    language is given up once it needs more bits than the two best so far; ``first`` is tried before the others.
    """
    if not automata or not any(map(str.isalpha, text)):
        return "und", 0.0
    text = letters(text)
    best: list[tuple[float, str]] = []
    for name, root, log in sorted(automata, key=lambda a: a[0] != first):
        most = best[1][0] / log if len(best) > 1 else math.inf
        best = sorted([*best, (phrases(text, root, most) * log, name)])[:2]
    return best[0][1], 1.0 if len(best) == 1 else max(0.0, 1 - best[0][0] / best[1][0])


def identify(docs: DataFrame, references: dict[str, str], columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with ``lang_pred`` and ``score`` of every whole text; one pass, no shuffle.

    The broadcast reference texts are bounded by :func:`fit`.  Null and empty texts are ``und``; very long ones are parsed
    whole; repeated rows agree; an empty table gives an empty result.  ``columns`` may not have the new names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(references)

    def rows():
        automata = _automata(shared.value)

        def run(texts):
            found, last = [], None
            for t in texts:  # neighbours are often of one language
                found.append(predict(t, automata, last))
                last = found[-1][0]
            return {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())}

        return run

    return map_texts(docs, columns, "lang_pred string, score double", rows, text)


def op2_language(spark, sf_dir: str) -> DataFrame:
    """Contract query 2 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
