"""Quality rules, lines first.

Every line is judged on its own by three rules: punctuation (few letters against symbols and separators, or an end in
an ellipsis, as teasers have), navigation (menu-like lists of short items between separators) and boilerplate (a short
line with a stock phrase of web pages, or a line that repeats an earlier one of its document).  Failing lines are
removed, then a document is rejected if it has lost too much of its text.  The base metrics of the document as a whole
(length and repeated 8-word windows) reject before that.  Lines are not judged by how many documents hold them: that
would empty every one of a group of copies, of which the near-duplicate stage is to keep one.

All of it is one pass over whole texts without a shuffle.  The work on a text is linear in its length: byte splitting
is ASCII white space splitting, and windows are compared through hashes whose equal neighbours are checked word by word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ripplemark.llm.common import map_texts

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Signs that part the entries of a menu.
_SEPARATORS = re.compile(r"[|<>•·»›]")
#: Fixed phrases of notices on web pages; a line of at most ``STOCK_WORDS`` words with one is boilerplate.
STOCK = ("all rights reserved", "privacy policy", "cookie policy", "we use cookies", "terms of use", "terms of service", "enable javascript", "javascript is disabled", "lorem ipsum", "skip to content", "subscribe to our newsletter")
STOCK_WORDS = 12
_STOCK = re.compile("|".join(STOCK))
_WORD = re.compile(r"[^ \t\n\v\f\r]+")


def _weights(window: int) -> np.ndarray:
    return np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) | 1) & 0xFFFFFFFFFFFFFFFF for i in range(window)], dtype=np.uint64)


_WEIGHTS = _weights(WINDOW)


def repeated_words(tokens: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in ``window``-word windows that the text has twice or more, the first included."""
    n = len(tokens) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.uint64, len(tokens))
    if len(ids) == len(tokens):
        return 0
    spread = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    spread ^= spread >> np.uint64(29)
    weights = _WEIGHTS if window == WINDOW else _weights(window)
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h += spread[i : i + n] * weights[i]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    rows = np.lib.stride_tricks.sliding_window_view(codes, window)
    a, b = order[:-1][same], order[1:][same]
    repeated = np.zeros(n, bool)
    if (rows[a] == rows[b]).all():
        repeated[a] = repeated[b] = True
    else:  # two windows share a hash: count them as they are
        seen: dict[tuple, int] = {}
        for k, w in enumerate(map(tuple, rows)):
            if w in seen:
                repeated[[seen[w], k]] = True
            seen.setdefault(w, k)
    edge = np.zeros(len(tokens) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def line_fails(line: str, max_symbol_ratio: float = 0.2, menu_items: int = 3, menu_words: float = 2.5) -> str | None:
    """The rule that a line fails, if any.

    ``punctuation``: more than ``max_symbol_ratio`` of the characters of its words are symbols, or the line has no
    letter or digit, or it ends in an ellipsis.  ``navigation``: at least ``menu_items`` entries between separators, of
    ``menu_words`` words on average at most.  ``boilerplate``: a stock phrase in a short line.
    """
    body = line.strip(BLANKS)
    if not body:
        return None
    dense = len(body) - sum(body.count(c) for c in BLANKS)
    symbols = sum(body.count(c) for c in SYMBOLS)
    if _SEPARATORS.search(body):
        parts = [_WORD.findall(p) for p in _SEPARATORS.split(body)]
        parts = [p for p in parts if p]
        if len(parts) >= menu_items and sum(map(len, parts)) <= menu_words * len(parts):
            return "navigation"
    if symbols > max_symbol_ratio * dense or body.endswith(("...", "…")) or not any(map(str.isalnum, body)):
        return "punctuation"
    if _STOCK.search(body.lower()) and len(_WORD.findall(body)) <= STOCK_WORDS:
        return "boilerplate"
    return None


def judged(text: str, min_words: int = 20, max_repeat_percent: int = 30, max_lost: float = 0.5) -> dict:
    """The base metrics of a text, what is left of it after the line rules, and the verdict."""
    tokens = text.encode("utf-8", "surrogatepass").split()
    n_words = len(tokens)
    word_chars = len(text) - sum(text.count(c) for c in BLANKS)
    n_repeat = repeated_words(tokens)
    seen: set[str] = set()
    kept: list[str] = []
    dups = lost = 0
    for line in text.split("\n"):
        size = len(line) - sum(line.count(c) for c in BLANKS)
        if not size:
            kept.append(line)
            continue
        repeats = line in seen
        dups += repeats
        seen.add(line)
        if repeats or line_fails(line):
            lost += size
        else:
            kept.append(line)
    base_failed = n_words < min_words or 100 * n_repeat > max_repeat_percent * n_words
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": dups,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "lost_chars": lost,
        "kept": not base_failed and lost <= max_lost * word_chars,
        "clean_text": "\n".join(kept),
    }


_KINDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "lost_chars": "long", "kept": "boolean", "clean_text": "string"}


def quality(docs: DataFrame, columns: list[str], text: str = "text", clean_text: bool = False, prefix: str = "", **limits) -> DataFrame:
    """``columns`` of ``docs`` with the metrics and verdict of every whole text (see :func:`judged` for ``limits``).

    ``clean_text`` adds the text without its failing lines; ``prefix`` goes before every new name, which no column of
    ``columns`` may have.  A null or empty text has no words, so it fails the base rules and is not kept.  Very long
    texts are judged whole.  Rows are judged one by one: repeated rows get the same verdict, and an empty table gives an
    empty result.
    """
    names = [n for n in _KINDS if clean_text or n != "clean_text"]
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def rows():
        def run(texts):
            found = [judged(t, **limits) for t in texts]
            return {prefix + n: pa.array([f[n] for f in found], arrow[_KINDS[n]]) for n in names}

        return run

    return map_texts(docs, columns, ", ".join(f"{prefix}{n} {_KINDS[n]}" for n in names), rows, text)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query 4 over all documents."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
