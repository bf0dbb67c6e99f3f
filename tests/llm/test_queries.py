"""Every registered text query over whole given tables: against its SQL, or against brute force where it has none."""

import hashlib
import os
from collections import Counter

import pytest

from ripplemark.llm import bpe, language, suffixes, toxicity
from ripplemark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import distance

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def texts(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, expected = QUERIES[name](spark, SMALL).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    key = lambda df: Counter(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert key(got) == key(expected)


def test_language(spark):
    """Each phrase is found by looking the longest match up in the reference, character by character."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    references = language.fit(docs)

    def needed(text, reference):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in reference:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
        return n

    import math

    got = {r.doc_id: r for r in language.op2_language(spark, SMALL).collect()}
    for r in texts(spark, SMALL):
        if r.text and len(r.text) < 4000 and any(map(str.isalpha, r.text)):
            bits = sorted((needed(language.letters(r.text), t) * math.log2(len(t) + 2), name) for name, t in references.items())
            assert got[r.doc_id].lang_pred == bits[0][1] and abs(got[r.doc_id].score - max(0.0, 1 - bits[0][0] / bits[1][0])) < 1e-9
        elif not r.text or not any(map(str.isalpha, r.text)):
            assert got[r.doc_id].lang_pred == "und"
    assert len(got) == docs.count()


def test_more_labels_than_any_list(spark):
    """A label among a hundred is learned, and so is one whose texts are all very long."""
    rows = [(i, chr(0x4E00 + i % 100) * 30 + " ", f"l{i % 100:02}") for i in range(1000)] + [(2000 + i, "xyz " * 8000, "long") for i in range(8)]
    references = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(references) == 101


@pytest.mark.parametrize("first", [1, 4, 9])
def test_labels_of_repeated_rows(spark, first):
    """A thousand equal rows are one text of their label, whichever id they have and whether or not there are others."""
    same = [(first, "ein Satz und noch ein Satz", "de")] * 1000
    more = [(100 + i, f"word number {i} in a line", "en") for i in range(50)]
    schema = "doc_id bigint, text string, lang string"
    assert set(language.fit(spark.createDataFrame(same, schema))) == {"de"}
    found = language.fit(spark.createDataFrame(same + more, schema))
    assert set(found) == {"de", "en"} and found["de"].count("noch") == 1
    assert language.fit(spark.createDataFrame(same, schema).limit(0)) == {}


def test_thousands_of_labels(spark):
    rows = spark.range(30_000).selectExpr("id * 4 as doc_id", "concat('text ', id % 12000, ' of label ', id % 5000) as text", "concat('l', id % 5000) as lang")
    rows = rows.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    assert set(language.fit(rows)) == {r.lang for r in rows.select("lang").distinct().collect()}


def test_toxicity(spark):
    """Words are weighed by their edit distance to every term instead of by the automaton."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model["terms"]
    scorer = toxicity.Scorer(toxicity.Lexicon(model["terms"], model["stems"], model["known"], model["fuzzy"]))
    short = min(map(len, model["stems"]), default=0)

    def weight(word):
        near = [(distance(word, t), t) for t in model["terms"] if abs(len(t) - len(word)) < 2]
        near = [(d, t) for d, t in near if not d or d == 1 and len(t) >= toxicity.FUZZY_LETTERS]
        least = min((d for d, _ in near), default=None)
        out = max((model["terms"][t] * (model["fuzzy"] if d else 1.0) for d, t in near if d == least), default=0.0)
        if least and word in model["known"]:
            out = model["known"][word]
        stem = next((model["stems"][word[:n]] for n in range(short, len(word) + 1) if word[:n] in model["stems"]), None) if short else None
        out = max(out, stem) if stem is not None else out
        return out if out >= scorer.least else 0.0

    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, "/root/testdata/sf0.01").collect()}
    seen: dict = {}
    for r in texts(spark, "/root/testdata/sf0.01")[:300]:
        lower, rest = (r.text or "").lower(), 1.0
        for m in toxicity.WORD.finditer(lower):
            w = seen.setdefault(m.group(), None)
            if w is None:
                w = seen[m.group()] = weight(m.group())
            if w:
                rest *= 1 - min(w * (scorer.quotation if toxicity.quoted(lower, m.start(), m.end()) else 1.0), 0.99)
        assert abs(got[r.doc_id].score - (1 - rest)) < 1e-9
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
    toxic = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id in toxic]
    assert sum((r.score >= 0.3) == bool(toxic[r.doc_id]) for r in held) >= 0.9 * len(held)


def test_bpe(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = set()
    for r in texts(spark, SMALL):
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert set(map(tuple, bpe.op7_bpe(spark, SMALL).collect())) == expected


def test_suffixes_at_sf01(spark):
    """All 400-byte strings of 25 MB, by a set of their 16-byte digests for each last bits of a first hash."""
    import numpy as np

    rows = texts(spark, LARGE)
    raw = [(r.text or "").encode() for r in rows]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(b) for b in raw])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Two hashes of 400 bytes by doubling: 400 = 16 * 25.
    table = np.random.default_rng(1).integers(0, 1 << 63, (2, 256), dtype=np.uint64)

    def rolled(values, base):
        h, length = values, 1
        for bit in bin(400)[3:]:
            power = np.uint64(pow(base, length, 1 << 64))
            h = h[: len(h) - length] * power + h[length:]
            length *= 2
            if bit == "1":
                h = h[:-1] * np.uint64(base) + values[length : length + len(h) - 1]
                length += 1
        return h

    room = np.maximum(sizes - 399, 0)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(room)])[:-1], room) + np.arange(room.sum())
    a, b = (rolled(table[i][data], base)[at] for i, base in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)))
    order = np.lexsort((b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(data) + 1, np.int32)
    edge[at[twice]] += 1
    edge[at[twice] + 400] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    expected = set()
    for r, s, e in zip(rows, starts.tolist(), ends.tolist()):
        f = covered[s:e]
        expected.add((r.doc_id, e - s, int(f.sum()), int(np.count_nonzero(np.diff(f.astype(np.int8), prepend=0) == 1)), hashlib.sha256(data[s:e][~f].tobytes()).hexdigest()))
    assert set(map(tuple, suffixes.op9_suffix_dedup(spark, LARGE).collect())) == expected
