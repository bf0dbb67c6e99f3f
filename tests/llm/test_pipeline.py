"""The pipeline against the same five steps done by brute force."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from ripplemark.llm.quality import judged

RND = random.Random(9)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 8))) for _ in range(300)]


def words(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


def test_pipeline(spark, tmp_path):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    items = [(1, words(30)), (2, words(25))]
    base = [words(RND.randint(40, 90)) for _ in range(14)]
    texts = [*base, base[0], base[1] + " tail", None, "", "too short", "a | b | c | d\n" * 9 + words(12), words(30) + " " + items[0][1] + " " + words(10)]
    texts += [words(30) + ' password = "abcdefghijklmnop1" ' + words(10), words(30) + " 0123456789abcdef0123 x", words(40) + "\n" + "x | y | z\n" + words(20)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), True) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, judged(t or "")) for i, t, *_ in [*rows, rows[3]]]
    kept = [(i, j["clean_text"]) for i, j in kept if j["kept"]]
    sets = [(i, t, frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4))) for i, t in sorted(kept)]
    chosen = []
    for i, t, s in sets:  # classes here are pairs and triples around their least id
        if not any(len(s & o) >= 0.8 * len(s | o) for _, _, o in chosen):
            chosen.append((i, t, s))
    windows = {" ".join(t.split()[k : k + 10]) for _, t in items for k in range(len(t.split()) - 9)}
    clean = [(i, t) for i, t, _ in chosen if not any(w in " ".join(t.split()) for w in windows)]
    masked = [(i, re.sub(r'password = "[a-z0-9]{12,}|[0-9a-f]{16,}', "[SECRET]", t)) for i, t in clean]
    library = tokenizers.Tokenizer.from_file(public.path(corpus_pipeline.TOKENIZER))
    expected = {i: library.encode(t, add_special_tokens=False).ids for i, t in masked}
    assert 10 < len(expected) < len(kept) and any("[SECRET]" in t for _, t in masked)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: list(r.ids) for r in got} == expected and len(got) == len(expected)
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in masked}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, words(30))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["_shingle_set", "_place", "_row_hash", "_secret_spans", "_quality_kept", "_benchmark_hits", "_c0", "_t", "_id", "k", "h", "label", "n_words", "hits", "items", "spans", "chunk", "cell", "node", "clean_text"]
    rows = [(i, t, "s", *names) for i, t in ((1, words(60)), (2, words(60) + " secret = abcdefghijklmnop1 x"), (None, None), (3, ""))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert all(list(r)[3:] == names for r in out.collect()) and out.count() >= 2, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 4
