"""The text operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ripplemark.llm import bpe, decontaminate, language, licenses, ngram_join, quality, secrets, substrings, suffixes, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, spans string, k binary, chunk int"
RND = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(RND.choice(VOCABULARY) for _ in range(120))


def words(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


def texts():
    base = [words(RND.randint(30, 200)) for _ in range(30)]
    out = [*base, base[0], base[0], base[1] + " extra words here", None, "", " \n\t ", "one", "émoji 😀 ü", "x" * 5000, "ab" * 3000]
    for b in base[2:6]:  # near copies
        w = b.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [words(40) + " " + PASSAGE + " " + words(40) for _ in range(3)]
    out += [words(20) + "\n" + " ".join(PASSAGE.split()[20:80]) + "\n" + words(5), words(20_000)]
    return out


@pytest.fixture(scope="module")
def table():
    rows = list(enumerate(texts()))
    return [*rows, rows[3], (None, None), (None, "no id " + words(50))]


@pytest.fixture(scope="module")
def docs(spark, table):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 0.5, True, "x", b"k", 7) for i, t in table]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return Counter(map(tuple, rows))


def test_substrings(docs, table, empty):
    every = Counter()
    split = [(i, (t or "").encode().split()) for i, t in table]
    for _, w in split:
        every.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    expected = []
    for i, w in split:
        flags = [False] * len(w)
        for k in range(len(w) - 34):
            if every[tuple(w[k : k + 35])] > 1:
                flags[k : k + 35] = [True] * 35
        expected.append((i, len(w), sum(flags), hashlib.sha256(b" ".join(x for x, f in zip(w, flags) if not f)).hexdigest()))
    assert counted(substrings.dedup_substrings(docs, ["doc_id"]).collect()) == counted(expected)
    assert sum(e[2] for e in expected) > 500
    assert substrings.dedup_substrings(empty, ["doc_id"]).count() == 0


def test_suffix_array():
    for n in range(400):
        s = bytes(RND.choice(b"ab" if n % 2 else b"abcd") for _ in range(RND.randint(0, 60)))
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffixes(docs, table, empty):
    length, every = 400, Counter()
    raw = [(i, (t or "").encode()) for i, t in table]
    for _, b in raw:
        every.update(b[k : k + length] for k in range(len(b) - length + 1))
    expected = []
    for i, b in raw:
        flags = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if every[b[k : k + length]] > 1:
                flags[k : k + length] = b"\1" * length
        spans = len([x for x in bytes(flags).split(b"\0") if x])
        expected.append((i, len(b), sum(flags), spans, hashlib.sha256(bytes(x for x, f in zip(b, flags) if not f)).hexdigest()))
    assert counted(suffixes.dedup_suffixes(docs, ["doc_id"]).collect()) == counted(expected)
    found = suffixes.repeated_bytes(docs, ["doc_id"], lambda t, f: {"n": pa.array([int(x.sum()) for x in f], pa.int64())}, "n long", most=1)
    assert counted(found.collect()) == counted((e[0], e[2]) for e in expected)  # every core is hot
    assert suffixes.dedup_suffixes(empty, ["doc_id"]).count() == 0


def shingles(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_ngram_join(docs, table, empty):
    sets = {}
    for i, t in table:
        if shingles(t):
            sets.setdefault(shingles(t), []).append(i)
    keys = list(sets)
    near = [(a, b) for x, a in enumerate(keys) for b in keys[x + 1 :] if len(a & b) >= 0.8 * len(a | b)]
    label = {s: s for s in keys}
    for a, b in near:
        old, new = label[b], label[a]
        label = {s: new if v == old else v for s, v in label.items()}
    group = {}
    for s in keys:
        group.setdefault(label[s], []).extend(i for i in sets[s] if i is not None)
    links = Counter(x for p in near for x in p)
    expected = []
    for i, t in table:
        s = shingles(t)
        ids = group.get(label.get(s), [])
        expected.append((i, min(ids) if ids else i, links[s], len(sets[s]) - 1 if s else 0))
    rows, classes = ngram_join.near_duplicates(docs, bucket=8)
    got = rows.join(classes, "k", "left").select("id", F.coalesce("class_id", "id"), F.coalesce("links", F.lit(0)), F.coalesce(F.col("copies") - 1, F.lit(0)))
    assert counted(got.collect()) == counted(expected)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.where(F.length(F.trim("text")) > 0).count() >= len(group)
    assert ngram_join.one_of_each(empty).count() == 0


def test_large_buckets_are_split(spark):
    base = words(300).split()
    rows = []
    for i in range(120):
        w = list(base)
        for k in RND.sample(range(300), 3):
            w[k] = f"edit{i}"
        rows.append((i, " ".join(w)))
    _, classes = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket=16)
    assert classes.select("class_id").distinct().count() == 1


def variants(n, edits, size=300):
    """Near copies of one text, the same in every run of the tests, and each one's number of links."""
    rnd = random.Random(7)
    base = [rnd.choice(VOCABULARY) for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rnd.sample(range(size), edits):
            w[k] = f"edit{i}"
        out.append(" ".join(w))
    sets = [shingles(t) for t in out]
    return list(enumerate(out)), {i: sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}


@pytest.mark.parametrize("bucket", [1024, 16])
def test_links_are_distinct_partners_of_all_runs(spark, bucket):
    """Whether buckets are compared whole or block by block."""
    rows, expected = variants(60, 2)
    _, classes = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket=bucket)
    assert {r.first: r.links for r in classes.select("first", "links").collect()} == expected


def test_recall_holds_at_the_depth_reached(spark):
    rows, expected = variants(60, 2)
    _, classes = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket=4, depth=5)
    assert {r.first: r.links for r in classes.select("first", "links").collect()} == expected


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(300)] + [(b"x", b"y")], "a binary, b binary")
    labels = ngram_join.contracted(links)
    assert labels.count() == 303 and labels.select("label").distinct().count() == 2


def test_decontamination(spark, docs, table, empty):
    items = [(1, PASSAGE), (2, "w1 w2"), (3, None), (4, ""), (None, "w3 w4"), (5, PASSAGE), (6, "W7-w8, W9")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = fold(t)
        if w:
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).update([] if i is None else [str(i)])
    expected = []
    for i, t in table:
        w, hit, ids = fold(t), set(), set()
        for p, own in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    ids |= own
        expected.append((i, len(w), len(hit), ",".join(sorted(ids))))
    for block in (200_000, 7):
        found = decontaminate.contamination(docs, bench, windows_per_pass=block, prefix="_")
        size = F.aggregate("_hits", F.lit(0), lambda s, x: s + x["end"] - x["start"])
        assert counted(found.select("doc_id", "_n_words", size, F.array_join("_items", ",")).collect()) == counted(expected)
    assert decontaminate.contamination(empty, bench, prefix="_").count() == 0
    assert decontaminate.contamination(docs, bench.limit(0), prefix="_").where(F.size("_hits") > 0).count() == 0


def test_bpe(docs, table, empty):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    model = bpe.load_model(path)
    alphabet = " \n\tab'st1,.é 日😀<|"
    odd = ["".join(RND.choice(alphabet) for _ in range(RND.randint(0, 50))) for _ in range(1500)] + ["<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "it's we'll  aaaa", ""]
    got = [x.tolist() for x in bpe.Encoder(model, cached=500).encode(odd)]
    assert got == [x.ids for x in library.encode_batch(odd, add_special_tokens=False)]
    assert all(bpe.decode(x, model) == library.decode(x, skip_special_tokens=False) for x in got)
    expected = []
    for i, t in table:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert counted(bpe.tokenize(docs, path, ["doc_id"], stretch=20_000).collect()) == counted(expected)
    assert bpe.tokenize(empty, path, ["doc_id"], ids=True).count() == 0


def test_quality(spark, empty):
    eight = "a b c d e f g h"
    menu = "\n".join(" | ".join(words(1) for _ in range(8)) for _ in range(9))
    rows = [(0, words(60)), (1, None), (2, ""), (3, words(19)), (4, f"{eight} {eight} {words(10)}"), (5, menu), (6, "same line here\n" * 20 + words(30)), (7, words(60).replace(" ", "### ")), (8, words(60))]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id int, text string"), ["doc_id"], clean_text=True).collect()}
    assert got[0].kept and got[8].kept and got[0].clean_text == rows[0][1]
    assert not any(got[i].kept for i in (1, 2, 3, 5, 7))
    assert (got[1].n_words, got[2].n_words, got[3].n_words) == (0, 0, 19) and got[3].base_failed
    assert got[4].n_repeat_words == 16 and got[4].n_words == 26 and got[4].base_failed
    assert got[6].n_dup_lines == 19
    assert got[7].n_symbols == 59 * 3 and not got[7].base_failed
    assert quality.quality(empty, ["doc_id"]).count() == 0
    for _ in range(50):
        w = [RND.choice("ab").encode() for _ in range(RND.randint(0, 40))]
        n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert quality.repeated_words(w) == len(hit)


def test_every_separator_makes_a_menu():
    for sign in "|<>•·»›":
        assert quality.line_fails(f"Home {sign} Products {sign} Contact {sign} Login") == "navigation"
        assert quality.line_fails(f"a longer line of running words {sign} and what comes after that sign") is None
    assert quality.judged(words(30) + "\nStart › Shop › Cart")["lost_chars"] == len("Start›Shop›Cart")


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def test_secrets(spark, empty):
    key, ours = "0123456789abcdef0123", "ghp_" + "A1b2" * 6
    rows = [(0, f'token = "{key}" and {key}', "a"), (1, f"password:{key} AKIAABCDEFGHIJKLMN", "b"), (2, None, "a"), (3, "", None), (4, "token: short AKIASHORT", "a"), (5, f"😀 {ours} x", "a"), (6, "ghp_" + "Z" * 24, "a"), (7, "ghp_" + "Z" * 24, "b"), (8, "token=password=abcdefghijklmnop", "c"), (8, "token=password=abcdefghijklmnop", "c"), (None, f"secret={key}", None)]
    docs = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id int, text string, source string, spans string, h int")
    got = secrets.scan(docs, ["doc_id"]).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()
    expected = []
    for i, t, _ in rows:
        t = t or ""
        found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 3, "provider", m.end()) for m in re.finditer("ghp_[A-Za-z0-9]{20,}", t) if "Z" not in m[0]]
        expected.append((i, ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))))
    assert counted(got) == counted(expected)
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert masked[0] == '[SECRET]" and [SECRET]' and masked[2] is None and masked[5] == "😀 [SECRET] x" and masked[6].startswith("ghp_")
    assert secrets.redact(docs).columns == docs.columns and secrets.scan(empty, ["doc_id"]).count() == 0


def test_private_keys_are_whole_blocks(spark):
    """Other keys under the same header are other values, and no part of a key stays."""
    body = lambda c: "\n".join([c * 60] * 3 + [c * 20 + "=="])
    block = lambda c: f"-----BEGIN RSA PRIVATE KEY-----\n{body(c)}\n-----END RSA PRIVATE KEY-----"
    cut = f"-----BEGIN RSA PRIVATE KEY-----\n{body('e')}"
    rows = [(0, f"x {block('G')} y", "a"), (1, f"x {block('H')} y", "b"), (2, block("K"), "a"), (3, block("K").replace("\n", "\r\n"), "b"), (4, f"{block('L')} {block('M')}", "c"), (5, cut, "c"), (6, cut.replace("e" * 20, "f" * 20) + " " + "word - " * 30_000, "c"), (7, block("N").replace("\n", "\\n"), "c")]
    masked = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert masked == {0: "x [SECRET] y", 1: "x [SECRET] y", 2: rows[2][1], 3: rows[3][1], 4: "[SECRET] [SECRET]", 5: "[SECRET]", 6: "[SECRET] " + "word - " * 30_000, 7: "[SECRET]"}


def test_whole_licenses(spark):
    """Long templates cost their length once for a text, and keys looked up in place or by a join give the same."""
    long = [" ".join(f"w{(i * 7919 + k * 31) % 100_003}" for i in range(3000)) for k in range(4)]
    templates = spark.createDataFrame([*((f"L{k}", t) for k, t in enumerate(long)), ("S", "one two three four five six"), ("S", long[1])], "template_id string, text string")
    cut = lambda t, n: " ".join(t.split()[:n])
    rows = [(1, f"x {long[0]} y"), (2, cut(long[1], 2500)), (3, cut(long[2], 2000)), (4, f"a one two three four five six b {long[3]}"), (5, None), (6, "")] + [(7, long[0])] * 3
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    sets = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(len(w) - 4)}
    want = []
    for i, text in rows:
        best = {}
        for r in templates.collect():
            share = len(sets(text) & sets(r.text)) / len(sets(r.text))
            if share >= 0.8:
                best[r.template_id] = max(share, best.get(r.template_id, 0))
        want.append((i, sorted(best.items())))
    for how in ({}, {"keys_in_place": 0}, {"keys_in_place": 0, "block_keys": 2000, "block_shingles": 4000}):
        found = licenses.scan(docs, templates, ["doc_id"], **how).collect()
        assert sorted((r.doc_id, [(x.template_id, x.containment) for x in r.licenses]) for r in found) == sorted(want)


def test_licenses(spark, empty):
    mit = licenses.TEMPLATES["MIT-text"].split()
    changed = [w if i % 40 else "other" for i, w in enumerate(mit)]
    own = lambda ws: {tuple(w[k : k + 5]) for w in [re.findall("[a-z0-9]+", " ".join(ws).lower())] for k in range(len(w) - 4)}
    part = len(own(mit) & own(changed)) / len(own(mit))
    assert part >= 0.8
    rows = [(0, words(30) + "\nReleased under the MIT License.\n" + words(30)), (1, None), (2, ""), (3, words(50)), (4, words(50) + " " + " ".join(mit) + " " + words(9)), (5, words(77) + " " + " ".join(changed)), (6, " ".join(mit[:20])), (7, "Licensed under the Apache License, Version 2.0.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, licenses string")
    got = {r.doc_id: {x.template_id: x.containment for x in r.licenses} for r in licenses.scan(docs, licenses.default_templates(spark), ["doc_id"]).collect()}
    assert {i: sorted(v) for i, v in got.items()} == {0: ["MIT"], 1: [], 2: [], 3: [], 4: ["MIT-text"], 5: ["MIT-text"], 6: [], 7: ["Apache-2.0"]}
    assert got[4]["MIT-text"] == 1.0 and abs(got[5]["MIT-text"] - part) < 0.02
    assert licenses.scan(empty, licenses.default_templates(spark), ["doc_id"]).count() == 0
    assert licenses.scan(docs, licenses.default_templates(spark).limit(0), ["doc_id"]).where(F.size("licenses") > 0).count() == 0


def test_phrases():
    for _ in range(60):
        reference, text = ("".join(RND.choice("abc ") for _ in range(n)) for n in (80, 60))
        n = i = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in reference:
                j += 1
            i = max(j - 1, i + 1)
            n += 1
        assert language.phrases(text, language.suffix_automaton(reference)) == n


def test_language_held_out(spark):
    alphabets = {"aa": "abcde", "bb": "vwxyz", None: "abcde"}
    rows = [(i, "".join(RND.choice(alphabets[g] + " ") for _ in range(200)), g) for i, g in ((i, ("aa", "bb", None)[i % 3]) for i in range(90))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !", "bb"), (None, "abc abd", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    references = language.fit(docs, sample_docs=10)
    got = {r.doc_id: r for r in language.identify(docs, references, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows[:90] if g)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.fit(docs.limit(0)) == {} and language.identify(docs, {}, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_levenshtein_automaton():
    terms = {"aabba": 0.9, "abcab": 0.8, "abc": 0.7, "ccccc": 0.6}
    lexicon = toxicity.Lexicon(terms, {}, {}, fuzzy=0.5)
    for _ in range(3000):
        w = "".join(RND.choice("abc") for _ in range(RND.randint(1, 7)))
        near = {t: distance(w, t) for t in terms}
        exact = [p for t, p in terms.items() if near[t] == 0]
        fuzzy = [0.5 * p for t, p in terms.items() if near[t] == 1 and len(t) >= toxicity.FUZZY_LETTERS]
        assert lexicon.read(w)[0] == (exact[0] if exact else max(fuzzy, default=0.0))


def test_toxicity_held_out(spark):
    def text(toxic):
        w = ["".join(chr(97 + int(c)) for c in RND.choice(VOCABULARY)[1:]) + "xyz" for _ in range(60)]
        for _ in range(3 * toxic):
            w.insert(RND.randrange(60), RND.choice(["beastly", "vermin", "rotten"]))
        return " ".join(w)

    rows = [(i, text(i % 5 == 0)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "a beastlly thing, you vermn"), (None, "vermin rotten")]
    docs = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(7, 1, None), (None, 0, 1), (5, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model["terms"]) == {"beastly", "vermin", "rotten"}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= toxicity.PREDICTED) == (i % 5 == 0) for i in range(300))
    assert got[1000] == got[1001] == 0.0 and got[1002] >= toxicity.PREDICTED and got[None] > 0.9
    plain, cited = (toxicity.Scorer(toxicity.Lexicon({"vermin": 0.9}, {}, {})).score(t) for t in ("they are vermin", 'the paper quoted "they are vermin" in full'))
    assert cited < toxicity.PREDICTED < plain
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none, ["doc_id"]).where("score > 0").count() == 0


def test_quotation_encloses_the_hit():
    quoted = lambda t: toxicity.quoted(t, t.index("vermin"), t.index("vermin") + 6)
    for t in ("you’re vermin, don’t come back", "c’est vermin, l’autre", 'a "fine" day, vermin, a "good" one', "«a» vermin «b»", "“a” vermin “b”", '"' + "long " * 20 + '" vermin "b"', "vermin “b”"):
        assert not quoted(t), t
    for t in ('see "such vermin here" now', "see “that’s vermin here” now", "„so vermin“ x", "« le vermin »", "‘the vermin’ x"):
        assert quoted(t), t


def test_sql_counterparts(spark, docs, table):
    """The SQL gives the same as the queries on the odd table too (rows with ids, each once)."""
    duckdb = pytest.importorskip("duckdb")
    from ripplemark.llm import sql

    block = "-----BEGIN RSA PRIVATE KEY-----\n{0}\n{0}\n-----END RSA PRIVATE KEY-----"
    more = [f"a {block.format('Q' * 60)} b", f"{block.format('Q' * 60)}", f"x {block.format('R' * 60)} {block.format('S' * 60)}", "-----BEGIN PRIVATE KEY----- alone", "Home • Shop › Cart » Login", "more of it ...", "All rights reserved.\nx", "token=abcdefghijklmnop AKIAABCDEFGHIJKLMN0 " + "f" * 20]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate([*texts_once(table), *more])]
    own = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = substrings.dedup_substrings(own, ["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert counted(got.collect()) == counted(con.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({sql.OP5})").fetchall())
    spans = con.sql(f"SELECT doc_id, spans FROM ({sql.OP8})").fetchall()
    assert counted(secrets.scan(own, ["doc_id"]).select("doc_id", secrets.joined(F.col("spans"))).collect()) == counted(spans) and "private" in str(spans)
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept"
    assert counted(quality.quality(own, ["doc_id"]).select(*names.split(", ")).collect()) == counted(con.sql(f"SELECT {names} FROM ({sql.OP4})").fetchall())


def texts_once(table):
    return [t for i, t in table if i is not None][:48]


def test_recall_in_a_family_far_over_the_bucket(spark):
    """1,000 texts from one template, alike by 0.75, with 125 pairs at 0.805 among them, in buckets of 64."""
    rnd = random.Random(3)
    names = [f"v{i}" for i in range(5000)]
    template = [rnd.choice(names) for _ in range(258)]
    tails = [[rnd.choice(names) for _ in range(42)] for _ in range(875)]
    tails += [[rnd.choice(names) for _ in range(28)] + tails[j][28:] for j in range(125)]
    rows = [(i, " ".join(template + t)) for i, t in enumerate(tails)]
    own = [shingles(t) for _, t in rows]
    assert all(len(own[j] & own[875 + j]) >= 0.8 * len(own[j] | own[875 + j]) for j in range(125))
    _, classes = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket=64)
    got = {r.first: (r.class_id, r.links) for r in classes.select("first", "class_id", "links").collect()}
    found = sum(got[j] == got[875 + j] == (j, 1) for j in range(125))
    assert found >= 124 and all(got[i] == (i, 0) for i in range(125, 875))


def test_ids_that_are_null_or_repeat(spark):
    """Rows of one id, or of none, meet their own texts only, and ties have a defined row."""
    same = words(40)
    rows = [(None, words(30)) for _ in range(50)] + [(7, words(30)) for _ in range(50)] + [(None, same), (None, same), (7, same + " tail"), (7, same + " tail")]
    rows = [(i, t, t and t[:5], t and t[5:9]) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, own_id string, t string")
    got, classes = ngram_join.near_duplicates(docs)
    assert got.count() == 104 and classes.where("links = 1").count() == 2
    kept = ngram_join.one_of_each(docs).collect()
    assert len(kept) == 101 and sum(r.text == same + " tail" for r in kept) == 1


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("this work may be used by anyone who reads the whole of it twice")
    docs = spark.createDataFrame([(1, "x y z. This work may be used by anyone who reads the whole of it twice! a b")], "doc_id int, text string")
    found = licenses.scan(docs, licenses.templates_from(spark, str(tmp_path)), ["doc_id"]).first()
    assert [(x.template_id, x.containment) for x in found.licenses] == [("Own-1.0", 1.0)]


def test_owners_and_repositories_are_counted_apart(spark):
    ours = {n: f"ghp_{n}" + "A1b2" * 6 for n in "xyz"}
    rows = [(0, ours["x"], "r1", "o1"), (1, ours["x"], "r2", "o1"), (2, ours["y"], "r1", "o1"), (3, ours["y"], "r1", "o2"), *((10 + i, ours["z"], f"r{i}", "o1") for i in range(4))]
    docs = spark.createDataFrame(rows, "doc_id int, text string, repo string, owner string")
    got = {r.doc_id: len(r.spans) for r in secrets.scan(docs, ["doc_id"], repository="repo", owner="owner").collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 10: 0, 11: 0, 12: 0, 13: 0}


def test_very_many_matches(spark):
    """Blocks of matches join without a seam: places, overlaps across blocks and masks as by a plain walk."""
    text = " ".join(f"{i:016x} token={i:012d}0123456789abcdef" if i % 3 else "no" for i in range(1500))
    docs = spark.createDataFrame([(1, text, "a"), (2, "token=" + "0" * 20, "a")], "doc_id int, text string, source string")
    row = {r.doc_id: r.spans for r in secrets.scan(docs, ["doc_id"]).collect()}
    expected = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text)] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
    assert [(s.kind, s.start, s.end) for s in row[1]] == sorted(expected, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
    out, at = "", 0
    for a, b in sorted((a, b) for _, a, b in expected):
        out, at = (out + text[at:a] + "[SECRET]", b) if a >= at else (out, max(at, b))
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {1: out + text[at:], 2: "[SECRET]"}


def test_hot_facts_reach_their_rows(spark):
    from ripplemark.llm.common import join_facts

    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 9000).alias("node"), "id")
    facts = rows.groupBy("node").agg(F.count("*").alias("rows"), F.max("id").alias("last")).where("node % 7 <> 3")
    got = join_facts(rows, facts, "node", "rows", 40_000)
    assert got.count() == 40_000 and set(got.columns) == {"node", "id", "rows", "last"}
    assert got.exceptAll(rows.join(facts, "node", "left").select(*got.columns)).count() == 0
