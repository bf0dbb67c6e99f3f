"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by regular expressions, one list per kind, in whole texts.  The hash of each candidate's value is
then counted over distinct repositories and owners of the whole corpus: a value that many owners hold is an example
copied from documentation, one that stays with a single owner looks live.  Three base kinds are always reported; the
added kinds (provider tokens, signed web tokens, private keys, credentials in addresses) only where they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import checkpointed, free, join_facts, let

#: Fixed patterns.  Base kinds first, in the order in which spans of one start are listed.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
ADDED = {
    "provider": r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}",
    "signed": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "address": r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[^\s/@]+",
}
#: Where the value of a match is not the whole match, the group that holds it.
_VALUE = {"assign": 1}
#: A match counts only if its value has so many characters (``{n,}`` in the other patterns says the same: their matches are whole runs).
_LEAST = {"assign": 12}
#: What is read in a text where that is more than the kind's pattern, which finds the texts: a whole key block, or what
#: there is of one (header lines, then base64 lines) where its end is missing.
#: Loops over groups are bounded, as Java recurs there.
_BREAK = r"(?:\s|\\[rn])"
_WHOLE = {"private": rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-{{1,4}}+(?!-)[^-]*+){{0,64}}+-----END [A-Z ]*PRIVATE KEY-----|(?:\s++[A-Za-z-]+: [^\n]*+){{0,20}}+(?:{_BREAK}*+[A-Za-z0-9+/=]{{16,}}+){{1,1000}}+(?:{_BREAK}++[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=[^\S\n]*(?:\n|$)))?)?"}
#: What counts as the same value: the body of a key without its lines' ends.
NOT_BODY = r"-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----|\\[rn]|\s+"
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _blocks(items: Column, size: int = 256) -> Column:
    """``items`` in runs: what is built up step by step stays short, so the work grows with the items and not with their square."""
    last = F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * size + 1, size))


def _along(blocks: Column, over) -> Column:
    """A number before each block: 0, then ``over(number, block)`` of the one before."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(blocks, zero, lambda acc, b: F.struct(over(acc["at"], b).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches as ``kind, start, end, value``; code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so running lengths give the places.
    """
    has, pattern = text.rlike(pattern), _WHOLE.get(kind, pattern)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["between"])
        end = start + F.coalesce(F.length(pair["found"]), F.lit(0))
        value = F.regexp_extract(pair["found"], pattern, _VALUE[kind]) if kind in _VALUE else pair["found"]
        value = F.coalesce(F.nullif(F.regexp_replace(value, NOT_BODY, ""), F.lit("")), value) if kind == "private" else value
        span = F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))
        keep = pair["found"].isNotNull() & (F.length(value) >= _LEAST.get(kind, 1))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def size(pair: Column) -> Column:
        return F.length(pair["between"]) + F.coalesce(F.length(pair["found"]), F.lit(0))

    def spans(blocks: Column) -> Column:
        starts = _along(blocks, lambda at, b: F.aggregate(b, at, lambda n, pair: n + size(pair)))
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), step, lambda acc: acc["out"])))

    merged = let(F.arrays_zip(between.alias("between"), found.alias("found")), lambda pairs: let(_blocks(pairs), spans))
    return F.when(has, merged).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` with ``spans``, every match of every kind in the whole text (null: none), in order."""
    own = F.coalesce(F.col(text), F.lit(""))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*BASE, *ADDED)) for x in (k, i)])

    def before(a: Column, b: Column) -> Column:
        ra, rb = rank[a["kind"]], rank[b["kind"]]
        return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(ra < rb, -1).when(ra > rb, 1).otherwise(0)

    every = F.concat(*[_spans(own, k, p) for k, p in (BASE | ADDED).items()])
    return docs.select(*columns, F.array_sort(every, before).alias("spans"))


def ownership(found: DataFrame, repository: str, owner: str) -> DataFrame:
    """``h`` (hash of a value), ``rows``, ``repositories`` and ``owners`` that hold it; pre-aggregated before each shuffle.

    A null repository or owner counts as one unknown repository or owner.
    """
    none = F.lit("")
    rows = found.select(F.coalesce(F.col(repository).cast("string"), none).alias("r"), F.coalesce(F.col(owner).cast("string"), none).alias("o"), F.explode("spans").alias("s"))
    rows = rows.groupBy(F.sha2(F.col("s.value"), 256).alias("h"), "r", "o").agg(F.count("*").alias("n"))
    return rows.groupBy("h").agg(F.sum("n").alias("rows"), F.count_distinct("r").alias("repositories"), F.count_distinct("o").alias("owners"))


def scan(docs: DataFrame, columns: list[str], repository: str = "source", owner: str = "source", text: str = "text", max_owners: int = 1, max_repositories: int = 3, name: str = "spans") -> DataFrame:
    """``columns`` with ``spans`` (or another ``name``): base matches, and added matches whose value looks live, each with ``live``.

    Live-looking: held by at most ``max_owners`` owners and ``max_repositories`` repositories in the whole corpus (two
    columns, which may be one where a table knows no difference).  A null or empty text has no spans; very long texts
    are read whole; repeated rows each get theirs, and count once as holders; an empty table gives none.  ``columns``
    may have any names.  Texts are not shuffled: spans are gathered beside the row's place in a checkpoint, and only
    values and hashes move.  A value that a large part of all candidates share does not meet in one task.
    """
    names = [f"_c{i}" for i in range(len(columns))]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)], F.col(f"`{repository}`").alias("_r"), F.col(f"`{owner}`").alias("_o"), F.col(f"`{text}`").alias("_t"))
    found = checkpointed(candidates(own, [*names, "_r", "_o"], "_t")).withColumn("_id", F.monotonically_increasing_id())
    total = found.agg(F.sum(F.size("spans"))).first()[0] or 0
    shared = ownership(found, "_r", "_o").where((F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)).select("h", "rows", F.lit(True).alias("shared"))
    each = found.select("_id", F.posexplode("spans").alias("k", "s")).withColumn("h", F.sha2(F.col("s.value"), 256))
    each = join_facts(each, checkpointed(shared), "h", "rows", total)
    each = each.where(F.col("shared").isNull() | F.col("s.kind").isin(*BASE))
    item = F.struct("k", F.struct(F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("shared").isNull().alias("live")).alias("s"))
    kept = each.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("_s"))
    out = found.select("_id", *names).join(kept, "_id", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,live:boolean>>")
    return out.select(*[F.col(n).alias(c) for c, n in zip(columns, names)], F.coalesce("_s", none).alias(name))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(own: Column, spans: Column, mask: str) -> Column:
    """``own`` with its ordered ``spans`` replaced; the text is cut into the stretches of blocks of spans first."""

    def reach(at: Column, block: Column) -> Column:
        return F.aggregate(block, at, lambda n, s: F.greatest(n, s["end"]))

    def stretch(block: Column, at: Column) -> Column:
        def step(local: Column):
            def one(acc: Column, s: Column) -> Column:
                out = F.concat(acc["out"], local.substr(acc["at"] - at + 1, s["start"] - acc["at"]), F.lit(mask))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], out).otherwise(acc["out"]).alias("out"))

            return F.aggregate(block, F.struct(at.alias("at"), F.lit("").alias("out")), one, lambda acc: acc["out"])

        return let(own.substr(at + 1, reach(at, block) - at), step)

    def whole(blocks: Column) -> Column:
        parts = F.zip_with(blocks, _along(blocks, reach), stretch)
        return F.concat(F.array_join(parts, ""), own.substr(reach(F.lit(0), F.flatten(blocks)) + 1, F.length(own)))

    return let(_blocks(spans), whole)


def redact(docs: DataFrame, mask: str = "[SECRET]", text: str = "text", **how) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask`` (overlapping spans by one).

    Texts without a match of any pattern, nulls and empty ones included, pass through as they are and are not moved.
    Repeated rows are masked alike; an empty table stays empty.  The columns are those of ``docs``, whatever their names.
    """
    marked = F.coalesce(F.col(f"`{text}`").rlike("|".join(f"(?:{p})" for p in (BASE | ADDED).values())), F.lit(False))
    spans = free("_secret_spans", docs.columns)
    found = scan(docs.where(marked), docs.columns, text=text, name=spans, **how)
    clean = masked(F.col(f"`{text}`"), F.col(spans), mask)
    return docs.where(~marked).unionByName(found.withColumn(text, clean).select(*[f"`{c}`" for c in docs.columns]))


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query 8 over all documents; the table has one column, the source, for a repository and its owner."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), live)
