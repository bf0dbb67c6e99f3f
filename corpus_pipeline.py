"""From raw documents to training tokens: quality rules, near duplicates, benchmark passages, secrets, tokens.

All stages take whole texts of any length.  The columns of ``docs`` go through as they are, whatever their names, but for
``text`` and, where there is one, ``n_chars``; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.llm.bpe import tokenize
from ripplemark.llm.common import free, shared_dir
from ripplemark.llm.decontaminate import contamination
from ripplemark.llm.ngram_join import one_of_each
from ripplemark.llm.quality import quality
from ripplemark.llm.secrets import redact

#: A byte-level BPE file of the tokenizers library.
TOKENIZER = "byte_bpe_50k.json"


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, those with a null or empty text among them; of the others, failing lines go.

    Repeated rows fare alike.
    """
    prefix = free("_quality_", docs.columns)
    found = quality(docs, [c for c in docs.columns if c != "text"], clean_text=True, prefix=prefix).where(F.col(f"{prefix}kept")).withColumnRenamed(f"{prefix}clean_text", "text")
    return _with_text(found.select(*[f"`{c}`" for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the least id, null ids last.

    Repeated rows are one; texts without words (null, empty) are in no class and stay.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none; repeated rows fare alike."""
    prefix = free("_benchmark_", docs.columns)
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix=prefix)
    return found.where(F.size(f"{prefix}hits") == 0).select(*[f"`{c}`" for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked: base matches always, the others where they look live.  Null and empty texts and repeated rows stay."""
    return _with_text(redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with the hashes of the ids and of the text decoded from them; a null text has none.

    One row for each document, repeated ones too.
    """
    import public_tokenizers

    return tokenize(docs, public_tokenizers.path(TOKENIZER), ["doc_id"], ids=True)


STAGES = [
    ("quality_rules", rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("bpe", tokens),
]

#: SQL can express neither the near duplicates nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}_{name}")
            docs = spark.read.parquet(path)
    return docs
