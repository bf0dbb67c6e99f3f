"""The registered queries of the text operators, and the SQL that some of them can be held against."""

from __future__ import annotations

from ripplemark.llm import sql
from ripplemark.llm.bpe import op7_bpe
from ripplemark.llm.centroids import op12_centroids
from ripplemark.llm.covertree import op11_embedding_dedup
from ripplemark.llm.decontaminate import op6_decontaminate
from ripplemark.llm.language import op2_language
from ripplemark.llm.lexical import op13_lexical_search
from ripplemark.llm.licenses import op3_licenses
from ripplemark.llm.ngram_join import op1_ngram_join
from ripplemark.llm.quality import op4_quality
from ripplemark.llm.secrets import op8_secrets
from ripplemark.llm.substrings import op5_substring_dedup
from ripplemark.llm.suffixes import op9_suffix_dedup
from ripplemark.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_language": op2_language,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_bpe": op7_bpe,
    "op8_secrets": op8_secrets,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_centroids": op12_centroids,
    "op13_lexical_search": op13_lexical_search,
}

#: Not for language, BPE and toxicity (tested by held-out accuracy and against the tokenizers library) and the suffix
#: arrays (all 400-byte strings are too slow in SQL; tested against brute force).
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": sql.OP1,
    "op3_licenses": sql.OP3,
    "op4_quality": sql.OP4,
    "op5_substring_dedup": sql.OP5,
    "op6_decontaminate": sql.OP6,
    "op8_secrets": sql.OP8,
    "op11_embedding_dedup": sql.OP11,
    "op12_centroids": sql.OP12,
    "op13_lexical_search": sql.OP13,
}
