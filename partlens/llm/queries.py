"""The queries of this subpackage and the SQL they are checked with."""

from __future__ import annotations

import public_tokenizers

from . import chat, exact, findings, jaccard, licenses, lines, merkle, middles, mixing, packing, quality, sentencepieces, suffixes

QUERIES, ORACLES = {}, {}


def _query(name, table, build, sql=None):
    QUERIES[name] = lambda spark, directory: build(spark.read.parquet(f"{directory}/{table}.parquet"))
    if sql:
        ORACLES[name] = sql


_query("op1_quality_rules", "documents", quality.judge, quality.ORACLE)
_query("op2_best_fit_packing", "documents", lambda docs: packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))
_query("op3_exact_dedup", "documents", exact.assign, exact.ORACLE)
_query("op7_license_scan", "documents", licenses.scan, licenses.oracle())
_query("op8_line_dedup", "documents", lines.digest, lines.ORACLE)
_query("op9_chat_formatting", "conversations", chat.digest, chat.ORACLE)
_query("op5_ngram_jaccard_join", "documents", jaccard.digest)
_query("op6_suffix_array_dedup", "documents", suffixes.digest)
_query("op4_sentencepiece", "documents", lambda docs: sentencepieces.digest(docs, public_tokenizers.path("piece_bpe_32k.model")))
_query("op10_lm_scoring", "documents", mixing.score)
_query("op11_merkle_manifest", "documents", merkle.digest, merkle.ORACLE)
_query("op12_fill_in_middle", "documents", middles.digest, middles.ORACLE)
_query("op13_secret_scan", "documents", findings.scan)
