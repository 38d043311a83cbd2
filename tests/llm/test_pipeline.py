import re
from collections import Counter, defaultdict

import duckdb
import plain
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from partlens.llm import packing, quality

SMALL = "/root/testdata/sf0.001"


def test_registered():
    names = contract.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]


def with_words(texts):
    return {k: t for k, t in texts.items() if plain.WORD.search(t)}


def test_stages_against_plain_versions(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    texts = dict(con.execute(quality.JUDGED_SQL + "SELECT doc_id, text FROM judged WHERE kept").fetchall())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns

    def check(df):
        assert df.columns == columns
        assert {r.doc_id: r.text for r in df.collect()} == texts

    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = stages[0](spark, docs, SMALL)
    check(docs)
    texts = with_words(plain.line_dedup(sorted(texts.items())))
    docs = stages[1](spark, corpus_pipeline.written(docs), SMALL)
    check(docs)
    first = {k: c for k, (_, c) in plain.components(texts, 5, 80).items()}
    texts = {k: t for k, t in texts.items() if first[k] == k}
    docs = stages[2](spark, corpus_pipeline.written(docs), SMALL)
    check(docs)
    keys = sorted(texts)
    cut = plain.repeated_strings([texts[k].encode() for k in keys], 250)
    texts = with_words({k: left.decode("utf-8", "ignore") for k, (_, _, left) in zip(keys, cut)})
    docs = stages[3](spark, corpus_pipeline.written(docs), SMALL)
    check(docs)
    rows = stages[4](spark, corpus_pipeline.written(docs), SMALL).collect()
    want = plain.pieces(texts, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    rooms = defaultdict(int)
    for r in rows:
        rooms[r.sequence_id] += r.length
    assert max(rooms.values()) <= packing.CAPACITY and len(rooms) <= -(-sum(rooms.values()) // packing.CAPACITY) * 1.02 + 1
    assert Counter(want.keys()) == Counter((r.doc_id, r.piece) for r in rows)
