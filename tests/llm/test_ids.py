"""Ids beyond what a double holds, beside a null: exact in every operator."""

import pytest

from cutloom.llm import binary_ids, decontaminate, language, media, neardup, packing, quality, token_counts, toolcalls, warc
from cutloom.llm.common import scratch, tokenizer_path

BIG = 2**53 + 1
BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = [(BIG, "a few words of text that stand in a row here"), (None, "other words of no document"), (7, None), (BIG + 2, "")]


def op10(df):
    stored = media.store_texts(df)
    return media.features(media.tiff_pages(media.described(stored)))


RUNS = {
    "packing": lambda df: packing.pack(df, BPE),
    "decontamination": lambda df: decontaminate.contamination(df, df.selectExpr("doc_id as item_id", "text")),
    "quality": lambda df: quality.classify(df, quality.train(df, df.selectExpr("doc_id", "1 as quality"))),
    "binary_ids": lambda df: binary_ids.read_ids(binary_ids.write_ids(df, BPE, scratch(df.sparkSession, "huffman"))),
    "language": lambda df: language.identify(df, language.train(df.withColumn("lang", df.text.substr(1, 1)))),
    "token_counts": lambda df: token_counts.token_counts(df, PIECES),
    "prefix_tables": lambda df: token_counts.prefix_tables(df, PIECES, [3]),
    "neardup": lambda df: neardup.near_duplicates(df),
    "media": op10,
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_documents(spark, name):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    got = {r.doc_id for r in RUNS[name](df).select("doc_id").collect()}
    assert got == {d for d, _ in TEXTS}


def test_pages(spark):
    df = spark.createDataFrame([(BIG, "u", "x" * 2000), (BIG + 2, "u", "x" * 2000), (None, "u", "y")], "page_id long, url string, html string").coalesce(1)
    got = warc.records(warc.read_warc(warc.write_warc(df, scratch(spark, "warc"))))
    assert {(r.page_id, r.refers_to) for r in got.collect()} == {(BIG, BIG + 2), (BIG + 2, None), (None, None)}


def test_calls(spark):
    call = '{"tool_calls":[{"id":"a","name":"lookup","arguments":{"query":"q","top":1}}]}'
    df = spark.createDataFrame([(BIG, BIG, "assistant", call), (None, 1, "assistant", call)], "conv_id long, turn long, role string, text string").coalesce(1)
    assert [(r.conv_id, r.turn) for r in toolcalls.link_calls(df, toolcalls.SCHEMAS).collect()] == [(BIG, BIG)]
