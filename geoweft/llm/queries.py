"""Registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweft.llm import bpe, html_extract, media, minhash, packing, quality, sharding, suffix_tree, token_counts, toxicity
from geoweft.llm.textkit import documents

Q: dict = {}
SQL: dict[str, str] = {}
SHARDS, WINDOW, END_ID = 16, 4096, 2


def word_tokenizer() -> str:
    """Place of the tokenizer file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1(spark, sf_dir):
    text = F.col("text")
    keep = {
        "doc_id": F.col("doc_id"), "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        "text_crc32": F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0).cast("long")),
    }
    out = sharding.hilbert_shards(documents(spark, sf_dir), ["lang", "source", "n_chars"], keep, "doc_id", SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op2(spark, sf_dir):
    return token_counts.corpus_totals(documents(spark, sf_dir))


def op3(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir), k=3, percent=85)


def op4(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir))


def op5(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), word_tokenizer(), WINDOW, END_ID)


def op7(spark, sf_dir):
    return media.media(documents(spark, sf_dir))


def op8(spark, sf_dir):
    return bpe.encode_digests(documents(spark, sf_dir), word_tokenizer())


def op9(spark, sf_dir):
    return suffix_tree.score(documents(spark, sf_dir))


def op6(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def op10(spark, sf_dir):
    return html_extract.main_text(documents(spark, sf_dir, "pages"))


Q |= {"op1_hilbert_sharding": op1, "op2_token_counts": op2, "op3_minmax_near_dedup": op3, "op4_quality_rules": op4, "op5_packing": op5, "op6_toxicity": op6, "op7_media_columns": op7, "op8_bpe_codec": op8, "op9_suffix_tree_lm": op9, "op10_html_extraction": op10}
SQL["op4_quality_rules"] = quality.oracle_sql()
SQL["op2_token_counts"] = r"""
WITH d AS (SELECT source, lang, text, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, source NULLS FIRST, lang NULLS FIRST) AS k FROM documents),
e AS (SELECT source, lang, unnest([{'t': 'words-1', 'n': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))}, {'t': 'pieces-1', 'n': len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]'))}]) AS v FROM d WHERE k = 1 OR text IS NULL)
SELECT source, lang, v.t AS tokenizer, count(*) AS documents, sum(v.n)::BIGINT AS tokens FROM e GROUP BY ALL"""
