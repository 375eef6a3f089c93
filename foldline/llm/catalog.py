"""Queries over the text tables, each with production parameters, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldline.llm import conversation_trie, decontaminate, host_rules, substring_dedup
from foldline.llm.shared import table, work_dir


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.ngram_join import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents"), work_dir(spark, "ngrams"), n=4, percent=85)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), work_dir(spark, "ann"), every=50, k=5)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), work_dir(spark, "spans"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.html_wrappers import main_text

    return main_text(table(spark, sf_dir, "pages"), work_dir(spark, "wrappers"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.token_store import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"), tokenizer_path(), 2, work_dir(spark, "store"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.line_dedup import line_classes

    return line_classes(table(spark, sf_dir, "documents"), work_dir(spark, "lines"), short=True)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.bpe_transducer import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"), work_dir(spark, "trie"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), work_dir(spark, "whitening")).selectExpr("* except (deviation)", "try_cast(deviation AS bigint) AS deviation")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_verdicts(table(spark, sf_dir, "documents"), work_dir(spark, "rules"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_decontaminate, op3_quality, op4_ann_search, op5_language_id, op6_substring_dedup, op7_html_text, op8_token_store, op9_line_dedup, op10_bpe_codec, op11_conversation_trie, op12_whitening, op13_quality_rules)}
ORACLES = {"op2_decontaminate": decontaminate.ORACLE, "op6_substring_dedup": substring_dedup.ORACLE, "op11_conversation_trie": conversation_trie.ORACLE, "op13_quality_rules": host_rules.ORACLE}
