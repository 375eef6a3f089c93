"""The corpus pipeline: stages over documents, each written and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, whatever they are besides doc_id, text and lang. A stage works on all rows that its predecessor kept. An empty
table passes through every stage; equal rows fare alike; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldline.llm.bpe_transducer import encode_decode
from foldline.llm.catalog import tokenizer_path
from foldline.llm.decontaminate import without_items
from foldline.llm.language_id import with_language
from foldline.llm.line_dedup import keep_first_lines
from foldline.llm.ngram_join import similarity_classes
from foldline.llm.shared import MADE, bound_batches, cut, drop, table, work_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, null and empty ones with them; lang becomes the predicted language. A null doc_id stays."""
    bound_batches(spark)
    return with_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that an earlier document or line has within two edits, or, of fewer than 30 characters, exactly. Rows with a null doc_id or text stay as they are."""
    return keep_first_lines(docs, work_dir(spark, "lines"), short=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word sets of Jaccard similarity 0.8, the smallest doc_id. Rows with a null doc_id or without words stay, and all rows of a doc_id that stays."""
    classes = similarity_classes(docs, work_dir(spark, "ngrams"), n=5, percent=80)
    others = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows with a null doc_id or text stay; null and short items are never found."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids and decoded text of every document that is left, as hashes; of a null text, those of the empty one. A null doc_id stays null."""
    bound_batches(spark)
    return encode_decode(docs, tokenizer_path())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]
#: SQL expresses none of the stages but decontamination; tests/llm has brute-force versions of the operators and of all stages in a row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, cutting the lineage after each; what a stage wrote goes once the next has been written."""
    docs, folder, before = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        made, place = len(MADE), f"{folder}/{k}-{name}"
        docs = cut(stage(spark, docs, sf_dir), place)
        for old in [*MADE[made:], *([before] if before else [])]:
            drop(spark, old)
        del MADE[made:]
        before = place
    return docs
