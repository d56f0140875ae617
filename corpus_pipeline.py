"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the result of each is written as Parquet
and read again as the next one's ``docs``. All stages but the last return the columns of ``documents``. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.bpe import encode_decode
from marginalia.llm.common import small_batches, written
from marginalia.llm.linededup import line_dedup
from marginalia.llm.mixing import BUDGET, mixed
from marginalia.llm.neardup import one_of_each
from marginalia.llm.quality import keep_good
from marginalia.llm.queries import table, token_digests, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject; null and empty texts go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of runs of lines; n_chars follows the text. Of equal runs the one of the smallest id stays."""
    with small_batches(spark):
        kept = line_dedup(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class; texts that the stage before left without words are one class."""
    return one_of_each(docs, blanks_apart=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of ``BUDGET`` of the tokens towards flattened shares of source, language and topic; what is too rare stays whole.

    Null sources and languages are values of their own.
    """
    return mixed(docs, budget=BUDGET).where("drawn").select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document, repeated rows included."""
    with small_batches(spark):
        return token_digests(encode_decode(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: The learned rules, near-duplicate classes and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
