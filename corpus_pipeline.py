"""A corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. A filtering stage decides by row or by id: of rows repeated
with one id, all stay or all go, and a stage's result for each operator's odd cases (null
and empty texts, ties, null ids) is the one in that operator's docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.exact_dedup import exact_duplicates
from voxloom.llm.language_id import held_out, predict, train_on
from voxloom.llm.ngram_join import ngram_components
from voxloom.llm.packing import pack
from voxloom.llm.queries import tokenizer_path
from voxloom.llm.scratch import stash
from voxloom.llm.sentence_dedup import remove_repeated_spans


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id (null included) is among ``ids``, a column ``kept_id``."""
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the language model rejects: without letters, or below its calibrated threshold."""
    model = train_on(docs, "doc_id", "text", "lang", ~held_out(F.col("doc_id")))
    return docs.where(~predict(spark, model, F.col("text"))["rejected"])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    found = exact_duplicates(docs, keep="max")
    return _only(docs, found.where("kept").select(F.col("doc_id").alias("kept_id")))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    found = ngram_components(docs)
    return _only(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages from the texts, and counts their characters anew."""
    cut = remove_repeated_spans(docs, count_col="__removed")
    changed = F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*[changed.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens with each source's share in all of them."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), window=1024)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: The learned model and the tokenizer are beyond SQL; tests compare with brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; returns the pieces of the packed sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
