"""The corpus pipeline: from ``documents`` to packed training sequences.

Five stages, each one operator of ``bitweave.llm`` over all that the stage before
kept: language ID (documents without a language go), n-gram Jaccard join (one
document of each group of near copies stays), substring dedup (repeated windows
are cut out of the texts, and documents of which nothing is left go), benchmark
decontamination (contaminated documents go), packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.llm._blocks import stored
from bitweave.llm.decontamination import decontaminate
from bitweave.llm.language_id import identify_language, train
from bitweave.llm.ngram_join import ngram_jaccard_join
from bitweave.llm.packing import TOKENIZER, pack_documents
from bitweave.llm.substring_dedup import substring_dedup

LEAST_SCORE = 0.5
MOST_BROADCAST_IDS = 2_000_000  # of 8 bytes each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that no language claims."""
    judged = identify_language(docs, train(docs), keep=tuple(docs.columns), names=("_lang_pred", "_lang_score"))
    return judged.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= LEAST_SCORE)).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    gone = stored(ngram_jaccard_join(docs).where("doc_id <> component_id").select("doc_id").distinct())
    few = gone.count() <= MOST_BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated windows out of the texts; a document of which nothing is left goes."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    renamed = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_carried{i}") for i, c in enumerate(carry)))
    cut = substring_dedup(renamed, carry=tuple(renamed.columns[2:]), tidy=False).where("n_removed = 0 or kept <> ''")
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")} | {c: F.col(f"_carried{i}") for i, c in enumerate(carry)}
    return cut.select(*(back[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"_carried{i}") for i, c in enumerate(docs.columns)))
    judged = decontaminate(renamed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(renamed.columns), text_col=f"_carried{docs.columns.index('text')}")
    return judged.where("not contaminated").select(*(F.col(f"_carried{i}").alias(c) for i, c in enumerate(docs.columns)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_join),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # tokenising and packing have no SQL; tests/llm compares run() with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
