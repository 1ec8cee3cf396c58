"""The corpus pipeline: stages over `documents`, each of one operator of lakeferry.llm.

run() applies them in order; each stage's result is written to shared storage and read again as the next one's input.

Null, empty and very long texts, repeated rows, empty tables and further columns pass as the operators say: a text that is null or
has no letter goes in the first stage, of rows that repeat one stays. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeferry.llm.base import cut, fresh, table
from lakeferry.llm.bpe import ByteBPE, digest
from lakeferry.llm.decontam import Decontaminator
from lakeferry.llm.langid import LanguageID, held_out
from lakeferry.llm.pii import Pseudonymiser, pseudonymise
from lakeferry.llm.queries import PII_KEY
from lakeferry.llm.similar import near_deduplicated

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; the models learn from the rows that op6 learns from."""
    model = LanguageID(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    found = fresh(docs, "found")
    return docs.withColumn(found, model.predict(F.col("text"))).where(~F.col(f"{found}.rejected")).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share their five-word shingles by a Jaccard similarity of 0.8 or more, the document with the least
    doc_id stays."""
    return near_deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items go; of the others, windows of eight words are cut out."""
    return Decontaminator(table(spark, sf_dir, "benchmark")).clean(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return pseudonymise(docs, Pseudonymiser(spark, PII_KEY))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to."""
    import public_tokenizers

    return digest(docs, ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("tokens", tokens),
]

#: SQL has neither the models nor the hashes; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
