"""A corpus pipeline: documents in, packed sequences out, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before it kept.
All but the last return the columns of documents; its rows are the pieces of the kept documents
and the bins that they are packed into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowgate.llm import decontaminate, packing, pii, simhash, toxicity
from rowgate.llm.common import prepared, table
from rowgate.session import stage

# A model is fitted to labels, and a field to patterns: SQL cannot express that.
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.drop_toxic(docs, table(prepared(spark), sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    prepared(spark)
    return simhash.keep_one(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go, and documents that are mostly such passages."""
    return decontaminate.decontaminate(docs, table(prepared(spark), sf_dir, "benchmark"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    prepared(spark)
    return pii.redact(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, cut and packed by tokens, and their bins."""
    import public_tokenizers

    prepared(spark)
    pieces = packing.pack_documents(packing.measured(docs, public_tokenizers.path("word_bpe_49k.json")))
    return pieces.select(packing.bin_name().alias("bin_id"), "doc_id", "start", "length")


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_copies_out),
    ("decontamination", benchmark_out),
    ("pii", personal_data_out),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next one."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
