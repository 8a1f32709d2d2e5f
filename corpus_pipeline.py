"""The corpus pipeline: documents to packed training sequences, in stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next one. All but the last return the columns of ``documents``.

For every stage: texts of any length are read whole, columns of other names, also those that the
operators use inside, come through unchanged, an empty table gives an empty result, and null ids are
allowed. Null and empty texts have no words, so the first stage rejects them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.llm import exact_dedup, mixing, near_sets, packing, quality, simhash
from linkrisk.llm.common import stored, table, text_of, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects; repeated rows are judged alike."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id, one without id only if no other has one; repeated
    rows share one verdict."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by four bits of a SimHash of four-word shingles (:func:`op8's operator
    <linkrisk.llm.simhash.keep_first>`) the document with the smallest id; then the same of each group linked by a
    Jaccard coefficient of 0.8 of five-word shingles. The SimHash misses most of the latter, so these sets are joined exactly.
    Documents without id stay where no row of their group has one; repeated rows share one verdict."""
    first = stored(simhash.keep_first(docs), "simhash-kept")
    return near_sets.keep_first(first, width=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that token shares fit the softened marginals of source, language, topic (by
    the initials of all words). Null values are a value of their own; a document without id is drawn by its text; repeated rows agree."""
    (topic,) = unused(docs, "_topic")
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(topic)}
    return mixing.mixing_weights(docs.withColumn(topic, mixing.main_topic(text_of("text"))), dims=dims).where("sampled").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' token pieces in sequences of 2048 ids; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Near-duplicates, raking and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each one's result stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
