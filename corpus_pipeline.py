"""Documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.llm import langid, packing, pii, simhash
from mixloom.llm.common import land, table
from mixloom.llm.queries import fold

#: SQL has neither suffix automata nor XXH64; tests/llm holds a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known; null and letterless texts go.

    ``lang`` becomes the predicted language.
    """
    samples = langid.sample_languages(docs.where(fold(4) != 2))
    found = langid.identify(docs, samples)
    kept = found.where(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred"))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each near-duplicate group.

    Linked are texts whose fingerprints of three-word shingles differ in at most 3 of 64
    bits. Null, empty and word-less texts are one group; equal rows count as copies, and
    the first stored stays; a null id is larger than any. An empty table stays empty.
    """
    return simhash.near_duplicates(docs).where("kept").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, without personal data and the terms that reveal it.

    Whole texts are searched, however long. A null text stays null, an empty one empty;
    repeated rows stay repeated; an empty table stays empty.
    """
    clean = pii.redact(pii.detect(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens of all documents.

    A null text counts as empty and gives one piece, a very long one as many as it fills;
    repeated rows are placed one by one; an empty table gives no piece.
    """
    return packing.pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = land(docs, name)
    return docs
