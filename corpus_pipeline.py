"""A corpus from documents: language, near copies, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir), reads what the one before has kept and returns a DataFrame; run() writes every
stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language, mixing, packing, secrets, simhash
from tidemark.llm.common import DOCUMENT_COLUMNS, Shelf, table
from tidemark.llm.queries import Entry


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    plain = docs.select(*DOCUMENT_COLUMNS)
    return language.identify(plain, language.fit(plain)).filter("accepted").select(*DOCUMENT_COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, pairs by the SimHash trie join and by least hashes, exact Jaccard similarity of 0.8 or more."""
    return simhash.representatives(docs, shingle=5, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; what looks like a secret is masked in their texts."""
    return secrets.masked_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents dropped, kept or repeated as their source's target asks; packing does not look at their order."""
    return mixing.mixed_documents(docs, ordered=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2,048 tokens."""
    return packing.pack(docs, forget=True)


STAGES = [("language", in_known_language), ("near copies", near_copies), ("secrets", without_secrets), ("mix", mixed), ("packing", packed)]

#: SQL can't run the language model, the fingerprints' components or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shelf = table(spark, sf_dir, "documents"), Shelf(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        docs = shelf.put(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs


ENTRY = Entry("pipeline", run, ORACLE_SQL)
