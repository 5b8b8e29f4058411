"""From raw documents to encoded ones: toxic documents and copies go, sources are mixed, texts are encoded.

Each stage works on all that the one before kept and returns the columns of documents; the last returns
doc_id, ids, n_bytes and decoded. Columns besides doc_id, text and source are carried along, whatever their names. Rows
without a doc_id, rows that share one and rows repeated in full are rows like any other. An empty table gives an empty
result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.exact_dedup import without_exact_copies
from rasterloom.llm.mixing import mixed_documents
from rasterloom.llm.pieces import encode_table
from rasterloom.llm.shared import materialize
from rasterloom.llm.similar import without_similar
from rasterloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (operator 1). Learned from labels outside its held-out quarter; a null or
    empty text has no features and stays unless most labelled texts are toxic; without labels all rows stay."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z the one with the largest doc_id stays (operator 8); null counts as empty, so
    one row without a text stays; of equal rows that share a doc_id, or have none, one stays."""
    return without_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the one with the least doc_id stays (operator 9): texts joined by pairs of Jaccard similarity 0.8 or
    more of their 5-word shingles. Candidates are the trie join's links and, since a fingerprint of 64 bits can't give all
    such pairs, those of an exact prefix join; every candidate is compared in full. Texts without words are alike."""
    return without_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights (operator 7): each document as often as its systematic sample says, 0 to 3
    times. A null source is the last one; a text without words has no size and comes with its source's rate."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as piece ids, and whether these decode to the text again (operator 5). A null or empty text has no ids."""
    return encode_table(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: A learned classifier and fingerprints can't be put in SQL: tests/llm hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
