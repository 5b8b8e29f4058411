"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A document's identity is an integer name that equals another's exactly if the texts are equal:

1. Texts are normalised (A-Z to a-z only; null counts as empty) and split into fixed-size blocks.
2. The distinct blocks of all documents are sorted, and numbered in that order: a block's name.
3. Adjacent names are paired, distinct pairs sorted and numbered, until each document has one name.

Every document is named, and names alone decide: they number distinct contents, which Spark compares in full. To bring
a block's name to its documents without shuffling texts again, blocks are looked up by a handle (128 bits of hash). If
two distinct blocks ever share a handle, which is seen in the table of names, they are looked up by their text instead.

Scale: the texts are shuffled once, to find the distinct blocks, after those of each task have collapsed (partial
aggregation); numbers come from the places in sorted partitions, without a window. Names are written tables before rows
are joined with them, so adaptive execution splits a hot group's rows over tasks. Rounds: log2 of the longest text's
number of blocks.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .row_keys import KEY, keyed
from .shared import materialize

BLOCK_CHARS = 16384


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else. Texts of one-byte characters take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _handle(block: Column) -> Column:
    """What a block is looked up by."""
    return F.struct(F.xxhash64(block).alias("a"), F.xxhash64(F.lit(1), block).alias("b"))


def _numbered(rows: DataFrame, what: list[str], keep: list[Column]) -> DataFrame:
    """The columns keep of the distinct `what`, sorted, and their numbers as name. A written table: numbers stay as they
    are, and the rows of a hot group can be split over tasks when they are joined with it."""
    return materialize(rows.select(*what).distinct().sortWithinPartitions(*what).select(*keep, F.monotonically_increasing_id().alias("name")), "names")


def block_names(docs: DataFrame, block_chars: int = BLOCK_CHARS, handle: Callable[[Column], Column] = _handle) -> tuple[DataFrame, DataFrame]:
    """For docs (doc_id, text): the rows (row, doc_id, text_sha256, keys), a row each, and their names (row, n_blocks,
    name). Equal (n_blocks, name) means equal texts. handle: of blocks; any function of their text gives right names."""
    cut = F.when(F.length("text") == 0, F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    )
    # Most texts are one block, which needs no cutting.
    cut = docs.select("doc_id", "text", F.when(F.octet_length("text") <= block_chars, F.array("text")).otherwise(cut).alias("cut"))

    def rows_by(key: Callable[[Column], Column]) -> DataFrame:
        return materialize(
            cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform("cut", key).alias("keys")), "rows"
        )

    blocks = cut.select(F.explode("cut").alias("block"))
    names = _numbered(blocks, ["block"], [handle(F.col("block")).alias("key")])
    if names.groupBy("key").count().where("count > 1").isEmpty():
        rows = rows_by(handle)
    else:
        rows, names = rows_by(lambda block: block), _numbered(blocks, ["block"], [F.col("block").alias("key")])
    places = rows.select("row", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("at", "key"))
    named = materialize(places.join(names, "key").select("row", "n_blocks", "at", "name"), "block-names")
    done = named.where("n_blocks = 1").drop("at")
    left = named.agg(F.max("n_blocks")).first()[0] or 1
    named = named.where("n_blocks > 1")
    while left > 1:
        half = F.col("at") % 2
        pairs = (
            named.groupBy("row", "n_blocks", (F.col("at") / 2).cast("int").alias("at"))
            .agg(F.max(F.when(half == 0, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("second"))
        )
        pairs = materialize(pairs, "block-pairs")
        both = ["first", "second"]
        named = materialize(pairs.join(_numbered(pairs, both, [F.col(x) for x in both]), both).select("row", "n_blocks", "at", "name"), "pair-names")
        left = (left + 1) // 2
    return rows, done.unionByName(named.drop("at"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, handle: Callable[[Column], Column] = _handle) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and empty
    texts equal each other. The row with the largest doc_id stays. Rows repeated in full count
    towards group_size, and all rows with the largest doc_id are marked kept. A null doc_id stays
    only in a group without any other. Columns of docs besides the two are not read. An empty table
    gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    rows, names = block_names(texts, block_chars, handle)
    named = materialize(rows.drop("keys").join(names, "row").drop("row"), "identities")
    key = ["n_blocks", "name"]
    groups = materialize(named.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, key).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of equal texts, that with the largest doc_id.

    Null counts as empty. Rows that share a doc_id, or have none (which comes before all others), are told apart by the
    order of their texts' hashes; of rows repeated in full one stays. All columns are kept, whatever their names. An empty
    table gives an empty result.
    """
    rows = keyed(docs)
    dropped = exact_dedup(rows, id_col=KEY).where("not kept").select(F.col("doc_id").alias(KEY))
    return rows.join(dropped, KEY, "left_anti").select(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
