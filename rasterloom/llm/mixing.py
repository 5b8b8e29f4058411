"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source has the same expected number of copies (its source's target over the
source's size). Documents are put in an order, the expected copies are summed along it, one offset
per source is added, and a document is emitted once for each integer boundary that its step of the
sum crosses. In the order, documents of like size stand together, so the words taken come near the
target as well as the copies do.

Scale: the running sum isn't one window over a source. The order is (size class, block, size,
doc_id), with about sqrt(rows) blocks dealt by a hash of doc_id and text; places are counted within a cell,
cells within a class, and classes within a source, so no window holds more than about sqrt(rows) rows,
also where one source, one size or rows without a doc_id have a third of all. (Rows that are equal in source,
doc_id and text share a cell.) Sources are numbered by sorted partitions, and the level of their targets is
found by sums over them, so they may be many too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .row_keys import KEY, keyed
from .shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # copies of a document, and a source's target in its own sizes


def _cells(sizes: DataFrame, blocks: int) -> DataFrame:
    bits = F.length(F.bin("size"))
    return sizes.withColumn("class", bits * 4 + F.expr("cast(shiftright(size, greatest(length(bin(size)) - 3, 0)) & 3 as int)")).withColumn("block", F.col("dealt") % blocks)


def _before(total: Column, keys: list[str], order: str) -> Column:
    """The sum of total over what comes earlier."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(w), F.lit(0))


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds number (from 0) by code point of source, null last: the place in its sorted partition, and what stands in those
    before; the only window has a row a partition."""
    order, n = F.col("source").asc_nulls_last(), int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(sources.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "sources")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first")).select("_part", "_first", before.alias("_before"))
    return rows.join(parts, "_part").withColumn("number", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def source_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size). By code point, null last, sources weigh 1, 2, 3, 1, ...; the
    targets share all sizes by weight, none above `most` times its source's size."""
    ranked = _numbered(sources).withColumn("weight", F.col("number") % 3 + 1).withColumn("cap", most * F.col("source_size"))
    ranked = materialize(ranked.withColumn("ratio", F.col("cap") / F.col("weight")).drop("number"), "ranked")
    size, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    capped, level = (0, 0), 0.0
    while weight:
        # What the capped sources leave, by weight of the others; this caps some more, until none is above.
        level = (size - capped[0]) / (weight - capped[1])
        now = ranked.where(F.col("ratio") < level).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if tuple(now) == capped:
            break
        capped = tuple(now)
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))).select(
        "source", "source_size", "weight", "target"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    A size is the text's number of words (null: 0). The offset is drawn from the source's name, so
    reruns agree. Repeated rows are sampled each on its own; a null source is a source of its own,
    the last; a null doc_id is a document like any other. A source without words has target 0 and no
    copies. Further columns are not read. An empty table gives an empty result.
    """
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws(" ", F.col(id_col).cast("string"), F.col(text_col))), 1, 8), 16, 10).cast("long").alias("dealt"),
    )
    sizes = materialize(sizes, "sizes")
    blocks = max(1, math.ceil(math.sqrt(sizes.count())))
    keyed = _cells(sizes, blocks).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))

    cells = keyed.groupBy("key", "class", "block").agg(F.count("*").alias("n"))
    classes = cells.groupBy("key", "class").agg(F.sum("n").alias("n"))
    classes = classes.select("key", "class", _before(F.col("n"), ["key"], "class").alias("before_class"))
    cells = cells.withColumn("before_cell", _before(F.col("n"), ["key", "class"], "block")).drop("n")
    targets = source_targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    targets = targets.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size")))
        .otherwise(F.lit(0.0))
        .alias("rate"),
        (F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0).alias("offset"),
    )
    cells = cells.join(classes, ["key", "class"]).join(targets, "key")

    at = Window.partitionBy("key", "class", "block").orderBy("size", "doc_id", "dealt")
    placed = keyed.withColumn("place", F.row_number().over(at)).join(cells, ["key", "class", "block"])
    place = F.col("before_class") + F.col("before_cell") + F.col("place")
    copies = F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))
    return placed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The documents of the mix, each as often as taken, with the columns of docs, whatever their names.

    A null text has size 0; null sources and doc_ids, repeated rows and ties as in mix. An empty table gives an empty result.
    """
    rows = keyed(docs)
    copies = mix(rows, id_col=KEY, most=most).where("copies > 0").select(F.col("doc_id").alias(KEY), F.col("copies").alias("_copies"))
    return rows.join(copies, KEY).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(' ', doc_id, text)), 1, 8))::UBIGINT AS dealt
  FROM documents
), b AS (SELECT greatest(1, ceil(sqrt(count(*))))::BIGINT AS blocks FROM sizes
), placed AS (
  SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY
      length(bin(size)) * 4 + ((size >> greatest(length(bin(size)) - 3, 0)) & 3),
      dealt % blocks, size, doc_id NULLS FIRST, dealt) AS place
  FROM sizes s, b
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM src
), r AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER e, 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0))::DOUBLE AS level
  FROM r WINDOW e AS (ORDER BY ratio, weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE,
      (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight) AS target,
    ('0x' || substr(md5(coalesce('s' || source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS off
  FROM l
), rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0, target / source_size) ELSE 0.0 END::DOUBLE AS rate FROM t)
SELECT p.doc_id, p.size, q.source_size, q.target,
  (p.size * (floor(p.place * q.rate + q.off) - floor((p.place - 1) * q.rate + q.off)))::BIGINT AS taken
FROM placed p JOIN rates q ON p.source IS NOT DISTINCT FROM q.source
"""
