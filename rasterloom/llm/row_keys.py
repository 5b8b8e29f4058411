"""Keys that tell rows apart and keep the order of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

KEY = "_row_key"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a distinct long KEY, in the order of id_col.

    The key is id_col itself where that is distinct and never null. Else rows are sorted over all partitions by id_col
    (null first), the hash of their text and numbered; the result is then a written table, as numbers must not change.
    """
    shared = docs.groupBy(F.col(id_col)).count().where((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty()
    if shared:
        return docs.withColumn(KEY, F.col(id_col).cast("long"))
    order = [F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = docs.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(sorted_rows.withColumn(KEY, F.monotonically_increasing_id()), "keyed")
