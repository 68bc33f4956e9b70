"""Dense row numbers over a whole table, without a window over all of it.

Rows are dealt to partitions by ranges of the order columns, so a key that
holds a third of them is many partitions, and numbered inside each partition.
What lies before a partition is the sum of the sizes of the partitions before
it (one row a partition). Numbers in such an order replace ``row_number`` windows
over hot keys: a row's place among its key's is its number less its key's
smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_ROW_BITS = 33          # of a monotonically increasing id


def numbered(df: DataFrame, *by, name: str = "_n") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in the order of ``by``. Rows are stored
    before they are numbered, so reading them again numbers them alike."""
    laid = (df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    rows = cut_lineage(laid)
    part = F.shiftright("_id", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))      # one row a partition
    offsets = sizes.select("_part", before.alias("_before"))
    return (rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
                .withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_part", "_id", "_before"))


def by_key(rows: DataFrame, key: str, name: str = "_n") -> DataFrame:
    """Numbered rows with ``_pos``, their place in their key (from 0), and ``_size``,
    the key's number of rows. Needs an order that begins with the key."""
    keys = rows.groupBy(F.col(key).alias("_key")).agg(F.min(name).alias("_first"), F.count(F.lit(1)).alias("_size"))
    return (rows.join(keys, F.col(key).eqNullSafe(F.col("_key")))
                .withColumn("_pos", F.col(name) - F.col("_first")).drop("_key", "_first"))
