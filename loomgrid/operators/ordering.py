"""Places and running sums over a whole table, in any number of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.sources.tables import stored


def prefix_sums(rows: DataFrame, by: list[Column], value: str | None = None, part_rows: int = 200_000) -> DataFrame:
    """Add place, the number of each row from 1 in the order of `by`, and with `value` running, its sum down to the row.

    Rows are dealt into ranges of the whole order, so the rows of one value are parted too if `by` tells them apart, into as many
    ranges as the table needs. Each range is numbered and summed alone, and what the ranges before it hold, one row a range, is added.
    """
    known = stored(rows, "rows")
    parts = max(1, -(-known.count() // part_rows))
    dealt = stored(known.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "dealt")
    held = F.sum(value) if value else F.lit(0.0)
    totals = dealt.groupBy("_part").agg(held.alias("_s"), F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = totals.select("_part", F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias("_before"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_rows"))
    inner = Window.partitionBy("_part").orderBy("_row")
    out = dealt.join(F.broadcast(before), "_part").withColumn("place", F.row_number().over(inner) + F.col("_rows"))
    if value:
        out = out.withColumn("running", F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"))
    return out.drop("_part", "_row", "_before", "_rows")
