"""Numbers without gaps inside groups of any size, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialise

#: Bits that monotonically_increasing_id leaves to the row within its partition.
ROW_BITS = 33


def number_within(rows: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """``rows`` and ``out``: 0, 1, 2, ... inside each group, by ``order`` (nulls first).

    Rows are written once, so that neither the sampling of the ranges nor the sort computes them again, then dealt by
    ranges of (group, order), sorted, and written with their place. Inside a range a row's number
    is its place less the place of its group's first row there; the rows of the same group in earlier ranges are
    added, of which there is one count per group and range. A group that holds most rows spans many ranges, and
    rows that are equal in ``order`` are told apart by where they were read, so equal rows spread too.
    """
    spread = materialise(rows.withColumn("_read", F.monotonically_increasing_id()), "rows-to-number")
    placed = spread.repartitionByRange(*groups, *order, "_read").sortWithinPartitions(*groups, *order, "_read")
    placed = materialise(placed.drop("_read").withColumn("_place", F.monotonically_increasing_id()), "placed-rows")
    part = F.shiftright("_place", ROW_BITS)
    counts = placed.groupBy(*groups, part.alias("_part")).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    earlier = F.sum("_rows").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_shift", F.coalesce(earlier, F.lit(0)) - F.col("_first"))
    offsets = materialise(offsets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), "_shift"), "offsets")
    same: Column = part == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    numbered = placed.join(offsets, same)
    return numbered.withColumn(out, F.col("_place") + F.col("_shift")).select(*rows.columns, out)
