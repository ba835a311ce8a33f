"""Exact ranks inside groups from hierarchical histograms of key digits, without a sort of all rows.

Keys are longs, compared one after the other as unsigned numbers. The leading bits that all first keys share are
skipped; what is left is cut into digits of ``DIGIT_BITS`` bits. Rows are counted by group and prefix at the depth
where a prefix holds at most ``BUCKET`` rows on average, and these counts are rolled up digit by digit: a prefix ranks
after its parent's base and its smaller siblings, of which there are at most ``2 ** DIGIT_BITS``. Rows of a prefix that
holds more than ``BUCKET`` rows go down further digits, of the next keys in the end; the others are ordered inside
their prefix. So no task gets more than ``BUCKET`` rows of a group, wherever the ids lie and however many repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialise

DIGIT_BITS, BUCKET = 8, 4096
_SIGN = -(1 << 63)


def unsigned_order(key: Column) -> Column:
    """A long whose unsigned order is the signed order of ``key``."""
    return key.bitwiseXOR(F.lit(_SIGN))


def _based(counts: DataFrame, depth: int) -> DataFrame:
    """From (g, prefix, n) at ``depth`` digits: and ``base``, the rows of the group in smaller prefixes."""
    if depth <= 1:
        smaller = Window.partitionBy("g").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("base", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    own = counts.withColumn("up", F.shiftrightunsigned("prefix", DIGIT_BITS))
    parents = _based(own.groupBy("g", F.col("up").alias("prefix")).agg(F.sum("n").alias("n")), depth - 1)
    smaller = Window.partitionBy("g", "up").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("before", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    above = parents.select(F.col("g").alias("pg"), F.col("prefix").alias("pp"), F.col("base").alias("parent"))
    return placed.join(above, (F.col("g") == F.col("pg")) & (F.col("up") == F.col("pp"))).select("g", "prefix", "n", (F.col("parent") + F.col("before")).alias("base"))


def _settled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of rows with (g, base) that share them with few others."""
    inside = Window.partitionBy("g", "base").orderBy(*keys)
    return rows.withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).drop("base", "n", "prefix")


def ranks(rows: DataFrame, group: str, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """``rows``, which are a scan of a written table, and ``rank``: 0, 1, ... inside each ``group`` by ``keys``.

    ``group`` is a string that isn't null; ``keys`` are longs without nulls in ``unsigned_order``, the last of which
    tells all rows of a group apart.
    """
    kept = rows.columns
    signed = [F.col(k).bitwiseXOR(F.lit(_SIGN)) for k in keys]  # which Spark can order
    named = rows.withColumn("g", F.col(group)).withColumns({f"k{i}": x for i, x in enumerate(signed)})
    order = [f"k{i}" for i in range(len(keys))]
    low, high, n = rows.select(signed[0].alias("k")).agg(F.min("k"), F.max("k"), F.count("*")).first()
    if not n:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    mask = (1 << 64) - 1
    width = (((low ^ _SIGN) & mask) ^ ((high ^ _SIGN) & mask)).bit_length()
    depth = 1
    while n > bucket << (DIGIT_BITS * depth) and DIGIT_BITS * (depth + 1) <= 56:
        depth += 1
    used = min(width, DIGIT_BITS * depth)
    top = F.shiftrightunsigned(F.col(keys[0]), width - used) if width - used < 64 else F.lit(0)
    first = F.lit((1 << used) - 1)
    state = named.withColumn("prefix", top.bitwiseAND(first) if used < 64 else top)
    counts = materialise(_based(state.groupBy("g", "prefix").agg(F.count("*").alias("n")), depth), "digit-counts")
    # Ranks within a prefix need its rows together, and so does the join: one shuffle serves both.
    joined = state.join(counts, ["g", "prefix"])
    small = joined.where(F.col("n") <= bucket)
    inside = Window.partitionBy("g", "prefix").orderBy(*order)
    done = small.withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).select(*kept, "rank")
    if not counts.where(F.col("n") > bucket).limit(1).count():
        return done
    left = [(keys[0], width - used)] + [(k, 64) for k in keys[1:]]  # bits of each key not looked at yet
    open_rows = joined.where(F.col("n") > bucket)
    for key, bits in left:
        while bits:
            step = min(DIGIT_BITS, bits)
            bits -= step
            open_rows = materialise(open_rows.select(*kept, "g", *order, "base"), "open-ranks")
            state = open_rows.withColumn("prefix", F.shiftrightunsigned(F.col(key), bits).bitwiseAND(F.lit((1 << step) - 1)))
            smaller = Window.partitionBy("g", "base").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
            counts = state.groupBy("g", "base", "prefix").agg(F.count("*").alias("n"))
            counts = materialise(counts.withColumn("next", F.col("base") + F.coalesce(F.sum("n").over(smaller), F.lit(0))), "digit-counts")
            joined = state.join(counts, ["g", "base", "prefix"]).drop("base").withColumnRenamed("next", "base")
            done = done.union(_settled(joined.where(F.col("n") <= bucket), order).select(*kept, "rank"))
            open_rows = joined.where(F.col("n") > bucket)
            if not counts.where(F.col("n") > bucket).limit(1).count():
                return done
    raise ValueError("the last key doesn't tell all rows apart")
