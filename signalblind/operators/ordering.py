"""Order-dependent operators that never put a whole group into one task.

A group (capture, experiment, ...) may hold a third of all rows, so the usual
``Window.partitionBy(group).orderBy(...)`` would run it in one task. Here every
group is cut into buckets that follow the order; windows run inside a bucket and
only one summary row per bucket crosses bucket borders.
"""

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, shuffle_partitions


def _running(df, by, order, bucket, inner, outer, combine):
    keyed = df.withColumn("_bucket", bucket)
    per_bucket = keyed.groupBy(*by, "_bucket").agg(outer.alias("_part"))
    across = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    before = per_bucket.withColumn("_before", combine(F.col("_part")).over(across)).drop("_part")
    return (
        keyed.withColumn("_inner", inner.over(within))
        .join(before, [*by, "_bucket"])
    )


def running_count(df: DataFrame, by: list, order: list, bucket: Column, name="rank") -> DataFrame:
    """1-based position inside each group. ``bucket`` must not fall along ``order``."""
    out = _running(df, by, order, bucket, F.row_number(), F.count(F.lit(1)), F.sum)
    total = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_inner")
    return out.withColumn(name, total.cast("long")).drop("_bucket", "_before", "_inner")


def running_sum(df, by, order, bucket, value: str, name) -> DataFrame:
    """Sum of ``value`` up to and including each row."""
    out = _running(df, by, order, bucket, F.sum(value), F.sum(value), F.sum)
    return out.withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_inner")).drop(
        "_bucket", "_before", "_inner")


def running_min(df, by, order, bucket, value: str, name) -> DataFrame:
    """Minimum of ``value`` up to and including each row."""
    out = _running(df, by, order, bucket, F.min(value), F.min(value), F.min)
    return out.withColumn(name, F.least(F.col("_before"), F.col("_inner"))).drop("_bucket", "_before", "_inner")


def global_rank(df: DataFrame, order: list, name="rank") -> DataFrame:
    """1-based position of every row in the whole table, without a window over all of it.

    Rows are dealt by sampled borders of ``order`` (columns that tell all rows apart, so a
    value with many rows is split like any other) and sorted in each range. The first pass
    writes them with their place in the range, the second adds the sizes of the ranges
    before, of which there are as many as shuffle partitions. Pass keys only and join wide
    columns afterwards. An empty table gives no rows.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # The id holds the range in its upper 31 bits and the place in the lower 33.
    placed = cut(dealt.withColumn("_place", F.monotonically_increasing_id()))
    of = F.shiftright("_place", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(of).count().collect())
    ahead = list(itertools.accumulate((n for _, n in sizes), initial=0))
    before = spark.createDataFrame([(k, a) for (k, _), a in zip(sizes, ahead)], "_range bigint, _ahead bigint")
    at = F.col("_ahead") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_range", of).join(F.broadcast(before), "_range").select(*df.columns, at.alias(name))


def with_previous(df: DataFrame, by: list, order: list, bucket: Column, cols: list, prefix="prev_") -> DataFrame:
    """Columns of the previous row of each group.

    The last row of every bucket is carried over to the next non-empty bucket.
    """
    keyed = df.withColumn("_bucket", bucket)
    packed = F.struct(*cols)
    tails = keyed.groupBy(*by, "_bucket").agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carried = tails.withColumn(
        "_carry", F.lag("_tail").over(Window.partitionBy(*by).orderBy("_bucket"))).drop("_tail")
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    out = keyed.withColumn("_inner", F.lag(packed).over(within)).join(carried, [*by, "_bucket"])
    previous = F.coalesce(F.col("_inner"), F.col("_carry"))
    return out.select(*df.columns, *[previous[c].alias(prefix + c) for c in cols])


def top_per_group(df: DataFrame, by: list, order: list, k: int, name="rank", spread=None) -> DataFrame:
    """K2: first ``k`` rows of each group.

    ``spread`` columns split a group first, so a hot group is cut down to k rows in
    many tasks before its survivors meet.
    """
    if spread:
        local = Window.partitionBy(*by, *spread).orderBy(*order)
        df = df.withColumn("_local", F.row_number().over(local)).filter(F.col("_local") <= k).drop("_local")
    final = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(final).cast("long")).filter(F.col(name) <= k)


def hash_spread(*cols, parts=64) -> Column:
    """A salt that depends on the row only, so a rerun places rows alike."""
    return F.pmod(F.xxhash64(*cols), F.lit(parts))


def attach_totals(df: DataFrame, totals: DataFrame, by: list) -> DataFrame:
    """Group totals on every row: a join on ``by``, or a scalar subquery for one total row."""
    if by:
        return df.join(totals, list(by))
    one = totals.select(F.struct(*totals.columns)).scalar()
    return df.withColumn("_one", one).select(*df.columns, "_one.*")
