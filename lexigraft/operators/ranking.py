"""Row numbers and top-n that stay bounded when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraft.functions.salting import salt_of
from lexigraft.session import DEFAULT_LIMITS, Limits, materialize


def top_n(
    df: DataFrame, part: list[str], order: list[Column], n: int, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """The first ``n`` rows of every group.

    A group is first cut into salted slices, each keeping its own first ``n``;
    the last step sees at most ``n * salts`` rows per group however large it is.
    """
    if n > limits.window_rows // limits.salts:
        return number_rows(df, part, order, "_rn", limits, small=False).where(F.col("_rn") < n).drop("_rn")
    salted = df.withColumn("_salt", salt_of(df.columns, limits.salts))
    slices = Window.partitionBy(*part, "_salt").orderBy(*order)
    groups = Window.partitionBy(*part).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(slices))
        .where(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(groups))
        .where(F.col("_rn") <= n)
        .drop("_rn", "_salt")
    )


def number_rows(
    df: DataFrame,
    part: list[str],
    order: list[Column],
    name: str,
    limits: Limits = DEFAULT_LIMITS,
    small: bool | None = None,
) -> DataFrame:
    """Dense 0-based position of every row inside its group.

    ``small`` says that the caller knows the groups to be at most
    ``limits.window_rows`` rows, ``None`` that this has to be counted; then one
    window per group is enough. Otherwise the rows are range-partitioned over (group, order), so a hot group is spread
    over many tasks, and the positions are the local ones plus the number of
    group rows in earlier ranges.
    """
    if small is None:
        small = df.count() <= limits.window_rows
    if small:
        w = Window.partitionBy(*part).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))

    keys = [F.col(c) for c in part] + list(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id holds the partition number above 33 bits and the row position below;
    # the written table fixes both.
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn(
        "_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # One row per (group, range): at most groups + ranges rows.
    per_range = placed.groupBy(*part, "_range").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *part, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(offsets, [*part, "_range"])
        .withColumn(name, F.col("_offset") + F.col("_pos") - F.col("_first"))
        .drop("_at", "_range", "_pos", "_first", "_offset")
    )
