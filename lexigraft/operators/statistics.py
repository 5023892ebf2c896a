"""Per-dimension statistics of embedding matrices and seeded random vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.functions.hashing import normal_draw
from lexigraft.session import materialize, per_name


def dimension_stats(embeddings: DataFrame) -> DataFrame:
    """``(vocab, matrix, pos, n, mean, std)`` over all rows of every matrix.

    ``std`` is the sample standard deviation. A first pass finds the range of each
    dimension; values are then centred in it and counted in steps of 2^-37 of it.
    The sums of steps are exact integers, so the bits depend neither on the
    order of rows nor on how large or small the values are. Beyond 16 million rows
    of a matrix the sums could leave 64 bits, which is an error.
    """
    keys = ["vocab", "matrix", "pos"]
    cells = embeddings.select("vocab", "matrix", F.posexplode("vector").alias("pos", "x"))
    cells = cells.select(*keys, F.col("x").cast("double").alias("x"))
    ranges = cells.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.col("hi") - F.col("lo")
    step = F.when(width > 0, F.pow(F.lit(2.0), F.floor(F.log2(width)) - 37)).otherwise(1.0)
    # One row per matrix and dimension; read twice by the join.
    ranges = materialize(ranges.select(*keys, (F.col("lo") + width / 2).alias("centre"), step.alias("step")), "ranges")
    u = F.rint((F.col("x") - F.col("centre")) / F.col("step")).cast("bigint")
    high, low = F.shiftright("u", 19), F.col("u").bitwiseAND(F.lit((1 << 19) - 1))
    sums = (
        cells.join(per_name(ranges), keys)
        .withColumn("u", u)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.first("centre").alias("centre"),
            F.first("step").alias("step"),
            F.sum("u").cast("double").alias("s1"),
            # The square of high * 2^19 + low has up to 76 bits: its parts are summed apart.
            F.sum(high * high).cast("double").alias("high"),
            F.sum(high * low).cast("double").alias("mixed"),
            F.sum(low * low).cast("double").alias("low"),
        )
    )
    n, s1, size = F.col("n").cast("double"), F.col("s1"), F.col("step")
    spread = F.greatest(F.lit(0.0), F.col("high") * float(1 << 38) + F.col("mixed") * float(1 << 20) + F.col("low") - s1 * s1 / n)
    return sums.select(
        *keys,
        "n",
        (F.col("centre") + s1 / n * size).alias("mean"),
        F.when(n > 1, F.sqrt(spread / (n - 1)) * size).alias("std"),
    )


def packed_stats(stats: DataFrame) -> DataFrame:
    """One row per matrix: ``(vocab, matrix, mean ARRAY, std ARRAY)``."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))
    return (
        stats.groupBy("vocab", "matrix")
        .agg(rows.alias("d"))
        .select("vocab", "matrix", F.col("d.mean").alias("mean"), F.col("d.std").alias("std"))
    )


def random_vectors(tokens: DataFrame, stats: DataFrame, seed: int = 42) -> DataFrame:
    """Draws from N(mean, std) for ``tokens(source, id, …)``, one row per matrix.

    A draw is keyed by (seed, id, dimension): it does not depend on the order or
    the partitioning of the tokens.
    """
    packed = packed_stats(stats).withColumnRenamed("vocab", "source")
    drawn = F.transform(
        F.sequence(F.lit(0), F.size("mean") - 1),
        lambda d: F.get("mean", d) + F.get("std", d) * normal_draw(seed, F.col("id"), d),
    )
    missing = F.raise_error(F.concat(F.lit("no source matrix of "), F.col("source")))
    found = tokens.join(per_name(packed), "source", "left")
    vector = F.when(F.col("mean").isNull(), missing.cast("array<double>")).otherwise(drawn)
    return found.withColumn("vector", vector).drop("mean", "std")
