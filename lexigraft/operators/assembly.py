"""Putting the branches of a target matrix together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.functions.vectors import zeros
from lexigraft.operators.lookup import ZERO
from lexigraft.session import per_name


def zero_rows(present: DataFrame, sizes: dict[str, int], shapes: DataFrame) -> DataFrame:
    """Rows for ids of ``0 … size-1`` without a token, filled with zeros.

    ``present`` holds ``(pair_id, source, id)``, ``shapes`` one row
    ``(source, matrix, dim)`` per matrix.
    """
    spark = present.sparkSession
    spine = spark.createDataFrame(list(sizes.items()), "pair_id string, size bigint").select(
        "pair_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)).alias("id")
    )
    sources = present.select("pair_id", "source").distinct()
    return (
        spine.join(present.select("pair_id", "id"), ["pair_id", "id"], "left_anti")
        .join(per_name(sources), "pair_id")
        .join(per_name(shapes), "source")
        .select(
            "pair_id",
            "matrix",
            "id",
            F.lit(None).cast("string").alias("token"),
            F.lit(ZERO).alias("outcome"),
            zeros(F.col("dim")).alias("vector"),
        )
    )


def union_branches(*branches: DataFrame) -> DataFrame:
    """Union of disjoint branches with vectors as ARRAY<FLOAT>."""
    columns = ["pair_id", "matrix", "id", "token", "outcome"]
    shaped = [b.select(*columns, F.col("vector").cast("array<float>").alias("vector")) for b in branches]
    out = shaped[0]
    for b in shaped[1:]:
        out = out.unionByName(b)
    return out
