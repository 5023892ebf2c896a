"""Reports and data-quality checks of a transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraft.functions.vectors import l1_norm
from lexigraft.operators.lookup import COPIED, RANDOM


def init_report(annotated: DataFrame) -> DataFrame:
    """``(pair_id, outcome, n, n_pruned)``: counts per pair and outcome.

    ``n_pruned`` counts overlapping tokens that give no weight to others. The
    tokens themselves are rows of ``annotated``; see also :func:`random_tokens`.
    """
    return annotated.groupBy("pair_id", "outcome").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("outcome") == COPIED) & ~F.col("use_for_init")).alias("n_pruned"),
    )


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(n_rows, n_differing)`` of two results of a transfer."""
    keys = ["pair_id", "matrix", "id"]
    left = a.select(*keys, F.struct("outcome", "vector").alias("l"))
    right = b.select(*keys, F.struct("outcome", "vector").alias("r"))
    return left.join(right, keys, "full_outer").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("n_differing")
    )


def _against_source(rows: DataFrame, embeddings: DataFrame, group: list[str]) -> DataFrame:
    """Counts rows ``(source, matrix, src_id, vector)`` that differ from the source row or have no vector."""
    source = embeddings.select(
        F.col("vocab").alias("source"), "matrix", F.col("id").alias("src_id"), F.col("vector").alias("src_vector")
    )
    differs: Column = F.col("vector").isNull() | ~F.col("vector").eqNullSafe(F.col("src_vector"))
    return (
        rows.join(source, ["source", "matrix", "src_id"], "left")
        .groupBy(*group)
        .agg(F.count("*").alias("n"), F.count_if(differs).alias("n_differing"))
    )


def specials_kept(result: DataFrame, source_vocab: DataFrame, embeddings: DataFrame, pairs: DataFrame, tokens: list[str]) -> DataFrame:
    """Special tokens whose vector is not the one of the same source token."""
    ids = source_vocab.select(F.col("vocab").alias("source"), "token", F.col("id").alias("src_id"))
    # From the tokens that must be there, so that lost ones are counted.
    matrices = embeddings.select(F.col("vocab").alias("source"), "matrix").distinct()
    expected = ids.where(F.col("token").isin(tokens)).join(pairs, "source").join(matrices, "source")
    found = result.select("pair_id", "matrix", "token", "vector")
    rows = expected.join(found, ["pair_id", "matrix", "token"], "left")
    return _against_source(rows, embeddings, ["pair_id"])


def nonzero_rows(result: DataFrame) -> DataFrame:
    """``(pair_id, n, n_zero)``: rows without any non-zero entry."""
    return result.groupBy("pair_id").agg(
        F.count("*").alias("n"), F.count_if(l1_norm(F.col("vector")) == 0).alias("n_zero")
    )


def overlap_copied(result: DataFrame, annotated: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Overlapping tokens whose row is not the row of their first source token."""
    overlap = annotated.where(F.col("match_kind").isNotNull()).select("pair_id", "source", "id", "src_id")
    matrices = embeddings.select(F.col("vocab").alias("source"), "matrix").distinct()
    expected = overlap.join(matrices, "source")
    rows = expected.join(result.select("pair_id", "matrix", "id", "vector"), ["pair_id", "matrix", "id"], "left")
    return _against_source(rows, embeddings, ["pair_id"])


def extension_preserves(
    result: DataFrame, source_vocab: DataFrame, embeddings: DataFrame, pairs: DataFrame
) -> DataFrame:
    """Source tokens that an extended vocabulary lost or gave another vector."""
    wanted = (
        source_vocab.select(F.col("vocab").alias("source"), "token", F.col("id").alias("src_id"))
        .join(pairs, "source")
        .join(embeddings.select(F.col("vocab").alias("source"), "matrix").distinct(), "source")
    )
    rows = wanted.join(result.select("pair_id", "matrix", "token", "vector"), ["pair_id", "matrix", "token"], "left")
    return _against_source(rows, embeddings, ["pair_id"])


def convex_weights(weights: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``(pair_id, n, n_bad)``: new tokens whose weights are not positive or do not
    sum to one."""
    per_token = weights.groupBy("pair_id", "id").agg(F.sum("w").alias("s"), F.min("w").alias("lowest"))
    bad = (F.abs(F.col("s") - 1) > tolerance) | (F.col("lowest") <= 0)
    return per_token.groupBy("pair_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))


def random_tokens(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.col("outcome") == RANDOM)
