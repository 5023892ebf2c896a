"""Cosine similarities of new tokens to overlapping tokens, and sparsemax.

The similarity matrix is never laid out as rows. New and overlapping tokens are
dealt into groups of bounded size; one task multiplies one group by one other
and hands on only what the following step can still need:

* sparsemax: the support within the group. Adding columns can only raise the
  threshold, so a column outside the support of its group is outside the support
  of the row, and sparsemax over the union of the group supports is exact.
* top-k: the columns at or above the k-th best of the group.
* summary: count, sum, minimum, maximum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraft.operators.lookup import WEIGHTED
from lexigraft.session import DEFAULT_LIMITS, Limits, per_name

# Rows of a group multiplied at a time.
CHUNK_ROWS = 512
# Columns sorted per row before the full row is looked at.
SORTED_COLUMNS = 64

NEIGHBOUR_SCHEMA = "pair_id string, source string, id bigint, token string, nbr_id bigint, src_id bigint, z double"


def support_mask(z: np.ndarray) -> np.ndarray:
    """Which entries of every row sparsemax gives weight to.

    The best ``SORTED_COLUMNS`` decide a row if its support is smaller than
    that; the other rows are sorted in full.
    """
    rows, cols = z.shape
    taken = min(SORTED_COLUMNS, cols)
    best = -np.sort(np.partition(-z, taken - 1, axis=1)[:, :taken], axis=1)
    size, threshold = _thresholds(best)
    if taken < cols:
        open_rows = np.flatnonzero(size == taken)
        if len(open_rows):
            threshold[open_rows] = _thresholds(-np.sort(-z[open_rows], axis=1))[1]
    # A hair below the threshold, so that rounding cannot drop a column the
    # final step would keep.
    return z > threshold[:, None] - 1e-12


def _thresholds(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, best.shape[1] + 1)
    total = np.cumsum(best, axis=1)
    size = np.count_nonzero(1 + k * best > total, axis=1)
    at = np.arange(len(best))
    return size, (total[at, size - 1] - 1) / size


def top_mask(k: int) -> Callable[[np.ndarray], np.ndarray]:
    def mask(z: np.ndarray) -> np.ndarray:
        taken = min(k, z.shape[1])
        kth = -np.partition(-z, taken - 1, axis=1)[:, taken - 1]
        return z >= kth[:, None]

    return mask


def _unit_rows(table: pa.Table, column: str) -> np.ndarray:
    flat = np.asarray(table.column(column).combine_chunks().flatten(), dtype=np.float64)
    rows = flat.reshape(table.num_rows, -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_id(table: pa.Table, key: str) -> pa.Table:
    return table.sort_by(key) if table.num_rows else table


def _deal(annotated: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """New and overlapping tokens, each with the cell (new group, neighbour group)
    it is needed in. Group counts follow from the token counts of the pair."""
    is_new = F.col("outcome") == WEIGHTED
    is_neighbour = F.col("use_for_init")

    def groups(n: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / limits.cell_rows)).cast("int")

    counts = annotated.groupBy("pair_id").agg(
        F.count_if(is_new).alias("n_new"), F.count_if(is_neighbour).alias("n_nbr")
    )
    no_neighbour = F.raise_error(
        F.concat(F.lit("no overlapping token with an auxiliary vector for "), F.col("pair_id"))
    ).cast("int")
    grid = counts.select(
        "pair_id",
        groups(F.col("n_new")).alias("g_new"),
        F.when((F.col("n_new") > 0) & (F.col("n_nbr") == 0), no_neighbour)
        .otherwise(groups(F.col("n_nbr")))
        .alias("g_nbr"),
    )

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    new = (
        annotated.where(is_new)
        .select("pair_id", "source", "id", "token", "aux")
        .join(per_name(grid), "pair_id")
        .withColumn("gi", F.pmod(F.xxhash64("id"), F.col("g_new")).cast("int"))
        .withColumn("gj", all_of("g_nbr"))
        .drop("g_new", "g_nbr")
    )
    # Aliases keep the columns of the two sides apart: both stem from one table.
    neighbours = (
        annotated.where(is_neighbour)
        .select(F.col("pair_id").alias("pair"), F.col("id").alias("nbr_id"), F.col("src_id").alias("src_id"), F.col("aux").alias("nbr_aux"))
        .join(per_name(grid.withColumnRenamed("pair_id", "pair")), "pair")
        .withColumn("gj", F.pmod(F.xxhash64("nbr_id"), F.col("g_nbr")).cast("int"))
        .withColumn("gi", all_of("g_new"))
        .drop("g_new", "g_nbr")
    )
    return new, neighbours


def _cells(annotated: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, limits: Limits):
    new, neighbours = _deal(annotated, limits)
    right = neighbours.groupBy("pair", "gi", "gj")
    return new.groupBy("pair_id", "gi", "gj").cogroup(right).applyInArrow(work, schema)


def _selected(mask: Callable[[np.ndarray], np.ndarray]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(new: pa.Table, neighbours: pa.Table) -> pa.Table:
        new, neighbours = _by_id(new, "id"), _by_id(neighbours, "nbr_id")
        rows, cols, values = [], [], []
        if new.num_rows and neighbours.num_rows:
            a, b = _unit_rows(new, "aux"), _unit_rows(neighbours, "nbr_aux").T
            for start in range(0, len(a), CHUNK_ROWS):
                z = a[start : start + CHUNK_ROWS] @ b
                r, c = np.nonzero(mask(z))
                rows.append(r + start)
                cols.append(c)
                values.append(z[r, c])
        r = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        c = np.concatenate(cols) if cols else np.zeros(0, dtype=np.int64)
        left, right = new.take(pa.array(r)), neighbours.take(pa.array(c))
        return pa.table(
            {
                **{name: left.column(name) for name in ("pair_id", "source", "id", "token")},
                **{name: right.column(name) for name in ("nbr_id", "src_id")},
                "z": pa.array(np.concatenate(values) if values else np.zeros(0)),
            }
        )

    return work


def _summed(new: pa.Table, neighbours: pa.Table) -> pa.Table:
    new, neighbours = _by_id(new, "id"), _by_id(neighbours, "nbr_id")
    n, m = new.num_rows, neighbours.num_rows
    total, low, high = np.zeros(n), np.zeros(n), np.zeros(n)
    if n and m:
        a, b = _unit_rows(new, "aux"), _unit_rows(neighbours, "nbr_aux").T
        for start in range(0, n, CHUNK_ROWS):
            z = a[start : start + CHUNK_ROWS] @ b
            part = slice(start, start + len(z))
            total[part], low[part], high[part] = z.sum(axis=1), z.min(axis=1), z.max(axis=1)
    kept = n if m else 0
    return pa.table(
        {
            **{name: new.column(name).slice(0, kept) for name in ("pair_id", "id", "token")},
            "n": pa.array(np.full(kept, m, dtype=np.int64)),
            "z_sum": pa.array(total[:kept]),
            "z_min": pa.array(low[:kept]),
            "z_max": pa.array(high[:kept]),
        }
    )


def cosine_summary(annotated: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Similarities of every new token to all usable overlapping tokens, as
    ``(pair_id, id, token, n_pairs, z_sum, z_min, z_max)``."""
    schema = "pair_id string, id bigint, token string, n bigint, z_sum double, z_min double, z_max double"
    return (
        _cells(annotated, _summed, schema, limits)
        .groupBy("pair_id", "id", "token")
        .agg(
            F.sum("n").alias("n_pairs"),
            F.sum("z_sum").alias("z_sum"),
            F.min("z_min").alias("z_min"),
            F.max("z_max").alias("z_max"),
        )
    )


def nearest(annotated: DataFrame, k: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The ``k`` most similar overlapping tokens of every new token, with ``rank``
    from 1 (ties by neighbour id)."""
    best = Window.partitionBy("pair_id", "id").orderBy(F.col("z").desc(), F.col("nbr_id"))
    return (
        _cells(annotated, _selected(top_mask(k)), NEIGHBOUR_SCHEMA, limits)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
    )


def sparsemax(scored: DataFrame, part: list[str], tie: str) -> DataFrame:
    """Projection of the scores ``z`` of every group on the simplex.

    Keeps the rows with positive weight; adds ``k`` (position by falling score)
    and ``w``.
    """
    falling = Window.partitionBy(*part).orderBy(F.col("z").desc(), F.col(tie))
    whole = Window.partitionBy(*part)
    k, z = F.col("k"), F.col("z")
    inside = 1 + k * z > F.col("_total")
    return (
        scored.withColumn("k", F.row_number().over(falling))
        .withColumn("_total", F.sum("z").over(falling.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_tau", F.max(F.when(inside, F.struct("k", ((F.col("_total") - 1) / k).alias("t")))).over(whole))
        .withColumn("w", z - F.col("_tau.t"))
        .where(F.col("w") > 0)
        .drop("_total", "_tau")
    )


def neighbour_weights(annotated: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """``(pair_id, source, id, token, nbr_id, src_id, z, k, w)``: the weights of the
    overlapping tokens a new token is made of."""
    candidates = _cells(annotated, _selected(support_mask), NEIGHBOUR_SCHEMA, limits)
    return sparsemax(candidates, ["pair_id", "id"], "nbr_id")
