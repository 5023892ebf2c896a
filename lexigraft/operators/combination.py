"""Weighted sums of source vectors, as products of sparse blocks of weights and dense blocks of source rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.operators.lookup import or_missing
from lexigraft.session import DEFAULT_LIMITS, Limits, per_name


def combine_vectors(parts: DataFrame, embeddings: DataFrame, keys: list[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Sum of ``w * vector`` over the rows of ``parts(*keys, source, k, src_id, w)``.

    Returns ``(*keys, matrix, vector ARRAY<DOUBLE>)`` for every matrix of the
    source vocabulary. A source vocabulary without a matrix, an id without a row
    in one of its matrices, or with two of them, is an error. ``parts`` is read three
    times, so it should be a written table.

    Tokens are dealt into blocks whose weights need at most about ``product_bytes`` of source
    rows. A block gets each source row it refers to once, however many of its tokens share it, and
    a row that all tokens refer to is copied once per block. A sum is folded in the order of ``k``,
    in pieces of ``fold_rows`` that are blocks of their own, so its bits depend neither on the shuffle
    nor on the blocks.
    """
    matrices = embeddings.groupBy(F.col("vocab").alias("source"), "matrix").agg(F.max(F.size("vector")).alias("_dim"))
    counts = parts.groupBy("source").agg(F.count("*").alias("_n"))
    held = F.greatest(F.lit(1), F.floor(F.lit(limits.product_bytes) / (8 * F.greatest("_dim", F.lit(1)))))
    shapes = counts.join(matrices, "source", "left").select("source", "matrix", F.ceil(F.col("_n") / held).alias("_blocks"))
    dealt = parts.join(per_name(shapes), "source", "left").select(
        *keys,
        "source",
        "matrix",
        F.pmod(F.xxhash64(*keys), F.coalesce("_blocks", F.lit(1))).alias("_block"),
        ((F.col("k") - 1) / limits.fold_rows).cast("int").alias("_fold"),
        "k",
        "src_id",
        "w",
    )
    needed = dealt.select("source", "matrix", "_block", "_fold", "src_id").distinct()
    vectors = embeddings.select(F.col("vocab").alias("source"), "matrix", F.col("id").alias("src_id"), "vector")
    rows = or_missing(needed.join(vectors, ["source", "matrix", "src_id"], "left"))
    # Other names than those of the weights: both sides stem from one table.
    rows = rows.select(*[F.col(c).alias(f"r_{c}") for c in ("source", "matrix", "_block", "_fold", "src_id", "vector")])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema]
    schema = ", ".join([*kinds, "matrix string, _fold int, v array<double>"])
    sums = (
        dealt.groupBy("source", "matrix", "_block", "_fold")
        .cogroup(rows.groupBy("r_source", "r_matrix", "r__block", "r__fold"))
        .applyInArrow(_product(keys), schema)
    )
    total = F.aggregate(
        "folds",
        F.transform(F.get("folds", F.lit(0))["v"], lambda x: F.lit(0.0)),
        lambda acc, b: F.zip_with(acc, b["v"], lambda a, x: a + x),
    )
    return (
        sums.groupBy(*keys, "matrix")
        .agg(F.array_sort(F.collect_list(F.struct("_fold", "v"))).alias("folds"))
        .select(*keys, "matrix", total.alias("vector"))
    )


def _product(keys: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One block of weights times the source rows it refers to."""

    def work(parts: pa.Table, rows: pa.Table) -> pa.Table:
        parts = parts.sort_by([(c, "ascending") for c in (*keys, "k")])
        dense, at = _dense(rows, parts.column("src_id").to_numpy())
        starts = _starts(parts, keys)
        lengths = np.diff(np.append(starts, parts.num_rows))
        # Tokens with the most weights first, so that those with a k-th weight are always the first ones.
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        w = parts.column("w").to_numpy()
        sums = np.zeros((len(starts), dense.shape[1]))
        for k in range(lengths[0]):
            open_ = starts[: np.count_nonzero(lengths > k)] + k
            sums[: len(open_)] += w[open_, None] * dense[at[open_]]
        ends = np.arange(0, sums.size + 1, max(dense.shape[1], 1), dtype=np.int32)
        first = parts.take(pa.array(starts))
        return pa.table(
            {
                **{c: first.column(c) for c in keys},
                "matrix": first.column("matrix"),
                "_fold": first.column("_fold"),
                "v": pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel())),
            }
        )

    return work


def _dense(rows: pa.Table, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source rows as a matrix, and where each wanted id is in it."""
    rows = rows.sort_by("r_src_id")
    ids = rows.column("r_src_id").to_numpy()
    twice = np.flatnonzero(ids[1:] == ids[:-1])
    if len(twice):
        raise ValueError(f"more than one source vector for id {ids[twice[0]]} of {rows.column('r_source')[0]}")
    flat = np.asarray(rows.column("r_vector").combine_chunks().flatten(), dtype=np.float64)
    return flat.reshape(len(ids), -1), np.searchsorted(ids, wanted)


def _starts(parts: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the weights of each token begin in a sorted table."""
    new = np.zeros(parts.num_rows, dtype=bool)
    new[:1] = True
    for c in keys:
        codes = parts.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)
