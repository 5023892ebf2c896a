"""Learned token vectors: the best low-rank factors of a weighted co-occurrence table, by block subspace iteration.

The table is cut into cells of ``cell_rows`` tokens by as many contexts, the thin matrix of vectors into blocks of as
many rows. A step multiplies every cell by the block of its contexts and adds up the products of one block of tokens
in the order of the cells. Only square matrices as wide as the vectors reach the driver, one per vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.functions.hashing import sign_words
from lexigraft.operators.ranking import number_rows
from lexigraft.session import DEFAULT_LIMITS, Limits, materialize

#: Steps of the iteration, and columns carried beside the wanted ones, which make it converge faster.
STEPS, EXTRA = 6, 8
#: Products of table entries and vectors that are laid out at a time.
CHUNK_VALUES = 1 << 21
#: Directions below this share of the largest are noise of a table of lower rank.
RANK_TOLERANCE = 1e-10

BLOCK_SCHEMA = "lang string, block int, data binary"
CELL_SCHEMA = "lang string, bi int, bj int, n_rows int, rows binary, cols binary, weights binary"


def cell_product(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, block: np.ndarray, n_rows: int) -> np.ndarray:
    """Product of a sparse cell, sorted by row and column, with a dense block of its columns."""
    out = np.zeros((n_rows, block.shape[1]))
    step = max(1, CHUNK_VALUES // block.shape[1])
    for start in range(0, len(rows), step):
        r = rows[start : start + step]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        sums = np.add.reduceat(weights[start : start + step, None] * block[cols[start : start + step]], first, axis=0)
        out[r[first]] += sums
    return out


def orthonormal_map(gram: np.ndarray) -> np.ndarray:
    """What turns columns with the given inner products into orthonormal ones; dependent columns become zero."""
    values, vectors = np.linalg.eigh(gram)
    scale = np.where(values > RANK_TOLERANCE * max(values[-1], 0.0), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return (vectors * scale)[:, ::-1]


def factor_map(projected: np.ndarray, dim: int) -> np.ndarray:
    """From an orthonormal basis to the ``dim`` strongest factors, each scaled by the root of its strength."""
    values, vectors = np.linalg.eigh((projected + projected.T) / 2)
    strongest = np.argsort(-np.abs(values), kind="stable")[:dim]
    return vectors[:, strongest] * np.sqrt(np.abs(values[strongest]))


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, width)


def _pack_cells(weighted: DataFrame, index: DataFrame, limits: Limits) -> DataFrame:
    """Entries of the table as one row per cell, in numbers of tokens inside their blocks."""
    size = limits.cell_rows
    row = index.select("lang", "token", F.col("at").alias("i"), "n_tokens")
    col = index.select("lang", F.col("token").alias("ctx"), F.col("at").alias("j"))
    placed = weighted.where("ppmi > 0").join(row, ["lang", "token"]).join(col, ["lang", "ctx"])
    bi, bj = F.floor(F.col("i") / size).cast("int"), F.floor(F.col("j") / size).cast("int")
    dealt = placed.select(
        "lang",
        bi.alias("bi"),
        bj.alias("bj"),
        F.least(F.lit(size), F.col("n_tokens") - bi * size).cast("int").alias("n_rows"),
        F.pmod("i", F.lit(size)).cast("int").alias("r"),
        F.pmod("j", F.lit(size)).cast("int").alias("c"),
        "ppmi",
    )

    def pack(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("r", "ascending"), ("c", "ascending")])
        blobs = [
            pa.array([np.ascontiguousarray(cell.column(name).to_numpy(), kind).tobytes()], pa.binary())
            for name, kind in (("r", np.int32), ("c", np.int32), ("ppmi", np.float64))
        ]
        about = [cell.column(name).slice(0, 1).combine_chunks() for name in ("lang", "bi", "bj", "n_rows")]
        return pa.Table.from_arrays([*about, *blobs], names=[f.split()[0] for f in CELL_SCHEMA.split(", ")])

    return materialize(dealt.groupBy("lang", "bi", "bj").applyInArrow(pack, CELL_SCHEMA), "cells")


def _start(index: DataFrame, width: int, limits: Limits) -> DataFrame:
    """Blocks of random signs keyed by the tokens."""
    words = [w.alias(f"s{k}") for k, w in enumerate(sign_words(F.col("token"), width))]
    signs = index.select("lang", F.floor(F.col("at") / limits.cell_rows).cast("int").alias("block"), "at", *words)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        words = np.stack([rows.column(c).to_numpy() for c in rows.column_names if c.startswith("s")], axis=1)
        bits = (words[:, :, None] >> np.arange(32)) & 1
        signs = 1.0 - 2.0 * bits.reshape(len(words), -1)[:, :width]
        about = [rows.column(c).slice(0, 1).combine_chunks() for c in ("lang", "block")]
        return pa.Table.from_arrays([*about, pa.array([signs.tobytes()], pa.binary())], names=["lang", "block", "data"])

    return materialize(signs.groupBy("lang", "block").applyInArrow(pack, BLOCK_SCHEMA), "start")


def _multiply(cells: DataFrame, blocks: DataFrame, width: int, small: bool) -> DataFrame:
    """The table times the blocks, as blocks again; blocks of tokens without entries drop out."""
    side = blocks.select("lang", F.col("block").alias("bj"), "data")
    joined = cells.join(F.broadcast(side) if small else side, ["lang", "bj"])
    partial_schema = "lang string, block int, bj int, data binary"

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                at = {name: b.column(k)[row].as_py() for k, name in enumerate(b.schema.names)}
                product = cell_product(
                    np.frombuffer(at["rows"], np.int32),
                    np.frombuffer(at["cols"], np.int32),
                    np.frombuffer(at["weights"], np.float64),
                    _matrix(at["data"], width),
                    at["n_rows"],
                )
                yield pa.RecordBatch.from_pylist(
                    [{"lang": at["lang"], "block": at["bi"], "bj": at["bj"], "data": product.tobytes()}],
                    schema=pa.schema([("lang", pa.string()), ("block", pa.int32()), ("bj", pa.int32()), ("data", pa.binary())]),
                )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("data", pa.binary())])
        key, total = None, None
        for b in batches:
            for row in range(b.num_rows):
                lang, block, data = (b.column(k)[row].as_py() for k in (0, 1, 3))
                part = np.frombuffer(data, np.float64)
                if key == (lang, block):
                    total = total + part
                    continue
                if key:
                    yield pa.RecordBatch.from_pylist([{"lang": key[0], "block": key[1], "data": total.tobytes()}], schema=schema)
                key, total = (lang, block), part
        if key:
            yield pa.RecordBatch.from_pylist([{"lang": key[0], "block": key[1], "data": total.tobytes()}], schema=schema)

    # One cell or partial product at a time: a task holds a few blocks, whatever the number of cells.
    partial = joined.select(*[f.split()[0] for f in CELL_SCHEMA.split(", ")], "data").mapInArrow(products, partial_schema)
    ordered = partial.repartition("lang", "block").sortWithinPartitions("lang", "block", "bj")
    return ordered.mapInArrow(added, BLOCK_SCHEMA)


def _mapped(blocks: DataFrame, maps: dict[str, np.ndarray], width: int) -> DataFrame:
    """Every block times the matrix of its vocabulary."""
    shared = blocks.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(_matrix(d, width) @ shared.value[lang]).tobytes() for lang, d in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.binary())], names=["lang", "block", "data"])

    return blocks.select("lang", "block", "data").mapInArrow(run, BLOCK_SCHEMA)


def _inner_products(blocks: DataFrame, width: int, other: DataFrame | None = None) -> dict[str, np.ndarray]:
    """Per vocabulary the inner products of its columns, with those of ``other`` if given, added up in block order."""
    alone = other is None
    both = blocks if alone else blocks.join(other.select("lang", "block", F.col("data").alias("more")), ["lang", "block"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lefts = [_matrix(d, width) for d in b.column(2).to_pylist()]
            rights = lefts if alone else [_matrix(d, width) for d in b.column(3).to_pylist()]
            done = [(x.T @ y).tobytes() for x, y in zip(lefts, rights)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.binary())], names=["lang", "block", "data"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(width * width)
        for data in parts.sort_by("block").column("data").to_pylist():
            total = total + np.frombuffer(data, np.float64)
        about = parts.column("lang").slice(0, 1).combine_chunks()
        return pa.Table.from_arrays([about, pa.array([total.tobytes()], pa.binary())], names=["lang", "data"])

    products = both.mapInArrow(multiply, BLOCK_SCHEMA)
    sums = products.groupBy("lang").applyInArrow(add, "lang string, data binary")
    return {r["lang"]: _matrix(bytes(r["data"]), width) for r in sums.collect()}


def factorise(
    weighted: DataFrame, dim: int, steps: int = STEPS, extra: int = EXTRA, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """``(vocab, token, vector)``: the ``dim`` strongest factors of the symmetric table ``weighted(lang, token, ctx, ppmi)``.

    A token's vector has its entries in the strongest eigenvectors, each times the root of the eigenvalue's size, so
    the inner products of the vectors come as near to the weights' positive part as ``dim`` columns can. Subspace
    iteration from random signs keyed by the tokens, ``steps`` times. Tokens without a positive weight have no row;
    a table of lower rank gives zeros in the last columns. Blocks and sums have a fixed order, so the bits do not
    depend on the partitioning.
    """
    width = dim + extra
    pairs = weighted.select("lang", "token", "ctx", "ppmi").where("ppmi > 0")
    tokens = pairs.select("lang", "token").distinct()
    numbered = number_rows(tokens, ["lang"], [F.col("token")], "at", limits)
    index = materialize(numbered, "token-index")
    sizes = index.groupBy("lang").agg(F.count("*").alias("n_tokens"))
    n = {r["lang"]: r["n_tokens"] for r in sizes.collect()}
    if not n:
        return weighted.sparkSession.createDataFrame([], "vocab string, token string, vector array<double>")
    index = index.join(F.broadcast(sizes), "lang")
    cells = _pack_cells(pairs, index, limits)
    small = 8 * width * sum(n.values()) <= limits.broadcast_bytes
    basis = _start(index, width, limits)
    for _ in range(steps):
        product = materialize(_multiply(cells, basis, width, small), "product")
        maps = {lang: orthonormal_map(g) for lang, g in _inner_products(product, width).items()}
        basis = _mapped(product, maps, width)
    # Once more: one pass leaves columns of very different strength only nearly orthogonal.
    basis = materialize(basis, "basis")
    maps = {lang: orthonormal_map(g) for lang, g in _inner_products(basis, width).items()}
    basis = materialize(_mapped(basis, maps, width), "basis")
    projected = _inner_products(basis, width, materialize(_multiply(cells, basis, width, small), "product"))
    factors = _mapped(basis, {lang: factor_map(p, dim) for lang, p in projected.items()}, width)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, block, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows = _matrix(data, dim)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(rows.ravel()))
                at = pa.array(np.arange(len(rows)) + block * limits.cell_rows)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), at, vectors], names=["lang", "at", "vector"])

    vectors = factors.mapInArrow(unpack, "lang string, at bigint, vector array<double>")
    return index.join(vectors, ["lang", "at"]).select(F.col("lang").alias("vocab"), "token", "vector")
