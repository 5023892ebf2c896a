"""Near-duplicate documents: MinHash bands, odd sketches, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraft.llm.common import blocks_by_length, map_batches, sized
from lexigraft.llm.components import connected_components
from lexigraft.llm.shingles import mix, shingle_hashes, word_hashes, words_lower
from lexigraft.session import materialize


@dataclass(frozen=True)
class Settings:
    """Similarity and signature sizes.

    At similarity 0.75 a pair shares none of 32 bands of 3 values with probability (1 - 0.75^3)^32 < 3e-8.
    The sketch folds all 192 values; its estimate has a standard deviation of about 0.035 there, so that
    pairs estimated at 0.55 or more are checked.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 3
    samples: int = 192
    sketch_longs: int = 32
    least_estimate: float = 0.55
    members_per_task: int = 200
    cell: int = 256


@cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] | np.uint64(1))[:, None], seeds[n:][:, None]


def minhash(hashes: np.ndarray, samples: int) -> np.ndarray:
    """Smallest value of each of ``samples`` hash functions over a set."""
    a, b = _multipliers(samples)
    out = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 512):
        part = hashes[None, start : start + 512] * a
        part += b
        part >>= np.uint64(24)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def odd_sketch(values: np.ndarray, longs: int) -> np.ndarray:
    """Parity bitmap: every (function, value) flips one bit, so equal samples of two sets cancel in their XOR."""
    bits = mix(values + np.arange(len(values), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(64 * longs)
    odd = np.bincount(bits.astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in values[: bands * rows].reshape(bands, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def estimated_similarity(differing: Column, samples: int, longs: int) -> Column:
    """Similarity from the number of ones in the XOR of two odd sketches; a full sketch says nothing above 0."""
    m = 64.0 * longs
    free = F.greatest(1 - 2 * differing / m, F.lit(1e-9))
    return 1 + F.log(free) * m / (4.0 * samples)


def signatures(docs: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, key, sketch, bands)``: ``key`` is a 128-bit digest of the set, null for an empty one."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        def work(batch: pa.RecordBatch):
            for part in blocks_by_length(batch, 1, 4 << 20):
                out: dict = {"doc_id": part.column(0), "n_shingles": [], "key": [], "sketch": [], "bands": []}
                for text in part.column(1).to_pylist():
                    h = np.unique(shingle_hashes(word_hashes(words_lower(text)), s.shingle))
                    out["n_shingles"].append(len(h))
                    if len(h):
                        values = minhash(h, s.samples)
                        out["key"].append(xxhash.xxh3_128_digest(h.tobytes()))
                        out["sketch"].append(odd_sketch(values, s.sketch_longs))
                        out["bands"].append(band_hashes(values, s.bands, s.rows))
                    else:
                        for c in ("key", "sketch", "bands"):
                            out[c].append(None)
                yield out

        return work

    schema = f"doc_id {kind}, n_shingles bigint, key binary, sketch array<bigint>, bands array<bigint>"
    return map_batches(docs.select(id_col, text_col), make, schema)


def _close(a: str, b: str, s: Settings) -> Column:
    """Sizes allow the similarity, and the sketches do not speak against it."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    ones = F.aggregate(
        F.zip_with(F.col(f"{a}.sketch"), F.col(f"{b}.sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda t, x: t + x,
    )
    enough = 100 * F.least(n, m) >= s.percent * F.greatest(n, m)
    return enough & (estimated_similarity(ones, s.samples, s.sketch_longs) >= s.least_estimate)


def _hashes(text: str | None, s: Settings) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words_lower(text)), s.shingle))


def _with_text(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``text`` to ``wanted(rep, ...)``; few rows are sent to the documents, many are joined by shuffle."""
    return docs.select(F.col("doc_id").alias("rep"), "text").join(sized(wanted, 96), "rep")


def _confirm(pairs: DataFrame, sets: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Those of ``pairs(u, v)`` whose full shingle sets are similar enough.

    A set that is in many pairs is compared in tasks of a bounded number of partners; it travels once per
    task, not once per pair.
    """
    counts = pairs.groupBy("v").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / s.members_per_task)
    dealt = pairs.join(counts, "v").select("u", "v", F.pmod(F.xxhash64("u", "v"), parts).alias("part"))
    wanted = dealt.select(F.col("u").alias("key"), "v", "part").unionByName(
        dealt.select(F.col("v").alias("key"), "v", "part").distinct()
    )
    wanted = materialize(wanted.join(sets.select("key", "rep"), "key"), "wanted")
    rows = _with_text(wanted, docs).select("v", "part", (F.col("key") == F.col("v")).alias("centre"), "key", "text")
    rows = rows.repartition("v", "part").sortWithinPartitions("v", "part", F.desc("centre"), "key")

    def make():
        centre: list = [None, None]

        def work(batch: pa.RecordBatch):
            for block in blocks_by_length(batch, 4, 4 << 20):
                us, vs = [], []
                columns = [block.column(c).to_pylist() for c in (0, 2, 3, 4)]
                for v, is_centre, key, text in zip(*columns, strict=True):
                    h = _hashes(text, s)
                    if xxhash.xxh3_128_digest(h.tobytes()) != key:
                        continue  # another row with the same id
                    if is_centre:
                        centre[:] = v, h
                    elif centre[0] == v and _similar(h, centre[1], s):
                        us.append(key)
                        vs.append(v)
                yield {"u": us, "v": vs}

        return work

    return materialize(map_batches(rows, make, "u binary, v binary").distinct(), "links")


def _similar(a: np.ndarray, b: np.ndarray, s: Settings) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= s.percent * (len(a) + len(b) - shared)


class Forest:
    """Disjoint sets over the members of a cell, those of one component together from the start."""

    def __init__(self, components: list):
        first: dict = {}
        self.root = [first.setdefault(c, i) for i, c in enumerate(components)]

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.root[self.find(i)] = self.find(j)


def _cell_links(members: DataFrame, group: str, s: Settings, docs: DataFrame | None = None) -> DataFrame:
    """Links between different components within groups, from cells of bounded size.

    ``members`` has ``(group, key, component, n, sketch[, rep])``. A group's members are dealt into blocks,
    large components into blocks of their own; each pair of blocks that does not lie in one component is a cell. A cell compares its
    members by sketch and returns, of the pairs that pass, only those that join what is not joined yet: a forest,
    fewer pairs than members. With ``docs`` a pair must also pass on full sets.
    """
    sizes = members.groupBy(group, "component").agg(F.count("*").alias("c"))
    shared = sizes.where(F.col("c") <= s.cell).groupBy(group).agg(F.sum("c").alias("t"))
    own = F.concat_ws("-", F.hex("component"), F.pmod(F.xxhash64("key"), F.ceil(F.col("c") / s.cell)).cast("string"))
    packed = F.pmod(F.xxhash64("component"), F.ceil(F.col("t") / s.cell)).cast("string")
    block = F.when(F.col("c") > s.cell, own).otherwise(packed).alias("block")
    dealt = members.join(sizes.join(shared, group, "left"), [group, "component"])
    dealt = materialize(dealt.select(*members.columns, block), "blocks")
    blocks = dealt.groupBy(group, "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    one, two = blocks.alias("x"), blocks.alias("y")
    open_cell = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    cells = one.join(two, (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col("x.block") <= F.col("y.block"))).where(open_cell)
    cells = cells.select(F.col(f"x.{group}").alias(group), F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    sides = cells.select(group, "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    rows = dealt.join(materialize(sides, "cells"), [group, "block"])
    rows = rows.withColumn("left", F.col("block") == F.col("a"))
    if docs is not None:
        rows = _with_text(materialize(rows, "cell-rows"), docs)
    columns = [group, "a", "b", "left", "key", "component", "n", "sketch", *(["text"] if docs is not None else [])]
    rows = rows.select(*columns).repartition(group, "a", "b").sortWithinPartitions(group, "a", "b")
    full = docs is not None
    m = 64.0 * s.sketch_longs

    def links_of(cell: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        sets = [_hashes(r[8], s) if full else None for r in cell]
        if full:
            same = [xxhash.xxh3_128_digest(h.tobytes()) == r[4] for h, r in zip(sets, cell, strict=True)]
            cell, sets = [r for r, ok in zip(cell, same, strict=True) if ok], [h for h, ok in zip(sets, same, strict=True) if ok]
        if len(cell) < 2:
            return
        sketches = np.array([r[7] for r in cell], np.int64).view(np.uint64)
        sizes = np.array([r[6] for r in cell])
        left = np.array([r[3] for r in cell])
        diagonal = cell[0][1] == cell[0][2]
        forest = Forest([r[5] for r in cell])
        for i in range(len(cell)):
            if not diagonal and not left[i]:
                continue
            able = 100 * np.minimum(sizes, sizes[i]) >= s.percent * np.maximum(sizes, sizes[i])
            able &= np.arange(len(cell)) > i if diagonal else ~left
            at = np.flatnonzero(able)
            ones = np.bitwise_count(sketches[at] ^ sketches[i]).sum(axis=1)
            estimate = 1 + np.log(np.maximum(1 - 2 * ones / m, 1e-9)) * m / (4.0 * s.samples)
            for j in at[estimate >= s.least_estimate]:
                if forest.find(i) != forest.find(j) and (not full or _similar(sets[i], sets[j], s)):
                    forest.join(i, j)
                    yield (cell[i][4], cell[j][4]) if full else (cell[i][5], cell[j][5])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list[tuple] = []

        def done() -> pa.RecordBatch:
            found = list(links_of(cell))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for block in blocks_by_length(batch, 4, 64 << 10):
                for row in zip(*(c.to_pylist() for c in block.columns), strict=True):
                    if cell and cell[0][:3] != row[:3]:
                        yield done()
                        cell = []
                    cell.append(row)
        if cell:
            yield done()

    return materialize(rows.mapInArrow(run, "u binary, v binary").distinct(), "cell-links")


def near_duplicate_classes(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every input row.

    Documents are linked if their sets of word shingles have at least ``percent`` similarity, and a
    component is what links reach. ``component_id`` is its smallest id. Texts without words have no shingles and
    stay alone; null texts likewise. A null id never becomes a component's id unless all are null. Repeated rows
    get the same answer; an id that stands at two texts belongs to the component of each. Other columns are ignored.

    Equal sets are one node from the start, so copies cost nothing. In each band bucket all members are compared
    with one of them, links are joined to components, and only members of different components of a bucket are
    compared further, in cells of bounded size that return a forest: a large group of near copies never becomes
    all its pairs. Those comparisons go by sketch first and gather components into clusters; the sets of a
    cluster are then compared in full, in cells again.
    """
    s = settings
    # Rows are told apart by id and text, and ordered by id with null ids last.
    own = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"))
    plain = docs.select(own.alias("doc_id"), F.col(text_col).alias("text"))
    # Digests, sizes and signatures of all rows; read by every later step.
    rows = materialize(signatures(plain, s), "signatures")
    sets = rows.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"),
        F.first("n_shingles").alias("n"),
        F.first("sketch").alias("sketch"),
        F.first("bands").alias("bands"),
    )
    sets = materialize(sets, "sets")
    bands = sets.select("key", F.explode("bands").alias("bh"))
    # Buckets with the same members, as a tight group has in every band, are one.
    groups = bands.groupBy("bh").agg(
        F.min("key").alias("leader"),
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
    )
    groups = groups.where("size > 1").groupBy("leader", "size", "x", "y").agg(F.min("bh").alias("bh"))
    groups = materialize(groups.select("bh", "leader", "size"), "bands")
    buckets = materialize(bands.join(groups, "bh"), "buckets")
    star = buckets.where("key != leader").select(F.col("key").alias("u"), F.col("leader").alias("v")).distinct()
    small = sets.select("key", "n", "sketch")
    close = (
        star.join(small.alias("a"), F.col("a.key") == F.col("u"))
        .join(small.alias("b"), F.col("b.key") == F.col("v"))
        .where(_close("a", "b", s))
        .select("u", "v")
    )
    links = _confirm(materialize(close, "candidates"), sets, plain, s)
    found = materialize(connected_components(links), "components")
    # Buckets of two are decided; of the others those that still hold several components go on.
    members = buckets.where("size > 2").join(found, F.col("node") == F.col("key"), "left")
    members = members.select("bh", "key", F.coalesce("component", "key").alias("component"))
    members = materialize(members, "members")
    open_ = members.groupBy("bh").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b")
    rest = members.join(open_.select("bh"), "bh").join(small, "key")
    # Components that may be linked, by their sketches, form a cluster; a forest of such pairs is enough to find it.
    near = _cell_links(rest, "bh", s)
    if near.take(1):
        clusters = materialize(
            connected_components(near).select(F.col("node").alias("component"), F.col("component").alias("cluster")), "clusters"
        )
        ids = small.join(sets.select("key", "rep"), "key").join(found, F.col("node") == F.col("key"), "left")
        inside = ids.select("key", "rep", "n", "sketch", F.coalesce("component", "key").alias("component")).join(clusters, "component")
        more = _cell_links(inside, "cluster", s, plain)
        links = links.unionByName(more)
        found = materialize(connected_components(links), "components")
    # The smallest document of each component, then of each set.
    ids = sets.select("key", "rep").join(found, F.col("node") == F.col("key"), "left")
    ids = materialize(ids.select("key", "rep", F.coalesce("component", "key").alias("component")), "set-components")
    least = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = materialize(ids.join(least, "component").select("key", "component_id"), "component-of-set")
    labelled = rows.select("doc_id", "n_shingles", "key").join(by_set, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id.id")).otherwise(F.col("component_id.id"))
    return labelled.select(
        F.col("doc_id.id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id.id").eqNullSafe(component).alias("kept"),
    )
