"""Hard negatives by exact integer scores behind an angular triangle filter.

Every row stores its angles to a few reference directions. Between rows at angles a and b to one direction the angle
is between ``|a - b|`` and ``min(a + b, 2 pi - a - b)``; the cosines of these bounds, multiplied by the norms and
widened by more than any rounding, hold the score. Only rows whose bounds reach into a wanted window are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraft.session import materialize, scratch_path

#: Components become floor(SCALE * x).
SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 80, 100
#: Reference directions, and the rows they are chosen from. They only decide how much is filtered.
REFERENCES, SAMPLE_ROWS = 8, 2048
#: Rows of a block, which is one row of the written table, and of a tile of it, which is filtered as a whole first.
BLOCK_ROWS, TILE_ROWS = 4096, 256
#: Bytes of anchors that are sent around at a time. More anchors take further passes over the blocks.
GROUP_BYTES = 24 << 20
#: Slack of angles (32-bit numbers and the arc cosine near its ends) and, relative to the norms, of scores.
ANGLE_SLACK, SCORE_SLACK = 1e-5, 1e-5
#: Scores stay below this, so that sums and hundredfolds of them fit 64 bits.
LARGEST_SCORE = 1 << 55

_NO_SCORE = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max  # a null id comes last among equals

BLOCK_SCHEMA = "n int, ids array<bigint>, labels array<bigint>, anchors array<boolean>, q binary, norms binary, angles binary"
ANCHOR_SCHEMA = "block bigint, pos int, id bigint, label bigint, q binary, norm double, angles binary"


def quantised(vectors: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """Rows of whole numbers as 64-bit floats, which hold them exactly; shorter vectors end in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), dims))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(dims) < lengths[:, None]] = np.floor(scale * flat)
    if out.size and float(np.abs(out).max()) ** 2 * dims >= LARGEST_SCORE:
        raise ValueError("components are too large: scores would not fit 64 bits")
    return out


def angles_to(q: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to unit vectors, as 32-bit numbers; a row without length is at angle 0, its scores are all 0."""
    with np.errstate(invalid="ignore", divide="ignore"):
        cosines = (q @ references.T) / norms[:, None]
    return np.arccos(np.clip(np.where(norms[:, None] > 0, cosines, 1.0), -1, 1)).astype(np.float32)


def choose_references(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions of sampled rows, each as far as possible from those before it."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen = [units[0]]
    nearest = units @ units[0]
    while len(chosen) < min(count, len(units)):
        farthest = int(np.argmin(nearest))
        if nearest[farthest] > 1 - 1e-9:
            break
        chosen.append(units[farthest])
        nearest = np.maximum(nearest, units @ units[farthest])
    return np.array(chosen)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole rows as 64-bit integers: by floats where no partial sum can leave their exact range."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def score_bounds(
    angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of scores of anchors (rows) with things (columns) whose angles to each reference are
    within ``low`` and ``high`` and whose norms within ``least`` and ``most``."""
    apart = np.zeros((len(angles), low.shape[0]), np.float32)
    together = np.full_like(apart, np.pi)
    for r in range(angles.shape[1]):
        mine, near, far = angles[:, r, None], low[None, :, r], high[None, :, r]
        np.maximum(apart, np.maximum(near - mine, mine - far), out=apart)
        np.minimum(together, np.minimum(mine + far, 2 * np.float32(np.pi) - mine - near), out=together)
    upper = np.cos(np.maximum(apart - 2 * ANGLE_SLACK, 0))
    lower = np.cos(np.minimum(together + 2 * ANGLE_SLACK, np.float32(np.pi)))
    mine, slack = norms[:, None], 1 + SCORE_SLACK * norms[:, None] * most[None, :]
    top = mine * np.where(upper > 0, upper * most[None, :], upper * least[None, :]) + slack
    bottom = mine * np.where(lower > 0, lower * least[None, :], lower * most[None, :]) - slack
    return bottom, top


class Best:
    """The best few (score, id) of every slot so far: highest scores first, then smallest ids."""

    def __init__(self, slots: int, few: int):
        self.scores = np.full((slots, few), _NO_SCORE, np.int64)
        self.ids = np.full((slots, few), _NO_ID, np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach to be among them."""
        return self.scores[:, -1]

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row for each of ``slots`` and a column for each of ``ids``; absent ones are _NO_SCORE."""
        useful = (scores > _NO_SCORE) & (scores >= self.least()[slots][:, None])
        rows = np.flatnonzero(useful.any(axis=1))
        if not len(rows):
            return
        columns = np.flatnonzero(useful[rows].any(axis=0))
        slots, fresh = slots[rows], np.where(useful, scores, _NO_SCORE)[np.ix_(rows, columns)]
        both = np.concatenate([self.scores[slots], fresh], axis=1)
        names = np.concatenate([self.ids[slots], np.broadcast_to(ids[columns], fresh.shape)], axis=1)
        order = np.lexsort((names, ~both), axis=1)[:, : self.scores.shape[1]]
        self.scores[slots] = np.take_along_axis(both, order, axis=1)
        self.ids[slots] = np.take_along_axis(names, order, axis=1)


@dataclass
class Anchors:
    """A group of anchors, with the scores of their positives once these are known (``_NO_SCORE``: fewer)."""

    block: np.ndarray
    pos: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    positive_ids: np.ndarray | None = None
    positive_scores: np.ndarray | None = None


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _table_of_anchors(table: pa.Table, dims: int) -> Anchors:
    def joined(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    n = table.num_rows
    return Anchors(
        *(table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("block", "pos")),
        _ids(table.column("id").combine_chunks()),
        table.column("label").combine_chunks().to_numpy(zero_copy_only=False),
        joined("q", np.int64).reshape(n, dims).astype(np.float64),
        table.column("norm").combine_chunks().to_numpy(zero_copy_only=False),
        joined("angles", np.float32).reshape(n, -1),
    )


@dataclass
class _Block:
    number: int
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    norms: np.ndarray
    angles: np.ndarray


def _blocks(batch: pa.RecordBatch) -> Iterator[_Block]:
    for row in range(batch.num_rows):
        at = {name: batch.column(name)[row] for name in batch.schema.names}
        n = at["n"].as_py()
        yield _Block(
            at["block"].as_py(),
            _ids(at["ids"].values),
            at["labels"].values.to_numpy(zero_copy_only=False),
            np.frombuffer(at["q"].as_py(), np.int64).reshape(n, -1).astype(np.float64),
            np.frombuffer(at["norms"].as_py(), np.float64),
            np.frombuffer(at["angles"].as_py(), np.float32).reshape(n, -1),
        )


def _overlapping(
    anchors: Anchors, block: _Block, wanted: Callable[[], tuple[np.ndarray, np.ndarray]]
) -> Iterator[tuple[np.ndarray, slice, np.ndarray, np.ndarray]]:
    """Anchors and tiles of a block whose score bounds reach into what an anchor wants: (anchors, tile, which of their
    pairs, scores of these anchors with the tile). ``wanted`` gives the lowest and highest scores of interest now."""
    starts = np.arange(0, len(block.ids), TILE_ROWS)
    lows, highs = (f.reduceat(block.angles, starts, axis=0) for f in (np.minimum, np.maximum))
    least, most = (f.reduceat(block.norms, starts) for f in (np.minimum, np.maximum))
    bottom, top = score_bounds(anchors.angles, anchors.norms, lows, highs, least, most)
    for t, start in enumerate(starts):
        low, high = wanted()
        near = np.flatnonzero((top[:, t] >= low) & (bottom[:, t] <= high))
        if not len(near):
            continue
        tile = slice(int(start), int(start) + TILE_ROWS)
        angles, norms = block.angles[tile], block.norms[tile]
        lower, upper = score_bounds(anchors.angles[near], anchors.norms[near], angles, angles, norms, norms)
        pairs = (upper >= low[near, None]) & (lower <= high[near, None])
        kept = pairs.any(axis=1)
        near, pairs = near[kept], pairs[kept]
        if len(near):
            yield near, tile, pairs, exact_scores(anchors.q[near], block.q[tile])


def _find_positives(anchors: Anchors, few: int) -> tuple[Best, Callable[[_Block], None]]:
    best = Best(len(anchors.ids), few)
    infinite = np.full(len(anchors.ids), np.inf)

    def work(block: _Block) -> None:
        for near, tile, pairs, scores in _overlapping(anchors, block, lambda: (best.least().astype(np.float64), infinite)):
            same = pairs & (anchors.labels[near][:, None] == block.labels[tile][None, :])
            own = np.flatnonzero((anchors.block[near] == block.number) & (anchors.pos[near] >= tile.start) & (anchors.pos[near] < tile.start + same.shape[1]))
            same[own, anchors.pos[near][own] - tile.start] = False
            best.offer(near, np.where(same, scores, _NO_SCORE), block.ids[tile])

    return best, work


def _find_negatives(anchors: Anchors, few: int, low: int, high: int) -> tuple[Best, Callable[[_Block], None]]:
    """Slots are (anchor, positive); a slot's window is ``low`` to ``high`` hundredths of its positive's score."""
    scores = anchors.positive_scores
    n, slots = scores.shape
    known = scores > _NO_SCORE
    bounded = np.where(known, scores, 0)
    floor = np.where(known, -(-low * bounded // 100), np.iinfo(np.int64).max)
    ceiling = np.where(known, high * bounded // 100, _NO_SCORE)
    best = Best(n * slots, few)

    def wanted() -> tuple[np.ndarray, np.ndarray]:
        reach = np.maximum(floor, best.least().reshape(n, slots))
        return reach.min(axis=1).astype(np.float64), ceiling.max(axis=1).astype(np.float64)

    def work(block: _Block) -> None:
        for near, tile, pairs, found in _overlapping(anchors, block, wanted):
            other = pairs & (anchors.labels[near][:, None] != block.labels[tile][None, :])
            for j in range(slots):
                inside = other & (found >= floor[near, j][:, None]) & (found <= ceiling[near, j][:, None])
                best.offer(near * slots + j, np.where(inside, found, _NO_SCORE), block.ids[tile])

    return best, work


def _scan(blocks: DataFrame, shared: Broadcast, find: Callable[[Anchors], tuple[Best, Callable]], per_anchor: int) -> DataFrame:
    """What each task finds for each slot: ``(block, pos, slot, score, id)``, a few rows per slot and task."""
    schema = "block bigint, pos int, slot int, score bigint, id bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        best, work = find(anchors)
        for batch in batches:
            for block in _blocks(batch):
                work(block)
        rows, places = np.nonzero(best.scores > _NO_SCORE)
        ids = best.ids[rows, places]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchors.block[rows // per_anchor]),
                pa.array(anchors.pos[rows // per_anchor].astype(np.int32)),
                pa.array((rows % per_anchor).astype(np.int32)),
                pa.array(best.scores[rows, places]),
                pa.array(ids, mask=ids == _NO_ID),
            ],
            names=["block", "pos", "slot", "score", "id"],
        )

    return blocks.mapInArrow(run, schema)


def _first(found: DataFrame, few: int) -> DataFrame:
    """The best few of each slot over all tasks, with ``rank`` from 1."""
    order = Window.partitionBy("block", "pos", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)


def _pack_blocks(rows: DataFrame, dims: int, references: np.ndarray, scale: int) -> DataFrame:
    """Rows sorted by nearest reference and the angle to it, in blocks; numbered and written once."""
    shared = rows.sparkSession.sparkContext.broadcast(references)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = quantised(b.column(b.schema.names.index("vector")), dims, scale)
            angles = angles_to(q, np.linalg.norm(q, axis=1), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(angles.argmin(axis=1).astype(np.int32)), pa.array(angles.min(axis=1))],
                names=[*b.schema.names, "cell", "angle"],
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(start, BLOCK_ROWS)
                q = quantised(b.column(b.schema.names.index("vector")), dims, scale)
                norms = np.linalg.norm(q, axis=1)
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in (0, 1, 2)]
                blobs = [x.tobytes() for x in (q.astype(np.int64), norms, angles_to(q, norms, shared.value))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.num_rows], pa.int32()), *lists, *(pa.array([x], pa.binary()) for x in blobs)],
                    names=["n", "ids", "labels", "anchors", "q", "norms", "angles"],
                )

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", cell int, angle float"
    # The id among the keys splits rows with one vector over partitions.
    near = rows.mapInArrow(measured, schema).repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle", "id")
    blocks = near.drop("cell", "angle").mapInArrow(packed, BLOCK_SCHEMA)
    return materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


def _write_anchors(blocks: DataFrame, dims: int, group_bytes: int) -> tuple[DataFrame, list[int]]:
    """The anchors out of the blocks, written by group of bounded size, and the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for row, block in enumerate(_blocks(batch)):
                pos = np.flatnonzero(batch.column(names.index("anchors"))[row].values.to_numpy(zero_copy_only=False))
                ids = block.ids[pos]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(pos), block.number)),
                        pa.array(pos.astype(np.int32)),
                        pa.array(ids, mask=ids == _NO_ID),
                        pa.array(block.labels[pos]),
                        pa.array([x.tobytes() for x in block.q[pos].astype(np.int64)], pa.binary()),
                        pa.array(block.norms[pos]),
                        pa.array([x.tobytes() for x in block.angles[pos]], pa.binary()),
                    ],
                    names=[f.split()[0] for f in ANCHOR_SCHEMA.split(", ")],
                )

    n = blocks.select(F.sum(F.size(F.filter("anchors", lambda x: x)))).first()[0] or 0
    n_groups = max(1, -(-n * (16 * dims + 200) // group_bytes))
    anchors = blocks.mapInArrow(run, ANCHOR_SCHEMA).withColumn("group", F.pmod(F.xxhash64("block", "pos"), F.lit(n_groups)).cast("int"))
    spark = blocks.sparkSession
    path = scratch_path(spark, "anchors")
    anchors.write.partitionBy("group").parquet(path)
    return spark.read.schema(anchors.schema).parquet(path), list(range(n_groups)) if n else []


OUTPUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine_hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """The best-scored rows of other labels near each positive of each anchor.

    ``anchor`` is a condition on ``rows``. A score is the inner product of vectors of ``floor(scale * x)``. Positives
    of an anchor are its ``positives`` best other rows of its label; negatives of a positive are the ``negatives``
    best rows of other labels with ``low * p <= 100 * score <= high * p``, ``p`` being the positive's score. Equal
    scores go by id, null ids last. Returns ``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``.

    Rows with a null label or vector, or a null or non-finite component, take no part. Ids and labels are whole
    numbers. Repeated rows, also of one id, are rows of their own; a row is not its own positive. Shorter vectors end
    in zeros, empty ones score 0. Components so large that scores leave 64 bits are an error. An empty table gives an
    empty one; other columns are ignored.

    All rows are compared with all anchors, of which a bounded group is sent to the tasks at a time. A task keeps the
    best few of each anchor and hands on only those; what it has found so far narrows the window of what follows.
    """
    spark: SparkSession = rows.sparkSession
    vector = F.col(vector_col)
    infinite = F.lit(float("inf"))
    valid = rows.where(
        F.col(label_col).isNotNull()
        & vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    ).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        vector.alias("vector"),
    )
    dims = valid.select(F.max(F.size("vector"))).first()[0]
    if not dims:
        # Without components there is nothing to compare but zeros; one component of zero stands for them.
        if dims is None:
            return spark.createDataFrame([], OUTPUT)
        dims = 1
    sample = valid.select("vector", F.xxhash64("vector", "id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("vector").toArrow()
    references = choose_references(quantised(sample.column("vector").combine_chunks(), dims, scale), REFERENCES)
    blocks = _pack_blocks(valid, dims, references, scale)
    anchors, groups = _write_anchors(blocks, dims, group_bytes)
    if not groups:
        return spark.createDataFrame([], OUTPUT)
    scanned = blocks.select("block", "n", "ids", "labels", "q", "norms", "angles")

    def each_group(label: str, per_anchor: int, load: Callable[[int], Anchors], find: Callable) -> DataFrame:
        # One group after the other, so that the driver and the tasks hold one at a time.
        path = scratch_path(spark, label)
        for g in groups:
            shared = spark.sparkContext.broadcast(load(g))
            found = _scan(scanned, shared, find, per_anchor)
            found.write.mode("append").parquet(path)
            shared.destroy()
        return spark.read.schema(found.schema).parquet(path)

    def load(group: int) -> Anchors:
        return _table_of_anchors(anchors.where(F.col("group") == group).drop("group").toArrow(), dims)

    found = _first(each_group("near-positives", 1, load, lambda a: _find_positives(a, positives)), positives)
    group_of = F.pmod(F.xxhash64("block", "pos"), F.lit(len(groups))).cast("int")
    positive = found.select("block", "pos", F.col("rank").alias("place"), "id", "score", group_of.alias("group"))
    path = scratch_path(spark, "positives")
    positive.write.partitionBy("group").parquet(path)
    positive = spark.read.schema(positive.schema).parquet(path)

    def load_with_positives(group: int) -> Anchors:
        mine = load(group)
        scores = np.full((len(mine.ids), positives), _NO_SCORE, np.int64)
        row_of = {key: i for i, key in enumerate(zip(mine.block.tolist(), mine.pos.tolist()))}
        for block, pos, place, score in positive.where(F.col("group") == group).select("block", "pos", "place", "score").collect():
            scores[row_of[block, pos], place - 1] = score
        mine.positive_scores = scores
        return mine

    def negatives_of(a: Anchors) -> tuple[Best, Callable[[_Block], None]]:
        return _find_negatives(a, negatives, low, high)

    chosen = _first(each_group("near-negatives", positives, load_with_positives, negatives_of), negatives)
    named = chosen.select("block", "pos", (F.col("slot") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    about = positive.select("block", "pos", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    who = anchors.select("block", "pos", F.col("id").alias("anchor_id"))
    return (
        named.join(about, ["block", "pos", "place"])
        .join(who, ["block", "pos"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
