"""Long repeats in a corpus: enhanced suffix arrays over sampled suffixes, scanned for maximal repeat groups.

A position is sampled if its k-gram has the smallest hash of some window of ``min_bytes`` bytes (the leftmost one
of equals). Equal windows sample the same place, so two occurrences of a repeat of ``min_bytes`` bytes or more
always meet under the key of a k-gram inside. The windows that sample one place are a run of starts. Runs of
equal bytes are equal throughout and are settled by their digests; for the others the bytes are fetched, and the
suffixes from the sampled place are sorted, their common prefixes scanned with a stack for intervals, and every
interval split by its left extensions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraft.llm.common import blocks_by_length, map_batches
from lexigraft.llm.shingles import mix
from lexigraft.session import materialize

MIN_BYTES, GRAM = 100, 32
#: The largest ``min_bytes``: lengths of runs and places in them are held in a byte.
MOST_BYTES = 255
#: Bytes hashed at a time, text of a task that is gathered before it is dealt, and bytes per task after dealing.
PIECE, BLOCK, TASK_BYTES = 1 << 19, 32 << 20, 24 << 20
#: A key with more different runs than this is replaced by the keys of its single windows.
MOST_RUNS = 1000
NULL_ID = (1 << 63) - 1

ITEM = np.dtype(
    [("key", "u8"), ("run_hash", "u8"), ("d", "i8"), ("tie", "i8"), ("lo", "u4"), ("run", "u1"), ("at", "u1")]
)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, and powers of an odd number and of its inverse modulo 2^64."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    n = PIECE + 2 * MOST_BYTES

    def powers(x: int) -> np.ndarray:
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return values, powers(base), powers(inverse)


def _grams(values: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes, from those of half the length."""
    h, size = values, 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0xA0761D6478BD642F) + h[size:]
        h ^= h >> np.uint64(32)
        size *= 2
    return h


def sample_runs(data: bytes, min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """Sampled places of a text: (key, digest of the run, first window start, number of windows, place in the run)."""
    table, power, inverse = _tables()
    width = min_bytes - GRAM + 1
    out = []
    for start in range(0, max(len(data) - min_bytes + 1, 0), PIECE):
        part = np.frombuffer(data, np.uint8, min(PIECE + min_bytes - 1, len(data) - start), start)
        values = table[part]
        grams = _grams(values)
        order = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            order = np.minimum(order[:-size], order[size:])
            size *= 2
        if width > size:
            order = np.minimum(order[: len(order) - (width - size)], order[width - size :])
        place = (order & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        run = np.diff(np.append(first, len(place)))
        place = place[first]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(values)], dtype=np.uint64)])
        ends = first + run + min_bytes - 1
        digest = mix((sums[ends] - sums[first]) * inverse[first] + run.astype(np.uint64))
        out.append((mix(grams[place]), digest, first + start, run, place - first))
    if not out:
        return tuple(np.zeros(0, t) for t in ("u8", "u8", "i8", "i8", "i8"))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_digests(data: bytes, lo: int, run: int, min_bytes: int) -> np.ndarray:
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(data[p : p + min_bytes]) for p in range(lo, lo + run)), np.uint64, run
    )


def as_windows(items: np.ndarray, chosen: np.ndarray, texts: dict, min_bytes: int) -> np.ndarray:
    """Replaces the chosen items by one item for each of their windows, under the window's own digest."""
    parts = [items[~chosen]]
    for x in items[chosen]:
        keys = window_digests(texts[int(x["d"]), int(x["tie"])], int(x["lo"]), int(x["run"]), min_bytes)
        more = np.zeros(len(keys), ITEM)
        more["key"], more["run_hash"] = keys, mix(keys)
        more["d"], more["tie"], more["run"] = x["d"], x["tie"], 1
        more["lo"] = np.arange(len(keys), dtype=np.uint32) + x["lo"]
        parts.append(more)
    return np.concatenate(parts)


def settle(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Splits items into the earliest one of every run (by id, tie, start) and the later ones with equal bytes."""
    items = items[np.lexsort((items["lo"], items["tie"], items["d"], items["run_hash"], items["key"]))]
    same = np.zeros(len(items), bool)
    same[1:] = (items["key"][1:] == items["key"][:-1]) & (items["run_hash"][1:] == items["run_hash"][:-1])
    # A repeated input row gives the same place twice; that is no later occurrence.
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(items))))
    here = np.ones(len(items), bool)
    for name in ("d", "tie", "lo"):
        here &= items[name] == items[name][first]
    return items[~same], items[same & ~here]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def prefix_intervals(texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """Intervals (first, last, length) of sorted texts with a common prefix of that length and no longer one.

    One scan over the common prefixes of neighbours with a stack of open intervals; children come before
    parents. Equal neighbours are an interval of their whole length.
    """
    stack: list[list[int]] = []  # [length, first]
    for i in range(1, len(texts) + 1):
        length = common_prefix(texts[i - 1], texts[i]) if i < len(texts) else 0
        first = i - 1
        while stack and stack[-1][0] > length:
            own, first = stack.pop()
            yield first, i - 1, own
        if length and (not stack or stack[-1][0] < length):
            stack.append([length, first])


def maximal_repeats(
    occurrences: list[tuple[bytes, bytes]], min_bytes: int = MIN_BYTES
) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeat groups around one sampled place: (bytes before it, bytes from it on, all occurrences).

    ``occurrences`` are (reversed bytes before the place, bytes from it on). The right sides form the suffix
    array; every interval of it is split by the intervals of its left sides. A group is left out if all its
    occurrences go on alike to the right, because a deeper interval then has it.
    """
    order = sorted(range(len(occurrences)), key=lambda i: occurrences[i][1])
    for first, last, right in prefix_intervals([occurrences[i][1] for i in order]):
        if right + max(len(occurrences[i][0]) for i in order[first : last + 1]) < min_bytes:
            continue
        members = sorted(order[first : last + 1], key=lambda i: occurrences[i][0])
        lefts = [occurrences[i][0] for i in members]
        # A left side without bytes in common is an interval too.
        intervals = [*prefix_intervals(lefts), (0, len(lefts) - 1, 0)]
        for a, b, left in intervals:
            if left + right < min_bytes:
                continue
            group = members[a : b + 1]
            ahead = {occurrences[i][1][right : right + 1] for i in group}
            if len(ahead) > 1 or ahead == {b""}:
                yield left, right, group


def _spark_tasks(spark, size: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _with_place(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, d, tie, text)``: ``d`` orders documents, null ids last; ``tie``, a 64-bit digest, tells texts under
    one id apart, as all those without an id are."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"ids must be whole numbers, {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d"),
        F.xxhash64(text_col).alias("tie"),
        F.col(text_col).alias("text"),
    )


def _items(block: pa.RecordBatch, min_bytes: int) -> tuple[np.ndarray, dict]:
    """Items of the texts of ``(d, tie, text)`` and the texts by place."""
    parts, texts = [np.zeros(0, ITEM)], {}
    for d, tie, text in zip(*(block.column(c).to_pylist() for c in range(3)), strict=True):
        data = (text or "").encode("utf-8")
        if len(data) < min_bytes:
            continue
        key, digest, lo, run, at = sample_runs(data, min_bytes)
        x = np.zeros(len(key), ITEM)
        x["key"], x["run_hash"], x["lo"], x["run"], x["at"], x["d"], x["tie"] = key, digest, lo, run, at, d, tie
        parts.append(x)
        texts[d, tie] = data
    return np.concatenate(parts), texts


def crowded_keys(placed: DataFrame, min_bytes: int, sample_docs: int = 4000) -> np.ndarray:
    """Keys with different runs in a large share of documents, from a bounded sample.

    Only where rows go depends on it: a key that is not found here is split later, when it is counted.
    """
    n = placed.count()
    part = placed if n <= sample_docs else placed.sample(min(1.0, sample_docs / n), seed=7)

    def make():
        def work(batch: pa.RecordBatch):
            for block in blocks_by_length(batch, 2, BLOCK):
                items, _ = _items(block, min_bytes)
                pairs = np.unique(items[["key", "run_hash"]])
                yield {"key": pairs["key"].view(np.int64), "run_hash": pairs["run_hash"].view(np.int64)}

        return work

    found = map_batches(part.select("d", "tie", "text"), make, "key bigint, run_hash bigint").distinct()
    keys = found.groupBy("key").count().where(F.col("count") > sample_docs // 100).select("key")
    # Fewer than (runs in the sample) / (sample_docs / 100) of them.
    return np.sort(np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64))


def _packed(items: np.ndarray) -> bytes:
    """Column after column: values of one kind compress well."""
    return b"".join(np.ascontiguousarray(items[n]).tobytes() for n in ITEM.names)


def _unpacked(data: bytes) -> np.ndarray:
    n, at = len(data) // ITEM.itemsize, 0
    items = np.zeros(n, ITEM)
    for name in ITEM.names:
        items[name] = np.frombuffer(data, ITEM[name], n, at)
        at += n * ITEM[name].itemsize
    return items


def _deal_items(placed: DataFrame, crowded: np.ndarray, buckets: int, min_bytes: int) -> DataFrame:
    """``(bucket, data)``: packed items by key; later equal runs of the same block as spans, under bucket -1 and below."""

    def make():
        def work(batch: pa.RecordBatch):
            for block in blocks_by_length(batch, 2, BLOCK):
                items, texts = _items(block, min_bytes)
                if len(crowded) and len(items):
                    items = as_windows(items, np.isin(items["key"], crowded), texts, min_bytes)
                items, later = settle(items)
                bucket = (items["key"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                items, bucket = items[order], bucket[order]
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                names = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                data = [_packed(items[edges[b] : edges[b + 1]]) for b in names]
                for k, start in enumerate(range(0, len(later), 1 << 16)):
                    names.append(-1 - (int(later["key"][0]) + k) % buckets)
                    data.append(_packed(later[start : start + (1 << 16)]))
                yield {"bucket": names, "data": data}

        return work

    return map_batches(placed.select("d", "tie", "text"), make, "bucket int, data binary")


RESOLVED = "kind int, key bigint, d bigint, tie bigint, lo bigint, run int, at int, windows boolean"
SPAN, WANTED = 0, 1


def _resolved_batch(kind: int, items: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    n = len(items)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, kind, np.int32)),
            pa.array(np.ascontiguousarray(items["key"]).view(np.int64)),
            pa.array(np.ascontiguousarray(items["d"])),
            pa.array(np.ascontiguousarray(items["tie"])),
            pa.array(items["lo"].astype(np.int64)),
            pa.array(items["run"].astype(np.int32)),
            pa.array(items["at"].astype(np.int32)),
            pa.array(windows),
        ],
        [x.split()[0] for x in RESOLVED.split(", ")],
    )


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles equal runs of all blocks; keys that still have several different runs are wanted with their bytes."""
    parts = [np.zeros(0, ITEM)]
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket < 0:
                items = _unpacked(data)
                yield _resolved_batch(SPAN, items, np.zeros(len(items), bool))
            else:
                parts.append(_unpacked(data))
    items, later = settle(np.concatenate(parts))
    yield _resolved_batch(SPAN, later, np.zeros(len(later), bool))
    if len(items):
        first = np.flatnonzero(np.concatenate([[True], items["key"][1:] != items["key"][:-1]]))
        count = np.repeat(np.diff(np.append(first, len(items))), np.diff(np.append(first, len(items))))
        yield _resolved_batch(WANTED, items[count > 1], (count > MOST_RUNS)[count > 1])


CONTEXTS = "key bigint, d bigint, tie bigint, lo bigint, run int, at int, bytes binary"


def _contexts(wanted: DataFrame, min_bytes: int) -> DataFrame:
    """Bytes of wanted runs from ``(d, tie, text, wanted)``; a null ``bytes`` marks a span that is settled already."""

    def make():
        def work(batch: pa.RecordBatch):
            for block in blocks_by_length(batch, 2, BLOCK // 4):
                out: dict = {x.split()[0]: [] for x in CONTEXTS.split(", ")}
                split, texts = [np.zeros(0, ITEM)], {}

                def put(key, d, tie, lo, run, at, data, out=out):
                    for name, value in zip(out, (key, d, tie, lo, run, at, data), strict=True):
                        out[name].append(value)

                for d, tie, text, runs in zip(*(block.column(c).to_pylist() for c in range(4)), strict=True):
                    data = text.encode("utf-8")
                    for r in runs:
                        lo, run = r["lo"], r["run"]
                        if r["windows"]:
                            x = np.zeros(1, ITEM)
                            x["d"], x["tie"], x["lo"], x["run"] = d, tie, lo, run
                            split.append(x)
                            texts[d, tie] = data
                        else:
                            put(r["key"], d, tie, lo, run, r["at"], data[lo : lo + run + min_bytes - 1])
                items = np.concatenate(split)
                if len(items):
                    items, later = settle(as_windows(items, np.ones(len(items), bool), texts, min_bytes))
                    for x in items:
                        lo, key = int(x["lo"]), int(x["key"].astype(np.int64))
                        data = texts[int(x["d"]), int(x["tie"])]
                        put(key, int(x["d"]), int(x["tie"]), lo, 1, 0, data[lo : lo + min_bytes])
                    for x in later:
                        put(int(x["key"].astype(np.int64)), int(x["d"]), int(x["tie"]), int(x["lo"]), 1, 0, None)
                yield out

        return work

    return map_batches(wanted.select("d", "tie", "text", "wanted"), make, CONTEXTS)


GROUPS = "group_id string, length int, d bigint, tie bigint, start bigint, is_first boolean"


def _groups(min_bytes: int):
    """Maximal repeat groups of the contexts of a task, all occurrences of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key: dict[int, dict] = defaultdict(dict)
        rows: list[tuple] = []
        names = [x.split()[0] for x in GROUPS.split(", ")]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for key, d, tie, lo, n, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None:
                    rows.append((f"{key:x}", min_bytes, d, tie, lo, False))
                else:
                    by_key[key][d, tie, lo] = (lo + at, data[:at][::-1], data[at:])
            if len(rows) > 50_000:
                yield flush()
        for key, found in by_key.items():
            places = sorted(found)
            if len(places) < 2:
                continue
            sides = [found[p][1:] for p in places]
            for k, (left, right, group) in enumerate(maximal_repeats(sides, min_bytes)):
                first = min(group)
                for i in group:
                    d, tie, _ = places[i]
                    rows.append((f"{key:x}.{k}", left + right, d, tie, found[places[i]][0] - left, i == first))
            if len(rows) > 50_000:
                yield flush()
        yield flush()

    return run


def repeat_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(d, tie, start, end)``: occurrences of repeats of at least ``min_bytes`` bytes that are not the first one.

    See :func:`without_repeats` for the order and :func:`_with_place` for ``d`` and ``tie``.
    """
    if not GRAM <= min_bytes <= MOST_BYTES:
        raise ValueError(f"min_bytes must be {GRAM} to {MOST_BYTES}")
    spark = docs.sparkSession
    placed = _with_place(docs, id_col, text_col).where(F.octet_length("text") >= min_bytes)
    size = placed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    tasks = _spark_tasks(spark, size)
    dealt = _deal_items(placed, crowded_keys(placed, min_bytes), 4 * tasks, min_bytes)
    resolved = materialize(dealt.repartition(tasks, "bucket").mapInArrow(_resolve, RESOLVED), "runs")
    spans = resolved.where(F.col("kind") == SPAN)
    spans = spans.select("d", "tie", F.col("lo").alias("start"), (F.col("lo") + F.col("run") + min_bytes - 1).alias("end"))
    wanted = resolved.where(F.col("kind") == WANTED)
    n_wanted = wanted.count()
    by_doc = wanted.groupBy("d", "tie").agg(
        F.collect_list(F.struct("key", "lo", "run", "at", "windows")).alias("wanted")
    )
    contexts = _contexts(placed.join(by_doc, ["d", "tie"]), min_bytes)
    # A task gathers about 24 MB of bytes; a key has a bounded number of runs, or one per block.
    parts = _spark_tasks(spark, 200 * n_wanted)
    groups = contexts.repartition(parts, "key").mapInArrow(_groups(min_bytes), GROUPS)
    later = groups.where(~F.col("is_first")).select("d", "tie", "start", (F.col("start") + F.col("length")).alias("end"))
    return spans.unionByName(later)


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as UTF-8 without every byte that a string of ``min_bytes`` bytes covers which also starts earlier.

    Earlier is a smaller document id, or the same document and a smaller start; overlapping occurrences count,
    and strings are judged on the input. Returns ``(doc_id, n_bytes, spans ARRAY<STRUCT<start, end>>, kept BINARY)``
    for every input row; ``kept`` can end inside a character. Ids are whole numbers, others are an error;
    ``min_bytes`` is 32 to 255. Null and empty texts have no bytes. Null ids come last; repeated rows are one document and get the same answer; of different texts under one id one counts as
    earlier, by a hash. Other columns are ignored; an empty table gives no rows.
    """
    spans = repeat_spans(docs, min_bytes, id_col, text_col)
    by_doc = spans.groupBy("d", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    by_doc = materialize(by_doc, "spans")
    joined = _with_place(docs, id_col, text_col).join(by_doc, ["d", "tie"], "left")
    kind = dict(docs.dtypes)[id_col]

    def make():
        def work(batch: pa.RecordBatch):
            for block in blocks_by_length(batch, 1, 8 << 20):
                n_bytes, spans, kept = [], [], []
                for text, found in zip(block.column(1).to_pylist(), block.column(2).to_pylist(), strict=True):
                    data = (text or "").encode("utf-8")
                    merged: list[list[int]] = []
                    for start, end in sorted((x["start"], x["end"]) for x in found or ()):
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(end, merged[-1][1])
                        else:
                            merged.append([start, end])
                    parts, at = [], 0
                    for start, end in merged:
                        parts.append(data[at:start])
                        at = end
                    n_bytes.append(len(data))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                    kept.append(b"".join([*parts, data[at:]]))
                yield {id_col: block.column(0), "n_bytes": n_bytes, "spans": spans, "kept": kept}

        return work

    schema = f"`{id_col}` {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return map_batches(joined.select(F.col("doc_id").alias(id_col), "text", "spans"), make, schema)
