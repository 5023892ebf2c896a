"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit of the remainder.

The packing depends only on how many pieces have each length. Tasks encode and count; the driver packs the table of
lengths, which has at most ``capacity`` rows whatever the corpus; then every piece finds its place from its length
and its number among the pieces of that length. No piece, and no list of pieces, is ever on the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraft.llm.bpe import byte_characters
from lexigraft.llm.common import blocks_by_length, sized
from lexigraft.session import materialize, scratch_path

CAPACITY = 2048
#: The id after every document.
END_ID = 0
#: Bytes of text that are encoded before their pieces leave the task.
BLOCK_BYTES = 2 << 20
#: Texts beyond this many characters take the slower of the two equal encoders, which has no depth limit.
LONG_TEXT = 200_000

#: A pattern of bins: how many there are, and the (length, number) of the pieces in each, in their order.
Group = tuple[int, list[tuple[int, int]]]


# Packing a table of lengths


def _dominant(count: np.ndarray, j: int, capacity: int) -> list[int] | None:
    """A bin for one piece of length ``j`` that some optimal packing has, or None if none is found.

    A set dominates another one if the other's members can be dealt to its members so that each holds what it is
    dealt. If one set with ``j`` dominates all others with ``j``, an optimal packing has it: swapping members never
    needs another bin. Looked for are sets of at most three, where at most two further pieces fit beside ``j``, and
    pairs that fill the bin.
    """
    count = count.copy()
    count[j] -= 1
    room = capacity - j
    present = np.flatnonzero(count)
    smallest = np.repeat(present[:3], np.minimum(count[present[:3]], 3))[:3]
    fitting = int(np.count_nonzero(np.cumsum(smallest) <= room))
    if fitting == 0:
        return [j]
    best = int(present[np.searchsorted(present, room, side="right") - 1])
    if fitting == 1 or best == room:
        return [j, best]
    if fitting > 2:
        return None
    # At most two pieces fit beside j: the fullest pair decides.
    firsts = present[present < room]
    partners = np.searchsorted(present, room - firsts, side="right") - 1
    seconds = np.where(partners >= 0, present[np.maximum(partners, 0)], 0)
    alone = (seconds == firsts) & (count[firsts] < 2)
    below = np.where(partners > 0, present[np.maximum(partners - 1, 0)], 0)
    seconds = np.where(alone, below, seconds)
    sums = np.where(seconds > 0, firsts + seconds, 0)
    fullest = int(sums.max(initial=0))
    if best >= fullest:
        return [j, best]
    second = fullest - best
    if second <= 0 or count[second] < 1 + (second == best):
        return None
    # {j, best, second} dominates if no two pieces longer than the second fit beside j.
    longer = present[present > second][:2]
    pair = np.repeat(longer, np.minimum(count[longer], 2))[:2]
    if len(pair) < 2 or int(pair.sum()) > room:
        return [j, best, second]
    return None


def reduce_lengths(count: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Fixes dominant sets, the longest piece first, until none is found; ``count`` by length is lowered in place.

    What is dominant depends on a length only by whether there are none, one, two or at least three pieces of it.
    So a set is fixed at once as often as at least three pieces of each of its lengths are left.
    """
    groups: list[Group] = []
    found = True
    while found:
        found = False
        for j in range(capacity, 0, -1):
            while count[j]:
                chosen = _dominant(count, j, capacity)
                if chosen is None:
                    break
                need = {length: chosen.count(length) for length in chosen}
                times = max(1, min((int(count[length]) - 3) // n for length, n in need.items()))
                for length, n in need.items():
                    count[length] -= n * times
                groups.append((times, list(need.items())))
                found = True
    return groups


def best_fit(count: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Best fit, longest pieces first, over a table of lengths: each piece goes where it leaves the least room.

    Bins with the same content are one group, so the work depends on the number of lengths, not of pieces.
    """
    by_room: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]
    used = np.zeros(capacity + 1, bool)

    def put(room: int, bins: int, content: tuple) -> None:
        if bins:
            by_room[room].append((bins, content))
            used[room] = True

    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            rooms = np.flatnonzero(used[length:])
            if len(rooms):
                room = length + int(rooms[0])
                bins, content = by_room[room].pop()
                used[room] = bool(by_room[room])
            else:
                room, bins, content = capacity, left, ()
            # A bin with the least room takes pieces of this length as long as they fit.
            each = room // length
            full = min(bins, left // each)
            put(room - each * length, full, (*content, (length, each)))
            left -= full * each
            if full < bins:
                part = min(left, each - 1) if left < each else 0
                if part:
                    put(room - part * length, 1, (*content, (length, part)))
                    left -= part
                if content:
                    put(room, bins - full - bool(part), content)
    return [(bins, list(content)) for groups in by_room for bins, content in groups]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Bins for so many pieces of each length: the dominant ones, then the best fit of the rest."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    return reduce_lengths(count, capacity) + best_fit(count, capacity)


# Encoding


class PieceEncoder:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file without other steps.

    Where the file's ids follow its merges, as in all files of this kind, the faster of two installed encoders is
    used. The two agree on every code point (tried one by one); very long texts go to the library itself.
    """

    #: Split pattern of byte-level files. Fixed value.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_str(spec)
        self._exact.no_truncation()
        self._exact.no_padding()
        self._fast = self._fast_encoder(json.loads(spec))

    def _fast_encoder(self, spec: dict):
        model, split = spec["model"], spec["pre_tokenizer"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = (
            spec.get("normalizer") is None
            and split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not model.get("ignore_merges") and all(t["special"] and not t["normalized"] for t in spec["added_tokens"])
        )
        base = len(vocab) - len(merges) - len([t for t in spec["added_tokens"] if t["content"] in vocab])
        if not plain or any(vocab.get(a + b) != base + k for k, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in byte_characters().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self._fast is not None and len(text) <= LONG_TEXT:
            return self._fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)


def cut_lengths(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of pieces of documents of ``n`` ids, and the length of the first; all others are full."""
    pieces = -(-n // capacity)
    return pieces, n - (pieces - 1) * capacity


PIECES = "piece int, start bigint, length int, ids binary, _part int, _rank bigint"


def _encode_pieces(docs: DataFrame, spec: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of all documents; ``_rank`` numbers those of one length within the task ``_part``."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = dict(docs.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(shared.value)
        end = np.array([end_id], np.uint32)
        seen = np.zeros(capacity + 1, np.int64)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        for batch in batches:
            for block in blocks_by_length(batch, 1, BLOCK_BYTES):
                ids, sizes = [], []
                for text in block.column(1).to_pylist():
                    found = encoder.encode(text)
                    ids += [found, end]
                    sizes.append(len(found) + 1)
                n, first = cut_lengths(np.array(sizes, np.int64), capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                runs = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + seen[length[order]]
                seen += runs
                flat = np.concatenate(ids).astype("<u4").tobytes()
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                blobs = pa.Array.from_buffers(
                    pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column(0).take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length.astype(np.int32)),
                        blobs,
                        pa.array(np.full(len(doc), part, np.int32)),
                        pa.array(rank),
                    ],
                    names=["_id", "piece", "start", "length", "ids", "_part", "_rank"],
                )

    return docs.mapInArrow(run, f"_id {kind}, {PIECES}")


def _slots(groups: list[Group]) -> list[tuple]:
    """``(length, slots)``: where the pieces of each length go, by their number."""
    by_length: dict[int, list[tuple]] = {}
    next_rank: dict[int, int] = {}
    base = 0
    for bins, content in groups:
        offset = 0
        for length, each in content:
            first = next_rank.get(length, 0)
            next_rank[length] = first + bins * each
            by_length.setdefault(length, []).append((first, each, base, offset))
            offset += length * each
        base += bins
    return sorted(by_length.items())


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packs all documents into few sequences of at most ``capacity`` ids.

    A document is its ids by the tokenizer file ``tokenizer`` (byte-level BPE), then ``end_id``. Longer ones are cut
    into pieces of ``capacity`` ids, the first of which takes what is over. Returns a row per piece, in any order:
    ``(id_col, piece INT, start BIGINT, length INT, ids BINARY, sequence_id BIGINT, offset BIGINT)``; ``ids`` are
    little-endian unsigned 32-bit integers, ``start`` counts the document's ids before the piece, ``offset`` those
    before it in its sequence, which has no gaps.

    Null and empty texts have the end id alone. Repeated rows and null ids are packed each for itself, documents of
    equal length in no particular order. An empty table gives an empty one; other columns are ignored.

    Pieces are written once (encoding is the dear part); one narrow shuffle counts them by task and length.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    encoded = _encode_pieces(source, spec, capacity, end_id)
    path = scratch_path(spark, "pieces")
    encoded.write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(encoded.schema).parquet(path)

    counts = materialize(pieces.groupBy("_part", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        _slots(pack_lengths(totals, capacity)),
        "length int, slots array<struct<first: bigint, each: bigint, base: bigint, offset: bigint>>",
    )
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = materialize(
        counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_earlier")), "earlier"
    )
    # At most a row per task and length; beyond the size limit it is joined by shuffle.
    numbered = pieces.join(sized(earlier, 24), ["_part", "length"]).join(F.broadcast(slots), "length")
    rank = F.col("_earlier") + F.col("_rank")
    slot = F.element_at("slots", F.size(F.filter("slots", lambda s: s["first"] <= rank)))
    placed = numbered.withColumn("_slot", slot).withColumn("_in", rank - F.col("_slot.first"))
    each = F.col("_slot.each")
    return placed.select(
        F.col("_id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids",
        (F.col("_slot.base") + F.floor(F.col("_in") / each)).cast("long").alias("sequence_id"),
        (F.col("_slot.offset") + F.pmod("_in", each) * F.col("length")).cast("long").alias("offset"),
    )
