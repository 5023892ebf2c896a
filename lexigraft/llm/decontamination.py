"""Benchmark items inside documents: size-partitioned MinHash containment search, exactly verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.llm.common import blocks_by_length, map_batches
from lexigraft.llm.shingles import shingle_hashes, shingle_set, word_hashes, words_lower
from lexigraft.session import materialize

SHINGLE, THRESHOLD = 5, 0.75
#: Items that one pass over the documents looks for, and bytes of their texts.
BLOCK_ITEMS, BLOCK_BYTES = 100_000, 64 << 20


@dataclass
class Partition:
    """Items of similar size with their MinHash signatures.

    ``bands`` hash values are kept of every item, a band each: its smallest ones. An item has at most
    ``largest`` shingles, so a document that holds the threshold of them misses fewer than ``bands`` of any
    choice, and holds at least one of the signature's values: no candidate is lost.
    """

    smallest: int
    largest: int
    bands: int
    keys: np.ndarray
    items: np.ndarray


class ItemIndex:
    """The items of one block: partitions by size, full shingle sets for the exact check."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float = THRESHOLD, k: int = SHINGLE):
        words = [words_lower(t) for t in texts]
        self.ids, self.k = ids, k
        self.sets = [shingle_set(w, k) for w in words]
        self.need = [ceil(round(threshold * len(s), 9)) for s in self.sets]
        hashes = [np.unique(shingle_hashes(word_hashes(w), k)) for w in words]
        by_size: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            if len(h):
                by_size.setdefault(len(h).bit_length(), []).append(i)
        self.partitions = []
        for members in by_size.values():
            sizes = [len(hashes[i]) for i in members]
            bands = max(n - ceil(round(threshold * n, 9)) + 1 for n in sizes)
            keys = np.concatenate([hashes[i][:bands] for i in members])
            items = np.repeat(members, [min(bands, n) for n in sizes])
            order = np.argsort(keys, kind="stable")
            least = min(self.need[i] for i in members)
            self.partitions.append(Partition(least, max(sizes), bands, keys[order], items[order]))

    def candidates(self, hashes: np.ndarray) -> Iterator[int]:
        """Items of which the document holds a value of the signature and that are not too large for it."""
        for p in self.partitions:
            if len(hashes) < p.smallest:
                continue
            at = np.searchsorted(p.keys, hashes)
            at[at == len(p.keys)] = 0
            found = hashes[p.keys[at] == hashes]
            if len(found):
                low, high = np.searchsorted(p.keys, found, "left"), np.searchsorted(p.keys, found, "right")
                yield from np.unique(np.concatenate([p.items[a:b] for a, b in zip(low, high, strict=True)])).tolist()

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(item, number of its shingles in the document) of all items that reach the threshold."""
        hashes = np.unique(shingle_hashes(word_hashes(words), self.k))
        found, own = [], None
        for i in self.candidates(hashes):
            if own is None:
                own = shingle_set(words, self.k)
            shared = len(self.sets[i] & own)
            if shared >= self.need[i]:
                found.append((i, shared))
        return found


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All pairs of a document and an item of which it holds at least ``threshold`` of the word shingles.

    Returns ``(id_col, item_id, n_shared, n_item_shingles, containment)``. Words are lower-cased (A-Z); an
    item with fewer than five words is one shingle. Items without words match nothing, like documents
    without words; repeated rows give the same pair once; null ids are kept and extra columns ignored. The items are the
    queries: they are dealt into blocks of about ``block_items`` items and ``block_bytes`` bytes at most (a longer
    item goes beyond it), every block is broadcast and looked for in all documents, whole. Documents are not shuffled.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id_col]
    queries = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text")).distinct()
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()
    n_blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n_blocks)))
    if n_blocks > 1:
        blocked = materialize(blocked, "items")
    schema = f"`{id_col}` {kind}, item_id {item_kind}, n_shared bigint, n_item_shingles bigint, containment double"

    def one_block(b: int) -> DataFrame:
        rows = blocked.where(F.col("block") == b).select("item_id", "item_text").toArrow()
        block = spark.sparkContext.broadcast((rows.column(0).to_pylist(), rows.column(1).to_pylist()))

        def make():
            index = ItemIndex(*block.value, threshold)

            def work(batch: pa.RecordBatch):
                for part in blocks_by_length(batch, 1, 4 << 20):
                    pairs = [
                        (d, i, shared)
                        for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                        for i, shared in index.matches(words_lower(text))
                    ]
                    sizes = [len(index.sets[i]) for _, i, _ in pairs]
                    yield {
                        id_col: [d for d, _, _ in pairs],
                        "item_id": [index.ids[i] for _, i, _ in pairs],
                        "n_shared": [s for _, _, s in pairs],
                        "n_item_shingles": sizes,
                        "containment": [s / z for (_, _, s), z in zip(pairs, sizes, strict=True)],
                    }

            return work

        return map_batches(docs.select(id_col, text_col), make, schema)

    found = one_block(0)
    for b in range(1, n_blocks):
        found = found.unionByName(one_block(b))
    return found.distinct()
