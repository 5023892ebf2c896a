"""Byte-pair encoding and decoding with a given vocabulary."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from lexigraft.llm.common import Memory, blocks_by_length, list_offsets, map_batches

#: White space of Unicode. Fixed values.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Chunks a task remembers in each of two halves, and half as many words. About 200 bytes each.
REMEMBERED = 300_000
#: Characters of text that are encoded before their ids leave the task.
BLOCK_CHARS = 4 << 20


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    return table | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


@dataclass
class BpeModel:
    """What a tokenizer file says: ids of pieces, merges as (rank, id) by pair of ids, word pattern, special tokens."""

    vocab: dict[str, int]
    pairs: dict[int, tuple[int, int]]
    pattern: str
    word_end: str
    special: dict[str, int]
    lowercase: bool
    strings: list[str] = field(default_factory=list)

    def __post_init__(self):
        size = max([*self.vocab.values(), *self.special.values()], default=-1) + 1
        self.strings = [""] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = token

    @classmethod
    def load(cls, path: str) -> BpeModel:
        """Reads a tokenizer file (JSON, model type BPE, byte level after one split pattern)."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        split = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or len(split) != 1 or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path}: only word-end BPE files with NFC, spaces and lower case are known")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = model["vocab"]
        return cls(
            ids,
            {ids[a] << 32 | ids[b]: (k, ids[a + b]) for k, (a, b) in enumerate(merges)},
            split[0],
            model["end_of_word_suffix"] or "",
            {t["content"]: t["id"] for t in spec["added_tokens"]},
            True,
        )


def merge_word(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Applies the merges to one word, lowest rank first and from the left among equals.

    ``pairs`` gives (rank, merged symbol) for ``left << 32 | right``. Candidate pairs wait in a
    heap by rank and position; the symbols form a doubly linked list. An entry whose pair has
    changed since it was pushed is stale and skipped.
    """
    n = len(symbols)
    get = pairs.get
    heap = []
    for i in range(n - 1):
        found = get(symbols[i] << 32 | symbols[i + 1])
        if found:
            heap.append(found[0] << 32 | i)
    if not heap:
        return symbols
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    symbols, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    while heap:
        entry = pop(heap)
        i = entry & 0xFFFFFFFF
        left, j = symbols[i], after[i]
        if left < 0 or j < 0:
            continue
        found = get(left << 32 | symbols[j])
        if not found or found[0] != entry >> 32:
            continue
        symbols[i], symbols[j] = merged, _ = found[1], -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            found = get(merged << 32 | symbols[k])
            if found:
                push(heap, found[0] << 32 | i)
        k = before[i]
        if k >= 0:
            found = get(symbols[k] << 32 | merged)
            if found:
                push(heap, found[0] << 32 | k)
    return [s for s in symbols if s >= 0]


class Encoder:
    """Encodes texts with a model; remembers chunks between white space and words within them."""

    def __init__(self, model: BpeModel, remembered: int = REMEMBERED):
        self.model = model
        shown = byte_characters()
        #: Ids of single bytes inside and at the end of a word; bytes without a piece are left out, as there is no unknown piece.
        self._inner = [model.vocab.get(shown[b]) for b in range(256)]
        self._last = [model.vocab.get(shown[b] + model.word_end) for b in range(256)]
        # The pattern's own class for white space is spelled out: engines differ on control characters.
        self._words = regex.compile(model.pattern.replace("[^\\s", f"[^{SPACES}"))
        self._spaces = re.compile(f"[{SPACES}]+")
        self._special = re.compile("|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) or "(?!)")
        self._word_ids = Memory(self._encode_word, remembered // 2)
        self._chunk_ids = Memory(self._encode_chunk, remembered)

    def _encode_word(self, word: str) -> bytes:
        data = word.encode("utf-8")
        inner, last = self._inner, self._last[data[-1]]
        symbols = [inner[b] for b in data[:-1]]
        symbols.append(last)
        return array("i", merge_word([s for s in symbols if s is not None], self.model.pairs)).tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        words = self._words.findall(chunk.lower())
        if len(words) == 1:
            return self._word_ids[words[0]]
        return b"".join([self._word_ids[word] for word in words])

    def _encode_plain(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            chunks = filter(None, self._spaces.split(text))
        else:
            chunks = text.split()
        memory = self._chunk_ids
        return b"".join([memory[chunk] for chunk in chunks])

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as native 32-bit integers."""
        if not text:
            return b""
        if "<" not in text or not self._special.search(text):
            return self._encode_plain(text)
        parts, at = [], 0
        for m in self._special.finditer(text):
            parts += [self._encode_plain(text[at : m.start()]), array("i", [self.model.special[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*parts, self._encode_plain(text[at:])])

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_packed(text)).tolist()


def decode(ids: pa.ListArray, strings: pa.Array) -> pa.Array:
    """The pieces' strings one after the other; a file without decoder puts a space between them."""
    pieces = pa.ListArray.from_arrays(ids.offsets, strings.take(ids.values.cast(pa.int32())))
    return pc.binary_join(pieces, " ")


def encode_texts(docs: DataFrame, model: BpeModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: ``(id_col, ids ARRAY<INT>)``.

    A row for every input row, in any order; null and empty texts have no ids; repeated rows and
    null ids are encoded like all others; other columns are ignored. The model is broadcast: it is
    as large as the vocabulary file. Words are encoded once and remembered in the task, in a bounded memory.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def make():
        encoder = Encoder(shared.value)

        def work(batch: pa.RecordBatch):
            for part in blocks_by_length(batch, 1, BLOCK_CHARS):
                packed = [encoder.encode_packed(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
                yield {id_col: part.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets), ids)}

        return work

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, model: BpeModel, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded`` to ``(id_col, ids)``; null ids give an empty string, an id outside the vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kind = dict(encoded.dtypes)[id_col]

    def make():
        strings = pa.array(shared.value.strings)

        def work(batch: pa.RecordBatch):
            for part in blocks_by_length(batch, 1, BLOCK_CHARS // 4):
                ids = pc.fill_null(part.column(1), pa.scalar([], part.column(1).type))
                flat = pa.ListArray.from_arrays(list_offsets(ids), ids.flatten())
                yield {id_col: part.column(0), "ids": flat, "decoded": decode(flat, strings)}

        return work

    return map_batches(encoded.select(id_col, "ids"), make, f"`{id_col}` {kind}, ids array<int>, decoded string")
