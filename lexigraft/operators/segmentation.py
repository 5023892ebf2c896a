"""Splitting words into vocabulary pieces, and corpora into tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce
from math import ceil
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraft.functions.salting import every_salt, salt_of
from lexigraft.functions.text import BPE_MARK, WORD_MARK, shifted_bytes, split_words
from lexigraft.operators.automaton import Automaton, code_points
from lexigraft.session import DEFAULT_LIMITS, Limits, materialize, per_name

# Names of the unknown piece.
UNKNOWN = ("<unk>", "[UNK]")
SENTENCEPIECE, WORDPIECE, BPE = "sentencepiece", "wordpiece", "bpe"
CONTINUATION = "##"


@cache
def _byte_alphabet() -> dict[int, str]:
    hidden = {b: chr(256 + k) for k, b in enumerate(shifted_bytes())}
    return {b: hidden.get(b, chr(b)) for b in range(256)}


def spell(word: str, family: str) -> str:
    """A word as the pieces of a vocabulary family write it."""
    if family == WORDPIECE:
        return word
    if family == BPE:
        table = _byte_alphabet()
        return BPE_MARK + "".join(table[b] for b in word.encode("utf-8"))
    return WORD_MARK + word

# Characters of distinct words a task remembers, of all languages together, before it starts over.
MEMO_CHARS = 2_000_000
# Characters of words that are searched, or of texts that are split, at a time; one word or text at least.
CHUNK_CHARS = 250_000


@dataclass
class Pieces:
    """Pieces of one vocabulary, or a part of them: an automaton, and by piece number the value to emit and the score."""

    automaton: Automaton
    values: list[Any]
    scores: np.ndarray
    unknown: Any
    worst: float
    family: str = SENTENCEPIECE

    @staticmethod
    def build(
        rows: list[tuple[str, Any, float]], unknown: Any, worst: float | None = None, family: str = SENTENCEPIECE
    ) -> Pieces:
        """``worst``: the lowest score of the vocabulary, where ``rows`` are only some of its pieces."""
        lowest = min((s for _, _, s in rows), default=0.0) if worst is None else worst
        rows = [(t, v, s) for t, v, s in rows if t and v is not None]
        named = [(t, 0, v, s) for t, v, s in rows]
        if family == WORDPIECE:
            # Behind the first character a piece stands without its mark.
            named += [(t[len(CONTINUATION) :], 1, v, s) for t, v, s in rows if t.startswith(CONTINUATION)]
        automaton = Automaton.build([t for t, *_ in named], [r for _, r, *_ in named])
        return Pieces(automaton, [v for *_, v, _ in named], np.array([s for *_, s in named], np.float64), unknown, lowest, family)

    def found(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
        """``(length, places, pieces)`` at all places of the words that start at ``first``, by rising length."""
        at = np.arange(len(codes))
        room = np.repeat(first + size, size) - at
        state = np.zeros(len(codes), np.int64)
        if self.family == WORDPIECE:
            state += 1
            state[first[size > 0]] = 0
        return self.automaton.search(codes, at, room, state)

    def longest(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and number of the longest piece at every place; -1 where there is none."""
        length, piece = np.zeros(len(codes), np.int64), np.full(len(codes), -1, np.int64)
        for n, at, found in self.found(codes, first, size):
            length[at], piece[at] = n, found
        return length, piece

    def all(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, length and number of all pieces, by place."""
        parts = [(at, np.full(len(at), n), found) for n, at, found in self.found(codes, first, size)]
        at, length, piece = (np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in (zip(*parts) if parts else ((), (), ())))
        order = np.argsort(at, kind="stable")
        return at[order], length[order], piece[order]


def _walk_longest(start: int, stop: int, length: list[int], value: Callable[[int], Any], unknown: Any, whole: bool) -> list[Any]:
    """Longest piece first, from the left; a character no piece starts with is unknown,
    with ``whole`` (wordpiece) the whole word."""
    out, at = [], start
    while at < stop:
        n = length[at]
        if n:
            out.append(value(at))
            at += n
        elif whole:
            return [unknown]
        else:
            out.append(unknown)
            at += 1
    return out


def _walk_best(size: int, hits: list[list[tuple[int, Any, float]]], unknown: Any, worst: float) -> list[Any]:
    """The segmentation with the highest sum of piece scores; ``hits`` has (length, value, score) by place.

    A single character without a piece costs ten more than the vocabulary's worst piece. On
    equal sums the longer last piece wins: places come in order, so an earlier start stays.
    """
    best, back = [0.0] * (size + 1), [None] * (size + 1)
    for at in range(size):
        single = False
        for n, value, score in hits[at]:
            single = single or n == 1
            total = best[at] + score
            if back[at + n] is None or total > best[at + n]:
                best[at + n], back[at + n] = total, (at, value)
        if not single:
            total = best[at] + worst
            if back[at + 1] is None or total > best[at + 1]:
                best[at + 1], back[at + 1] = total, (at, unknown)
    out, at = [], size
    while at > 0:
        at, value = back[at]
        out.append(value)
    return out[::-1]


def _greedy_words(words: list[str], pieces: Pieces) -> list[list[Any]]:
    codes, first, size = code_points(words)
    length, piece = (x.tolist() for x in pieces.longest(codes, first, size))
    whole = pieces.family == WORDPIECE

    def value(at: int) -> Any:
        return pieces.values[piece[at]]

    return [
        _walk_longest(start, start + n, length, value, pieces.unknown, whole) for start, n in zip(first.tolist(), size.tolist())
    ]


def _scored_words(words: list[str], pieces: Pieces) -> list[list[Any]]:
    codes, first, size = code_points(words)
    hits: list[list[tuple[int, Any, float]]] = [[] for _ in range(len(codes))]
    at, length, piece = pieces.all(codes, first, size)
    for at, n, k, score in zip(*(x.tolist() for x in (at, length, piece, pieces.scores[piece]))):
        hits[at].append((n, pieces.values[k], score))
    return [
        _walk_best(n, hits[start : start + n], pieces.unknown, pieces.worst - 10.0) for start, n in zip(first.tolist(), size.tolist())
    ]


METHODS: dict[str, Callable[[list[str], Pieces], list[list[Any]]]] = {"greedy": _greedy_words, "score": _scored_words}


def greedy(word: str, pieces: Pieces) -> list[Any]:
    """Longest piece first, from the left, of one spelled word."""
    return _greedy_words([word], pieces)[0]


def best_scored(word: str, pieces: Pieces) -> list[Any]:
    """The segmentation of one spelled word with the highest sum of piece scores."""
    return _scored_words([word], pieces)[0]


def chunks(texts: list[str | None], chars: int | None = None) -> Iterator[slice]:
    """Runs of texts with about ``chars`` (``CHUNK_CHARS``) characters together, one text at least."""
    chars = CHUNK_CHARS if chars is None else chars
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held > chars and k > start:
            yield slice(start, k)
            start, held = k, len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def text_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``text``, cut where the texts have ``CHUNK_CHARS`` bytes together, one text at least.

    Texts become Python objects, and their tokens leave the task, a run at a time, however large a batch is.
    """
    for b in batches:
        held = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = held[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(held, before + CHUNK_CHARS, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def _cut_words(langs: list[str], words: list[str], known: dict[str, Pieces], method: str) -> list[list[Any]]:
    """The pieces of every word by the vocabulary of its language."""
    places: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        places.setdefault(lang, []).append(k)
    parts: list[list[Any]] = [[]] * len(words)
    for lang, at in places.items():
        pieces = known[lang]
        spelled = [spell(words[k], pieces.family) for k in at]
        for run in chunks(spelled):
            for k, cut in zip(at[run], METHODS[method](spelled[run], pieces)):
                parts[k] = cut
    return parts


def _whole_words(words: list[str], pieces: Pieces) -> list[list[Any]]:
    """Words that are one piece, as that; nothing for the others."""
    codes, first, size = code_points(words)
    length, piece = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    for n, at, found in pieces.automaton.search(codes, first[size > 0], size[size > 0], np.zeros(int((size > 0).sum()), np.int64)):
        word = np.searchsorted(first, at, side="right") - 1
        length[word], piece[word] = n, found
    return [[pieces.values[k]] if n == m and m else [] for n, m, k in zip(length.tolist(), size.tolist(), piece.tolist())]


def _eligible(vocab: DataFrame, emit: str) -> DataFrame:
    """``(vocab, token, value, score)``. Special tokens are not found in text."""
    score = F.col("score").cast("double") if "score" in vocab.columns else F.lit(0.0)
    return vocab.where(~F.coalesce("is_special", F.lit(False))).select("vocab", "token", F.col(emit).alias("value"), score.alias("score"))


def fits_broadcast(df: DataFrame, text: str, limits: Limits) -> bool:
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return n <= limits.broadcast_rows and size <= limits.broadcast_bytes


def _unknowns(vocab: DataFrame, emit: str) -> dict[str, Any]:
    rows = vocab.where(F.col("token").isin(*UNKNOWN)).select("vocab", F.col(emit).alias("value")).collect()
    return {r["vocab"]: r["value"] for r in rows}


def families(vocab: DataFrame) -> dict[str, str]:
    """Family of each vocabulary that says one in a column ``family``."""
    if "family" not in vocab.columns:
        return {}
    return {r["vocab"]: r["family"] for r in vocab.select("vocab", "family").distinct().collect()}


def size_bins(vocab: DataFrame, limits: Limits) -> tuple[list[list[str]], list[str]]:
    """Names of the vocabularies in bins that are small enough to send around
    together, and the names of those that are too large even alone."""
    sizes = (
        vocab.groupBy("vocab").agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).alias("size")).collect()
    )
    bins: list[list[str]] = []
    large, rows, size = [], 0, 0
    for name, n, octets in sorted(sizes):
        if n > limits.broadcast_rows or octets > limits.broadcast_bytes:
            large.append(name)
            continue
        if not bins or rows + n > limits.broadcast_rows or size + octets > limits.broadcast_bytes:
            bins.append([])
            rows, size = 0, 0
        bins[-1].append(name)
        rows, size = rows + n, size + octets
    return bins, large


def for_vocab_sizes(
    df: DataFrame,
    vocab: DataFrame,
    limits: Limits,
    shared: Callable[[DataFrame, DataFrame], DataFrame],
    joined: Callable[[DataFrame, DataFrame], DataFrame],
    drop_missing: bool = False,
) -> DataFrame:
    """Runs ``df(lang, ...)`` against the vocabularies of its languages: one pass per
    bin that can be sent around, a join for the vocabularies that cannot. A language
    without a vocabulary, and a null one, is an error unless its rows may be dropped."""
    bins, large = size_bins(vocab, limits)

    def part(run: Callable[[DataFrame, DataFrame], DataFrame], names: list[str]) -> DataFrame:
        # On the plain column, so that the filter reaches the scan.
        return run(df.where(F.col("lang").isin(names)), vocab.where(F.col("vocab").isin(names)))

    parts = [part(shared, names) for names in bins or ([] if large else [[]])]
    if large:
        parts.append(part(joined, large))
    if not drop_missing:
        parts.append(_without_vocabulary(df, [n for b in bins for n in b] + large, parts[0]))
    return reduce(DataFrame.unionByName, parts)


def _without_vocabulary(df: DataFrame, names: list[str], like: DataFrame) -> DataFrame:
    """Raises an error for every row of a language not in ``names``; of the rows only the language is read."""
    known = F.col("lang").isin(names) if names else F.lit(False)
    unknown = df.select("lang").where(F.col("lang").isNull() | ~known)
    message = F.concat(F.lit("no vocabulary for language "), F.coalesce("lang", F.lit("null")))
    raised = F.raise_error(message)
    return unknown.select(*[raised.cast(f.dataType).alias(f.name) for f in like.schema.fields])


def load_pieces(
    vocab: DataFrame, emit: str, keep: str | None = None
) -> tuple[dict[str, Pieces], dict[str, set]]:
    """The pieces of the vocabularies of one bin, and the values to leave out."""
    score = F.col("score").cast("double") if "score" in vocab.columns else F.lit(0.0)
    kept = F.col(keep) if keep else F.lit(True)
    rows = vocab.select("vocab", "token", F.col(emit).alias("value"), score, kept, "is_special").collect()
    unknown: dict[str, Any] = {}
    pieces: dict[str, list[tuple[str, Any, float]]] = {}
    left_out: dict[str, set] = {}
    for name, token, value, weight, keeps, special in rows:
        found = pieces.setdefault(name, [])
        if token in UNKNOWN:
            unknown[name] = value
        if not special:  # also if it is not said
            found.append((token, value, weight))
        if not keeps:
            left_out.setdefault(name, set()).add(value)
    family = families(vocab)
    built = {v: Pieces.build(p, unknown.get(v), None, family.get(v, SENTENCEPIECE)) for v, p in pieces.items()}
    return built, left_out


def _value_type(vocab: DataFrame, emit: str) -> T.DataType:
    return vocab.schema[emit].dataType


def _arrow_type(t: T.DataType) -> pa.DataType:
    return pa.string() if isinstance(t, T.StringType) else pa.int64()


def _lists(parts: list[list[Any]], value_type: pa.DataType) -> pa.Array:
    offsets, flat = [0], []
    for part in parts:
        flat.extend(part)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, value_type))


def segment_words(
    words: DataFrame,
    vocab: DataFrame,
    emit: str = "token",
    method: str = "greedy",
    limits: Limits = DEFAULT_LIMITS,
    drop_missing: bool = False,
) -> DataFrame:
    """Pieces of distinct words ``(lang, w, ...)``: adds ``pieces``, an array of
    the ``emit`` column of ``vocab`` (whose ``vocab`` column is the language).

    A word is read as the vocabulary's family writes it, which a column ``family`` of
    ``vocab`` names (see :func:`lexigraft.operators.vocab_forms.vocab_family`): with the
    word mark in front (``sentencepiece``, also without the column), with ``##`` before all
    pieces but the first (``wordpiece``), or in the byte-level alphabet (``bpe``).
    """
    kind = _value_type(vocab, emit)
    schema = T.StructType(words.schema.fields + [T.StructField("pieces", T.ArrayType(kind))])
    arrow = _arrow_type(kind)

    def by_dictionary(words: DataFrame, vocab: DataFrame) -> DataFrame:
        shared = words.sparkSession.sparkContext.broadcast(load_pieces(vocab, emit)[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parts = _cut_words(b.column("lang").to_pylist(), b.column("w").to_pylist(), shared.value, method)
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(parts, arrow)], names=[*b.schema.names, "pieces"])

        return words.mapInArrow(run, schema)

    return for_vocab_sizes(
        words, vocab, limits, by_dictionary, lambda w, v: _segment_by_parts(w, v, emit, method, limits), drop_missing
    )


def vocab_parts(eligible: DataFrame, limits: Limits) -> tuple[DataFrame, int]:
    """``eligible(vocab, token, ...)`` with ``_part``: ranges of sorted pieces of about the size that is sent around.

    Any division finds the same pieces; ranges keep common prefixes, and the characters that words start with, together.
    """
    n, size = eligible.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
    wanted = max(ceil(n / max(1, limits.broadcast_rows)), ceil(size / max(1, limits.broadcast_bytes)), 1)
    count = min(wanted, max(n, 1))
    dealt = eligible.repartitionByRange(count, "vocab", "token").withColumn("_part", F.spark_partition_id())
    return materialize(dealt, "pieces"), count


def _segment_by_parts(words: DataFrame, vocab: DataFrame, emit: str, method: str, limits: Limits) -> DataFrame:
    """Segmentation against vocabularies too large for one task.

    The sorted pieces are divided into ranges that can be sent around. Every range is searched for in all
    distinct words of its vocabularies; a word's hits, at most one per character and range, or for scores one per piece
    that stands there, then meet and are walked like those of the whole vocabulary would be.
    """
    kind = _value_type(vocab, emit)
    arrow = _arrow_type(kind)
    eligible = _eligible(vocab, emit).where(F.col("value").isNotNull() & (F.length("token") > 0))
    unknown = _unknowns(vocab, emit)
    worst = {r["vocab"]: r["s"] for r in eligible.groupBy("vocab").agg(F.min("score").alias("s")).collect()}
    family = families(vocab)
    names = vocab.select(F.col("vocab").alias("lang")).distinct()
    words = materialize(words.join(per_name(names), "lang", "left_semi"), "large-words")
    parts, count = vocab_parts(eligible, limits)
    hit = T.StructType().add("at", T.IntegerType()).add("size", T.IntegerType()).add("value", kind).add("score", T.DoubleType())
    schema = T.StructType().add("lang", T.StringType()).add("w", T.StringType()).add("_hits", T.ArrayType(hit))
    hit_arrow = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("value", arrow), ("score", pa.float64())])

    def search(part: int) -> DataFrame | None:
        rows: dict[str, list[tuple[str, Any, float]]] = {}
        for r in parts.where(F.col("_part") == part).select("vocab", "token", "value", "score").collect():
            rows.setdefault(r[0], []).append(r[1:])
        if not rows:
            return None
        known = {v: Pieces.build(p, None, None, family.get(v, SENTENCEPIECE)) for v, p in rows.items()}
        shared = words.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                places: dict[str, list[str]] = {}
                for lang, w in zip(b.column("lang").to_pylist(), b.column("w").to_pylist()):
                    places.setdefault(lang, []).append(w)
                for lang, of_lang in places.items():
                    pieces = shared.value[lang]
                    for chunk in chunks(of_lang):
                        yield _hit_batch(lang, of_lang[chunk], pieces, method, hit_arrow)

        return words.where(F.col("lang").isin(list(rows))).select("lang", "w").mapInArrow(run, schema)

    searched = [d for d in map(search, range(count)) if d is not None]
    columns, fields = words.columns, words.schema.fields
    joined = words.withColumn("_found", F.lit(None).cast(T.ArrayType(hit)))
    if searched:
        found = reduce(DataFrame.unionByName, searched).where(F.size("_hits") > 0)
        found = found.groupBy("lang", "w").agg(F.flatten(F.collect_list("_hits")).alias("_found"))
        joined = words.join(found, ["lang", "w"], "left").select(*columns, "_found")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = []
            for lang, w, hits in zip(*(b.column(c) for c in ("lang", "w", "_found"))):
                lang = lang.as_py()
                style = family.get(lang, SENTENCEPIECE)
                size = len(spell(w.as_py(), style))
                cuts.append(_walk_hits(size, hits.as_py() or [], method, unknown.get(lang), worst.get(lang, 0.0), style))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], _lists(cuts, arrow)], names=[*columns, "pieces"])

    return joined.mapInArrow(walk, T.StructType([*fields, T.StructField("pieces", T.ArrayType(kind))]))


def _hit_batch(lang: str, words: list[str], pieces: Pieces, method: str, hit: pa.DataType) -> pa.RecordBatch:
    """The pieces found in words: the longest at each place, or all if scores decide."""
    codes, first, size = code_points([spell(w, pieces.family) for w in words])
    if method == "greedy":
        length, piece = pieces.longest(codes, first, size)
        at = np.flatnonzero(length)
        length, piece = length[at], piece[at]
    else:
        at, length, piece = pieces.all(codes, first, size)
    offsets = np.append(np.searchsorted(at, first), len(at))
    hits = pa.StructArray.from_arrays(
        [
            pa.array(at - np.repeat(first, np.diff(offsets)), pa.int32()),
            pa.array(length, pa.int32()),
            pa.array(pieces.values, hit.field("value").type).take(pa.array(piece)),
            pa.array(pieces.scores[piece]),
        ],
        fields=list(hit),
    )
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), lists], names=["lang", "w", "_hits"])


def _walk_hits(size: int, hits: list[dict], method: str, unknown: Any, worst: float, family: str) -> list[Any]:
    """Walks one word of ``size`` characters by the hits of all parts of its vocabulary."""
    if method == "greedy":
        length, values = [0] * size, [None] * size
        for h in hits:
            if h["size"] > length[h["at"]]:
                length[h["at"]], values[h["at"]] = h["size"], h["value"]
        return _walk_longest(0, size, length, values.__getitem__, unknown, family == WORDPIECE)
    by_place: list[list[tuple[int, Any, float]]] = [[] for _ in range(size)]
    for h in hits:
        by_place[h["at"]].append((h["size"], h["value"], h["score"]))
    return _walk_best(size, by_place, unknown, worst - 10.0)


def cut_texts(
    langs: list[str],
    texts: list[str | None],
    loaded: tuple[dict[str, Pieces], dict[str, set]],
    method: str,
    whole_words: bool,
    memos: dict[str, dict[str, list]],
) -> list[list[Any]]:
    """Tokens of each text. ``memos`` keeps the pieces of the words seen so far; words not seen
    before are cut together, a run of texts at a time."""
    known, left_out = loaded
    parts: list[list[Any]] = []
    for run in chunks(texts):
        # str.split() cuts at the white space that SPACE describes.
        split = [(lang, (text or "").split()) for lang, text in zip(langs[run], texts[run])]
        if sum(sum(map(len, memo)) for memo in memos.values()) > MEMO_CHARS:
            memos.clear()
        fresh: dict[str, dict[str, None]] = {}
        for lang, words in split:
            memo = memos.setdefault(lang, {})
            fresh.setdefault(lang, {}).update((w, None) for w in words if w not in memo)
        for lang, found in fresh.items():
            words, pieces, skip = list(found), known[lang], left_out.get(lang, ())
            if whole_words:
                cuts = _whole_words([spell(w, pieces.family) for w in words], pieces)
            else:
                cuts = _cut_words([lang] * len(words), words, known, method)
            memos[lang].update((w, [v for v in cut if v not in skip] if skip else cut) for w, cut in zip(words, cuts))
        for lang, words in split:
            memo, tokens = memos[lang], []
            for word in words:
                tokens.extend(memo[word])
            parts.append(tokens)
    return parts


def tokenize_corpus(
    corpus: DataFrame,
    vocab: DataFrame,
    emit: str = "token",
    method: str = "greedy",
    keep: str | None = None,
    whole_words: bool = False,
    limits: Limits = DEFAULT_LIMITS,
    drop_missing: bool = False,
) -> DataFrame:
    """Replaces ``text`` of ``corpus(lang, text, ...)`` by ``tokens``.

    One pass over the texts without a shuffle: every task remembers the words it
    has segmented, so a word costs one dictionary lookup per further occurrence.
    ``keep`` names a boolean column of ``vocab``; tokens where it is false take
    part in the segmentation but are left out of the result. With
    ``whole_words`` a word is looked up as one piece and dropped if absent.
    """
    kind = _value_type(vocab, emit)
    arrow = _arrow_type(kind)
    fields = [f for f in corpus.schema.fields if f.name != "text"]
    schema = T.StructType(fields + [T.StructField("tokens", T.ArrayType(kind))])
    names = [f.name for f in fields]

    def by_dictionary(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
        shared = corpus.sparkSession.sparkContext.broadcast(load_pieces(vocab, emit, keep))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memos: dict[str, dict[str, list]] = {}
            for b in text_runs(batches):
                langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
                parts = cut_texts(langs, texts, shared.value, method, whole_words, memos)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in names], _lists(parts, arrow)], names=[*names, "tokens"]
                )

        return corpus.mapInArrow(run, schema)

    return for_vocab_sizes(
        corpus, vocab, limits, by_dictionary,
        lambda c, v: _tokenize_by_join(c, v, emit, method, keep, whole_words, limits).select(*names, "tokens"),
        drop_missing,
    )


def _tokenize_by_join(
    corpus: DataFrame,
    vocab: DataFrame,
    emit: str,
    method: str,
    keep: str | None,
    whole_words: bool,
    limits: Limits,
) -> DataFrame:
    """Tokenisation against a vocabulary too large for one task: distinct words
    are segmented by join and joined back to their salted occurrences."""
    names = vocab.select(F.col("vocab").alias("lang")).distinct()
    numbered = materialize(
        corpus.join(per_name(names), "lang", "left_semi").withColumn("_doc", F.monotonically_increasing_id()), "corpus"
    )
    occurrences = numbered.select("_doc", "lang", F.posexplode(split_words(F.col("text"))).alias("_pos", "w"))
    distinct = occurrences.select("lang", "w").distinct()
    if whole_words:
        starts = _eligible(vocab, emit).where(F.startswith("token", F.lit(WORD_MARK)))
        marked = starts.select(F.col("vocab").alias("lang"), F.expr("substr(token, 2)").alias("w"), "value")
        cut = distinct.join(marked, ["lang", "w"]).select("lang", "w", F.array("value").alias("pieces"))
    else:
        cut = _segment_by_parts(distinct, vocab, emit, method, limits)
    if keep is not None:
        # Pieces to leave out are removed per distinct word, before occurrences are touched.
        flags = vocab.where(F.col(keep)).select(F.col("vocab").alias("lang"), F.col(emit).alias("v"))
        placed = cut.select("lang", "w", F.posexplode("pieces").alias("p", "v")).join(flags, ["lang", "v"])
        cut = placed.groupBy("lang", "w").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("l")).select(
            "lang", "w", F.col("l.v").alias("pieces")
        )
    spread = cut.withColumn("_salt", every_salt(limits.salts))
    tokens = (
        occurrences.withColumn("_salt", salt_of(["_doc", "_pos"], limits.salts))
        .join(spread, ["lang", "w", "_salt"])
        .groupBy("_doc")
        .agg(F.flatten(F.array_sort(F.collect_list(F.struct("_pos", "pieces")))["pieces"]).alias("tokens"))
    )
    empty = F.array().cast(T.ArrayType(_value_type(vocab, emit)))
    return (
        numbered.drop("text")
        .join(tokens, "_doc", "left")
        .withColumn("tokens", F.coalesce("tokens", empty))
        .drop("_doc")
    )


def join_tokens(tokenized: DataFrame) -> DataFrame:
    """One string per sample, tokens separated by a space."""
    return tokenized.withColumn("text", F.array_join("tokens", " ")).drop("tokens")


def count_tokens(
    words: DataFrame,
    vocab: DataFrame,
    method: str = "greedy",
    limits: Limits = DEFAULT_LIMITS,
    drop_missing: bool = False,
) -> DataFrame:
    """``(vocab, token, cnt)`` from counted words ``(lang, w, n)``.

    Occurrences are already summed per word, so only distinct words are cut.
    """
    return (
        segment_words(words, vocab, "token", method, limits, drop_missing)
        .select(F.col("lang").alias("vocab"), F.explode("pieces").alias("token"), "n")
        .groupBy("vocab", "token")
        .agg(F.sum("n").alias("cnt"))
    )


def with_min_count(counts: DataFrame, min_count: int = 10) -> DataFrame:
    return counts.where(F.col("cnt") >= min_count)
