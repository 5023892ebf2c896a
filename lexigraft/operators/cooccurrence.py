"""Co-occurrence counts, PPMI weights and their random projection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.functions.fixed import STEP_BITS, to_steps
from lexigraft.functions.hashing import sign_of, sign_words
from lexigraft.operators.segmentation import cut_texts, for_vocab_sizes, load_pieces, text_runs, tokenize_corpus
from lexigraft.session import DEFAULT_LIMITS, Limits, materialize, per_name

PAIR_SCHEMA = "lang string, token bigint, ctx bigint, n bigint"


def count_pairs(samples: list[list[int]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unordered pairs at most ``window`` positions apart: lower id, higher id, count."""
    flat = np.fromiter(chain.from_iterable(samples), dtype=np.int64)
    return _count_flat(flat, np.repeat(np.arange(len(samples)), [len(s) for s in samples]), window)


def _count_flat(flat: np.ndarray, sample: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of all tokens in one array, with the sample that each stands in."""
    base = int(flat.max()) + 1 if len(flat) else 1
    parts = []
    for d in range(1, window + 1):
        near = sample[d:] == sample[:-d]
        a, b = flat[:-d][near], flat[d:][near]
        parts.append(np.minimum(a, b) * base + np.maximum(a, b))
    keys, counts = _summed(np.concatenate(parts), None)
    return keys // base, keys % base, counts


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order, and the sums of their counts, or how often they occur."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    if counts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


# Tokens counted at a time; bounds the memory of a task, and how often a pair leaves it.
CHUNK_TOKENS = 500_000
# Tokens are dealt into so many buckets per language, in which their counts meet.
BUCKETS = 4096
# Buckets whose pairs are counted at a time.
COUNTED_BUCKETS = 256
# Counts of a bucket that may wait before they are added up, and rows written at a time.
WAITING, ROWS_OUT = 500_000, 100_000

_COUNTED = "lang string, bucket int, size int, token binary, ctx binary, n binary"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all; negative ones in eight."""
    kind = np.min_scalar_type(int(x.max())) if x.min() >= 0 else np.int64
    return x.astype(kind).tobytes()


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    width = len(packed) // size
    return np.frombuffer(packed, f"u{width}" if width < 8 else "i8").astype(np.int64)


class _Counter:
    """Pairs of the samples a task has seen, counted ``CHUNK_TOKENS`` tokens of a language at a time.

    A row of the result has the pairs of one bucket of tokens, in both directions: their number, and packed
    arrays of token, context and count.
    """

    def __init__(self, window: int):
        self.window = window
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size: dict[str, int] = {}

    def add(self, langs: list[str], samples: list[list[int]]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list[list[int]]] = {}
        for lang, tokens in zip(langs, samples):
            by_lang.setdefault(lang, []).append(tokens)
        for lang, own in by_lang.items():
            for tokens in _runs(own):
                # A vocabulary without an unknown piece gives null for what it cannot cut.
                flat = np.fromiter((t for s in tokens for t in s if t is not None), np.int64)
                sizes = [sum(t is not None for t in s) for s in tokens]
                self.held.setdefault(lang, []).append((flat, np.asarray(sizes, np.int64)))
                self.size[lang] = self.size.get(lang, 0) + len(flat)
                if self.size[lang] >= CHUNK_TOKENS:
                    yield from self._counted(lang)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.held):
            yield from self._counted(lang)

    def _counted(self, lang: str) -> Iterator[pa.RecordBatch]:
        held = self.held.pop(lang)
        self.size.pop(lang)
        sizes = np.concatenate([s for _, s in held])
        flat = np.concatenate([f for f, _ in held])
        del held
        for token, ctx, n in _directed(flat, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), self.window):
            bucket = token % BUCKETS
            cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1]]))
            rows = [slice(a, b) for a, b in zip(cuts, np.append(cuts[1:], len(bucket)))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(rows), pa.string()),
                    pa.array(bucket[cuts], pa.int32()),
                    pa.array([r.stop - r.start for r in rows], pa.int32()),
                    *[pa.array([_packed(x[r]) for r in rows], pa.binary()) for x in (token, ctx, n)],
                ],
                names=["lang", "bucket", "size", "token", "ctx", "n"],
            )


def _directed(flat: np.ndarray, sample: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token, context and count of the pairs in both directions, sorted by bucket, token and context.

    They come ``COUNTED_BUCKETS`` buckets at a time, so only the pairs of these are laid out at once.
    """
    base = int(flat.max()) + 1 if len(flat) else 1
    per_bucket = -(-base // BUCKETS)
    # Rises by bucket, then by token.
    rank = flat % BUCKETS * per_bucket + flat // BUCKETS
    near = [sample[d:] == sample[:-d] for d in range(1, window + 1)]
    for low in range(0, min(base, BUCKETS), COUNTED_BUCKETS):
        own = (rank >= low * per_bucket) & (rank < (low + COUNTED_BUCKETS) * per_bucket)
        parts = []
        for d, same in enumerate(near, 1):
            for token, ctx, wanted in ((rank[:-d], flat[d:], own[:-d]), (rank[d:], flat[:-d], own[d:])):
                at = np.flatnonzero(same & wanted)
                parts.append(token[at] * base + ctx[at])
        keys = np.concatenate(parts)
        del parts
        keys, n = _summed(keys, None)
        if len(keys):
            token = keys // base
            yield token % per_bucket * BUCKETS + token // per_bucket, keys % base, n


def _runs(samples: list[list[int]]) -> Iterator[list[list[int]]]:
    """Samples with about ``CHUNK_TOKENS`` tokens together, one sample at least."""
    start, held = 0, 0
    for k, tokens in enumerate(samples):
        held += len(tokens)
        if held > CHUNK_TOKENS and k > start:
            yield samples[start:k]
            start, held = k, len(tokens)
    yield samples[start:]


class _Bucket:
    """Counts of one bucket, added up whenever many wait."""

    def __init__(self, lang: str):
        self.lang = lang
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.known = 0, 0

    def add(self, token: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((token, ctx, n))
        self.waiting += len(n)
        if self.waiting > max(WAITING, self.known):
            self._merge()

    def _merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        token, ctx, n = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        base = int(ctx.max()) + 1
        key = token * base + ctx
        del token, ctx
        key, n = _summed(key, n)
        self.parts, self.waiting, self.known = [(key // base, key % base, n)], 0, len(n)
        return self.parts[0]

    def rows(self) -> Iterator[pa.RecordBatch]:
        token, ctx, n = self._merge()
        for start in range(0, len(n), ROWS_OUT):
            part = slice(start, start + ROWS_OUT)
            lang = pa.array([self.lang], pa.string()).take(pa.array(np.zeros(len(n[part]), np.int64)))
            columns = [lang, *[pa.array(x[part]) for x in (token, ctx, n)]]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "token", "ctx", "n"])


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of counts sorted by language and bucket, as rows per pair."""
    at, bucket = None, None
    for b in batches:
        columns = [b.column(c) for c in ("lang", "bucket", "size", "token", "ctx", "n")]
        for k in range(b.num_rows):
            lang, number, size, *packed = (c[k].as_py() for c in columns)
            if bucket is None or at != (lang, number):
                if bucket is not None:
                    yield from bucket.rows()
                at, bucket = (lang, number), _Bucket(lang)
            bucket.add(*[_unpacked(x, size) for x in packed])
    if bucket is not None:
        yield from bucket.rows()


def _pairs_of(counted: DataFrame) -> DataFrame:
    """Adds up pairs counted by :class:`_Counter`. All contexts of a token come out of one task, one behind the other."""
    dealt = counted.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return dealt.mapInArrow(_added_up, PAIR_SCHEMA)


def cooccurrence(tokenized: DataFrame, window: int = 5) -> DataFrame:
    """``(lang, token, ctx, n)``: how often ``ctx`` stands within ``window``
    positions of ``token`` in the same sample of ``tokenized(lang, tokens)``.

    Tokens are ids. Pairs are counted inside each task, so only
    partial counts are shuffled, never the pairs themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(window)
        for b in batches:
            yield from counter.add(b.column("lang").to_pylist(), b.column("tokens").to_pylist())
        yield from counter.rest()

    return _pairs_of(tokenized.select("lang", "tokens").mapInArrow(run, _COUNTED))


def corpus_cooccurrence(
    corpus: DataFrame,
    vocab: DataFrame,
    window: int = 5,
    method: str = "greedy",
    keep: str | None = None,
    whole_words: bool = False,
    limits: Limits = DEFAULT_LIMITS,
    drop_missing: bool = False,
) -> DataFrame:
    """The same counts straight from the texts: tokens are cut and counted in one
    pass, and the tokenised corpus is not laid out in between."""
    def by_dictionary(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
        shared = corpus.sparkSession.sparkContext.broadcast(load_pieces(vocab, "id", keep))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memos: dict[str, dict[str, list]] = {}
            counter = _Counter(window)
            for b in text_runs(batches):
                langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
                yield from counter.add(langs, cut_texts(langs, texts, shared.value, method, whole_words, memos))
            yield from counter.rest()

        return _pairs_of(corpus.mapInArrow(run, _COUNTED))

    def by_join(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
        return cooccurrence(tokenize_corpus(corpus, vocab, "id", method, keep, whole_words, limits), window)

    return for_vocab_sizes(corpus.select("lang", "text"), vocab, limits, by_dictionary, by_join, drop_missing)


def name_pairs(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Replaces token ids by tokens."""

    def names(column: str) -> DataFrame:
        return vocab.select(F.col("vocab").alias("lang"), F.col("id").alias(column), F.col("token").alias(f"_{column}"))

    return (
        pairs.join(names("token"), ["lang", "token"])
        .join(names("ctx"), ["lang", "ctx"])
        .select("lang", F.col("_token").alias("token"), F.col("_ctx").alias("ctx"), "n")
    )


def ppmi(pairs: DataFrame, dim: int | None = None) -> DataFrame:
    """Adds ``ppmi`` = max(0, ln(n * N / (n_token * n_ctx))) to counted pairs.

    The counts are symmetric, so one table of totals serves tokens and contexts.
    With ``dim`` the sign words of the context come along, computed once per
    context instead of once per pair.
    """
    totals = pairs.groupBy("lang", "token").agg(F.sum("n").alias("n_token"))
    grand = totals.groupBy("lang").agg(F.sum("n_token").alias("n_all"))
    signs = [w.alias(f"s{i}") for i, w in enumerate(sign_words(F.col("token"), dim))] if dim else []
    contexts = totals.select("lang", F.col("token").alias("ctx"), F.col("n_token").alias("n_ctx"), *signs)

    def real(c: str):
        return F.col(c).cast("double")

    return (
        pairs.join(totals, ["lang", "token"])
        .join(contexts, ["lang", "ctx"])
        .join(per_name(grand), "lang")
        .withColumn(
            "ppmi",
            F.greatest(F.lit(0.0), F.log(real("n") * real("n_all") / (real("n_token") * real("n_ctx")))),
        )
        .select("lang", "token", "ctx", "n", "ppmi", *[f"s{i}" for i in range(len(signs))])
    )


def project(weighted: DataFrame, dim: int) -> DataFrame:
    """``(vocab, token, vector)``: contexts projected to ``dim`` columns with
    signs keyed by the context, scaled by 1/sqrt(dim)."""
    rows = weighted.where(F.col("ppmi") > 0).withColumn("_steps", to_steps(F.col("ppmi")))
    sums = [F.expr(f"sum(_steps * {sign_of(f's{j // 32}', j)}) AS d{j}") for j in range(dim)]
    scale = f"{float(1 << STEP_BITS)!r}D / {math.sqrt(dim)!r}D"
    packed = F.expr("array(" + ", ".join(f"d{j} / {scale}" for j in range(dim)) + ")")
    return (
        rows.groupBy(F.col("lang").alias("vocab"), "token").agg(*sums).select("vocab", "token", packed.alias("vector"))
    )


def _bits(words: list[np.ndarray], dim: int) -> np.ndarray:
    """The signs of :func:`sign_of` in all 32-bit words of each row: one byte per dimension, 1 for minus, packed."""
    columns = []
    for j in range(dim):
        digit, bit = divmod(j % 32, 4)
        columns.append((words[j // 32] >> (4 * (7 - digit) + bit)) & 1)
    return np.packbits(np.stack(columns, axis=1).astype(np.uint8), axis=1)


# Pairs whose projections are laid out at a time.
PROJECTED = 4096


def _projection(shared, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sums(lang: str, token: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ids, total, bits, grand = shared.value[lang]
        at = np.searchsorted(ids, ctx)
        weight = np.log(n.astype(np.float64) * grand / (total[np.searchsorted(ids, token)] * total[at]))
        up = np.flatnonzero(weight > 0)
        token, at = token[up], at[up]
        steps = np.floor(weight[up] * float(1 << STEP_BITS) + 0.5).astype(np.int64)
        order = np.argsort(token, kind="stable")
        token, at, steps = token[order], at[order], steps[order]
        signs = 1 - 2 * np.unpackbits(bits[at], axis=1, count=dim).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(token)), bool), token[1:] != token[:-1]]))
        signs *= steps[:, None]
        total = np.add.reduceat(signs, starts, axis=0) if len(starts) else signs
        offsets = pa.array(np.arange(0, total.size + 1, dim), pa.int32())
        names = pa.array([lang] * len(starts), pa.string())
        return pa.RecordBatch.from_arrays(
            [names, pa.array(token[starts]), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], names=["lang", "id", "v"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, PROJECTED):
                part = b.slice(start, PROJECTED)
                langs = part.column("lang").dictionary_encode()
                of, columns = langs.indices.to_numpy(), [part.column(c).to_numpy() for c in ("token", "ctx", "n")]
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    own = of == k
                    yield sums(lang, *[c[own] for c in columns])

    return run


def projected(pairs: DataFrame, vocab: DataFrame, dim: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """``(vocab, token, vector)``: what :func:`project` of :func:`ppmi` of the named pairs gives, from pairs of ids.

    ``pairs(lang, token, ctx, n)`` is a written table and read twice. Totals and signs of the contexts are sent around
    if they fit, about 16 bytes and a bit per dimension each; a task then adds up the pairs of a token where
    they lie, and only vectors are shuffled. Pairs of a token that lie together become one vector.
    """
    totals = pairs.groupBy("lang", F.col("token").alias("id")).agg(F.sum("n").alias("n_token"))
    words = sign_words(F.col("token"), dim)
    names = vocab.select(F.col("vocab").alias("lang"), "id", "token")
    known = totals.join(names, ["lang", "id"], "left").select("lang", "id", "token", "n_token", *[w.alias(f"s{i}") for i, w in enumerate(words)])
    known = materialize(known, "contexts")
    rows, named, distinct = known.agg(F.count("*"), F.count("token"), F.count_distinct("lang", "id")).first()
    if rows * (16 + dim / 8) > limits.broadcast_bytes or not rows == named == distinct:
        return project(ppmi(name_pairs(pairs, vocab), dim), dim)
    contexts = {}
    for lang in [r["lang"] for r in known.select("lang").distinct().collect()]:
        table = known.where(F.col("lang") == lang).drop("lang", "token").toArrow().sort_by("id")
        ids, n, *signs = (table.column(c).to_numpy() for c in table.column_names)
        contexts[lang] = ids, n.astype(np.float64), _bits(signs, dim), float(n.sum())
    shared = pairs.sparkSession.sparkContext.broadcast(contexts)
    parts = pairs.select("lang", "token", "ctx", "n").mapInArrow(_projection(shared, dim), "lang string, id bigint, v array<bigint>")
    sums = parts.groupBy("lang", "id").agg(*[F.expr(f"sum(v[{j}]) AS d{j}") for j in range(dim)])
    scale = f"{float(1 << STEP_BITS)!r}D / {math.sqrt(dim)!r}D"
    packed = F.expr("array(" + ", ".join(f"d{j} / {scale}" for j in range(dim)) + ")")
    vectors = sums.select("lang", "id", packed.alias("vector"))
    return vectors.join(names, ["lang", "id"]).select(F.col("lang").alias("vocab"), "token", "vector")
