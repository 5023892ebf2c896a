"""Choosing and building auxiliary token vectors."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.operators.cooccurrence import corpus_cooccurrence, name_pairs, ppmi, projected
from lexigraft.operators.factorisation import factorise
from lexigraft.operators.segmentation import segment_words
from lexigraft.operators.vocab_forms import with_decoded
from lexigraft.operators.vocab_learning import count_words
from lexigraft.operators.wordlevel import token_vectors
from lexigraft.session import DEFAULT_LIMITS, Limits, materialize

MODES = ("tokenlevel", "wordlevel")
REDUCTIONS = ("project", "factorise")
MIN_COUNT, DIM, WINDOW = 10, 100, 5


def with_kept(
    vocab: DataFrame, words: DataFrame, min_count: int, limits: Limits = DEFAULT_LIMITS, method: str = "greedy"
) -> DataFrame:
    """Vocabulary with ``keep``: the token occurs ``min_count`` times in the words of its language."""
    counts = (
        segment_words(words, vocab, "id", method, limits, drop_missing=True)
        .select(F.col("lang").alias("vocab"), F.explode("pieces").alias("id"), "n")
        .groupBy("vocab", "id")
        .agg(F.sum("n").alias("cnt"))
    )
    return vocab.join(counts, ["vocab", "id"], "left").withColumn(
        "keep", F.coalesce(F.col("cnt") >= min_count, F.lit(False))
    )


def for_vocabularies(corpus: DataFrame, vocab_langs: dict[str, str]) -> DataFrame:
    """The corpus once for each vocabulary of its language, ``lang`` being the vocabulary's name.

    ``vocab_langs`` gives the language of each vocabulary; several may share one. Texts of other
    languages are not used.
    """
    names: dict[str, list[str]] = {}
    for vocab, lang in sorted(vocab_langs.items()):
        names.setdefault(lang, []).append(vocab)
    table = F.create_map(*[c for lang, v in names.items() for c in (F.lit(lang), F.array(*map(F.lit, v)))])
    known = corpus.where(F.col("lang").isin(*names))
    return known.withColumn("lang", F.explode(F.element_at(table, F.col("lang"))))


def token_pairs(
    corpus: DataFrame,
    vocab: DataFrame,
    min_count: int = MIN_COUNT,
    window: int = WINDOW,
    words: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
    method: str = "greedy",
) -> DataFrame:
    """Co-occurrences ``(lang, token, ctx, n)`` of frequent tokens, as token ids.

    Of the corpus the languages that have a vocabulary are used.
    """
    words = count_words(corpus) if words is None else words
    kept = materialize(with_kept(vocab, words, min_count, limits, method), "kept")
    return corpus_cooccurrence(corpus, kept, window, method, keep="keep", limits=limits, drop_missing=True)


def aux_from_corpus(
    corpus: DataFrame,
    vocab: DataFrame,
    dim: int = DIM,
    min_count: int = MIN_COUNT,
    window: int = WINDOW,
    words: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
    method: str = "greedy",
    vocab_langs: dict[str, str] | None = None,
    reduction: str = "project",
) -> DataFrame:
    """``(vocab, token, vector)`` from a corpus: tokenise, count co-occurrences,
    weight by PPMI, bring to ``dim`` dimensions. Deterministic. ``reduction`` is ``project``, a random projection,
    or ``factorise``, vectors learned by factorising the weights. ``method`` is how
    words are cut: ``greedy``, or ``score`` for a vocabulary with a ``score`` column. Vocabularies are
    named like their language unless ``vocab_langs`` gives it, see :func:`for_vocabularies`."""
    if vocab_langs is not None:
        corpus, words = for_vocabularies(corpus, vocab_langs), words and for_vocabularies(words, vocab_langs)
    if reduction not in REDUCTIONS:
        raise ValueError(f"unknown reduction {reduction!r}, expected one of {REDUCTIONS}")
    # The counted pairs feed the totals of tokens and contexts and the weights.
    pairs = materialize(token_pairs(corpus, vocab, min_count, window, words, limits, method), "pairs")
    if reduction == "factorise":
        return factorise(materialize(ppmi(name_pairs(pairs, vocab)), "weights"), dim, limits=limits)
    return projected(pairs, vocab, dim, limits)


def word_pairs(
    corpus: DataFrame, word_vocab: DataFrame, min_count: int = MIN_COUNT, window: int = WINDOW, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Co-occurrences of whole words that ``word_vocab(vocab, token, id, n, is_special)`` lists."""
    frequent = word_vocab.where(F.col("n") >= min_count)
    return corpus_cooccurrence(corpus, frequent, window, whole_words=True, limits=limits, drop_missing=True)


def word_vectors_from_corpus(
    corpus: DataFrame,
    word_vocab: DataFrame,
    dim: int = DIM,
    min_count: int = MIN_COUNT,
    window: int = WINDOW,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(lang, word, vector)`` of whole words, by the same weighting as tokens."""
    pairs = materialize(word_pairs(corpus, word_vocab, min_count, window, limits), "word_pairs")
    return projected(pairs, word_vocab, dim, limits).select(
        F.col("vocab").alias("lang"), F.expr("substr(token, 2)").alias("word"), "vector"
    )


def load_auxiliary(
    vocab: DataFrame | None = None,
    mode: str = "tokenlevel",
    *,
    table: DataFrame | None = None,
    corpus: DataFrame | None = None,
    word_vectors: DataFrame | None = None,
    languages: list[str] | None = None,
    dim: int = DIM,
    min_count: int = MIN_COUNT,
    window: int = WINDOW,
    method: str = "greedy",
    vocab_langs: dict[str, str] | None = None,
    reduction: str = "project",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Auxiliary vectors ``(vocab, token, vector)``.

    Token level: a ready ``table`` goes before a ``corpus`` to derive vectors
    from; ``method``, ``vocab_langs`` and ``reduction`` as in :func:`aux_from_corpus`. Word level: ``word_vectors(lang, word, vector)`` of the given
    ``languages``, mapped to the tokens of ``vocab``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown auxiliary mode {mode!r}, expected one of {MODES}")
    if mode == "tokenlevel":
        if table is None and corpus is None:
            raise ValueError("token-level vectors need a corpus or a table of vectors")
        if table is not None:
            if corpus is not None:
                warnings.warn("a table of vectors is given, the corpus is ignored", stacklevel=2)
            return table.select("vocab", "token", "vector")
        if vocab is None:
            raise ValueError("deriving vectors from a corpus needs a vocabulary")
        return aux_from_corpus(
            corpus, vocab, dim, min_count, window, limits=limits, method=method, vocab_langs=vocab_langs, reduction=reduction
        )
    if not languages or word_vectors is None or vocab is None:
        raise ValueError("word-level vectors need a vocabulary, word vectors and their languages")
    if table is not None or corpus is not None:
        warnings.warn("word-level mode ignores tables and corpora", stacklevel=2)
    wanted = vocab.where(F.col("vocab").isin(languages))
    return token_vectors(with_decoded(wanted), word_vectors.where(F.col("lang").isin(languages)), dim, limits)
