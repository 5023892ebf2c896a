"""The full transfer of token embeddings to other vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.operators.assembly import union_branches, zero_rows
from lexigraft.operators.combination import combine_vectors
from lexigraft.operators.lookup import COPIED, RANDOM, WEIGHTED, with_auxiliary
from lexigraft.operators.overlap import match_tokens, with_pairs
from lexigraft.operators.similarity import neighbour_weights
from lexigraft.operators.statistics import dimension_stats, random_vectors
from lexigraft.operators.vocab_forms import canonical_vocab
from lexigraft.session import DEFAULT_LIMITS, Limits, materialize
from lexigraft.sources.tables import require_unique


@dataclass
class TransferParts:
    """The tables between the steps of a transfer."""

    annotated: DataFrame
    weights: DataFrame
    embeddings: DataFrame
    seed: int
    limits: Limits

    def contributions(self) -> DataFrame:
        """``(pair_id, source, id, token, outcome, k, src_id, w)``: what copied and
        weighted rows consist of. A copied row is one source row with weight 1,
        so both kinds share a single join with the source matrix."""
        copied = self.annotated.where(F.col("outcome") == COPIED).select(
            "pair_id",
            "source",
            "id",
            "token",
            "outcome",
            F.lit(1).alias("k"),
            "src_id",
            F.lit(1.0).alias("w"),
        )
        weighted = self.weights.select(
            "pair_id", "source", "id", "token", F.lit(WEIGHTED).alias("outcome"), "k", "src_id", "w"
        )
        # Read for the source rows in use and for the sums.
        return materialize(copied.unionByName(weighted), "contributions")

    def combined(self) -> DataFrame:
        keys = ["pair_id", "id", "token", "outcome"]
        return combine_vectors(self.contributions(), self.embeddings, keys, self.limits)

    def weighted(self) -> DataFrame:
        keys = ["pair_id", "id", "token", "outcome"]
        parts = self.weights.withColumn("outcome", F.lit(WEIGHTED))
        return combine_vectors(materialize(parts, "weights"), self.embeddings, keys, self.limits)

    def random(self) -> DataFrame:
        tokens = self.annotated.where(F.col("outcome") == RANDOM).select("pair_id", "source", "id", "token", "outcome")
        return random_vectors(tokens, dimension_stats(self.embeddings), self.seed)

    def zero(self, target_sizes: dict[str, int]) -> DataFrame:
        shapes = self.embeddings.groupBy(F.col("vocab").alias("source"), "matrix").agg(
            F.max(F.size("vector")).alias("dim")
        )
        return zero_rows(self.annotated.select("pair_id", "source", "id"), target_sizes, shapes)


def transfer_parts(
    source_vocab: DataFrame,
    target_vocab: DataFrame,
    embeddings: DataFrame,
    aux: DataFrame,
    pairs: list[tuple[str, str, str]],
    *,
    exact_match_all: bool = True,
    match_symbols: bool = False,
    fuzzy_match_all: bool = False,
    extend_vocab: DataFrame | None = None,
    strict_membership: bool = False,
    seed: int = 42,
    limits: Limits = DEFAULT_LIMITS,
) -> TransferParts:
    """Matches, annotates and weights; see :func:`transfer` for the arguments."""
    for vocab in (source_vocab, target_vocab):
        require_unique(vocab)
    matched = match_tokens(
        with_pairs(canonical_vocab(target_vocab), pairs),
        canonical_vocab(source_vocab),
        exact_match_all=exact_match_all,
        match_symbols=match_symbols,
        fuzzy_match_all=fuzzy_match_all,
    )
    annotated = with_auxiliary(matched, aux, extend_vocab, strict_membership).select(
        "pair_id",
        "source",
        "vocab",
        "id",
        "token",
        "match_kind",
        "src_id",
        "src_token",
        "n_sources",
        "in_extend",
        "usable",
        "use_for_init",
        "outcome",
        # Random rows need no auxiliary vector any more.
        F.when(F.col("outcome") != RANDOM, F.col("aux")).alias("aux"),
    )
    # Read by the neighbour, new, copied and random branches.
    annotated = materialize(annotated, "annotated")
    return TransferParts(annotated, neighbour_weights(annotated, limits), embeddings, seed, limits)


def transfer(
    source_vocab: DataFrame,
    target_vocab: DataFrame,
    embeddings: DataFrame,
    aux: DataFrame,
    pairs: list[tuple[str, str, str]],
    *,
    exact_match_all: bool = True,
    match_symbols: bool = False,
    fuzzy_match_all: bool = False,
    extend_vocab: DataFrame | None = None,
    strict_membership: bool = False,
    seed: int = 42,
    target_sizes: dict[str, int] | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Embedding rows for every target vocabulary.

    Args:
        source_vocab: ``(vocab, token, id, is_special[, decoded])``.
        target_vocab: the same for the target vocabularies; when extending, the
            extended vocabularies.
        embeddings: source matrices ``(vocab, matrix, id, vector)``.
        aux: auxiliary vectors ``(vocab, token, vector)`` of the target vocabularies.
        pairs: (pair_id, source vocabulary, target vocabulary).
        exact_match_all: match tokens with equal canonical forms.
        match_symbols: match numbers, symbols and special tokens exactly or fuzzily.
        fuzzy_match_all: match tokens that are equal without mark and case.
        extend_vocab: when extending, the vocabularies that were added; only their
            tokens serve as neighbours.
        strict_membership: count id 0 of ``extend_vocab`` as a member.
        seed: of the random rows.
        target_sizes: number of rows per pair where a matrix is to have more rows
            than the vocabulary has ids; the others become zero.

    Returns:
        ``(pair_id, matrix, id, token, outcome, vector ARRAY<FLOAT>)`` with
        ``outcome`` one of ``copied``, ``weighted``, ``random``, ``zero``.
    """
    parts = transfer_parts(
        source_vocab,
        target_vocab,
        embeddings,
        aux,
        pairs,
        exact_match_all=exact_match_all,
        match_symbols=match_symbols,
        fuzzy_match_all=fuzzy_match_all,
        extend_vocab=extend_vocab,
        strict_membership=strict_membership,
        seed=seed,
        limits=limits,
    )
    branches = [parts.combined(), parts.random()]
    if target_sizes:
        branches.append(parts.zero(target_sizes))
    return union_branches(*branches)
