"""The domain tables of the queries, derived from the driver's tables.

The test data hold no vocabularies: they are learned from ``documents``. The
source language is English with ids that are the row numbers of ``embeddings``,
the targets are the other languages.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraft.operators.overlap import with_pairs
from lexigraft.operators.vocab_forms import canonical_vocab
from lexigraft.operators.vocab_learning import (
    byte_pieces,
    count_words,
    extend_vocab,
    frequent_words,
    learn_bpe_vocab,
    learn_vocab,
    learn_wordpiece_vocab,
)
from lexigraft.plans.auxiliary import DIM, aux_from_corpus, word_vectors_from_corpus
from lexigraft.plans.transfer import TransferParts, transfer_parts
from lexigraft.session import materialize, spread_small

SOURCE = "en"
TARGETS = ["de", "fr", "es"]
PAIRS = [(f"{SOURCE}-{t}", SOURCE, t) for t in TARGETS]
VOCAB_SIZE = 4000
OTHER_VOCAB_SIZE = 3000
MIN_COUNT = 30
MERGES = 100
# Scores of pieces are multiples of 2^-SCORE_BITS.
SCORE_BITS, UNSEEN_SCORE = 20, -30.0
SEED = 42


class Tables:
    """Tables of one query run; nothing is shared between runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def corpus(self) -> DataFrame:
        return spread_small(self.read("documents").select("doc_id", "lang", "text"))

    @cached_property
    def target_corpus(self) -> DataFrame:
        return self.corpus.where(F.col("lang").isin(TARGETS))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings").select(
            F.lit(SOURCE).alias("vocab"), F.lit("input").alias("matrix"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
        )

    @cached_property
    def both_matrices(self) -> DataFrame:
        """Input matrix, and its rows reversed as the output matrix."""
        return self.embeddings.unionByName(
            self.embeddings.withColumns({"matrix": F.lit("output"), "vector": F.reverse("vector")})
        )

    @cached_property
    def words(self) -> DataFrame:
        # Read by the character, word and token counts.
        return materialize(count_words(self.corpus), "words")

    @cached_property
    def vocabs(self) -> DataFrame:
        sizes = {SOURCE: self.read("embeddings").count(), **{t: VOCAB_SIZE for t in TARGETS}}
        return materialize(learn_vocab(self.words, sizes), "vocabs")

    @cached_property
    def source_vocab(self) -> DataFrame:
        return self.vocabs.where(F.col("vocab") == SOURCE)

    @cached_property
    def target_vocab(self) -> DataFrame:
        return self.vocabs.where(F.col("vocab") != SOURCE)

    @cached_property
    def target_words(self) -> DataFrame:
        return self.words.where(F.col("lang").isin(TARGETS))

    @cached_property
    def extended_vocab(self) -> DataFrame:
        return materialize(extend_vocab(self.source_vocab, self.target_vocab, TARGETS), "extended")

    @cached_property
    def wordpiece_vocab(self) -> DataFrame:
        return materialize(learn_wordpiece_vocab(self.words, {t: OTHER_VOCAB_SIZE for t in [SOURCE, *TARGETS]}), "wp")

    @cached_property
    def bpe_vocab(self) -> DataFrame:
        return materialize(learn_bpe_vocab(self.words, {t: OTHER_VOCAB_SIZE for t in [SOURCE, *TARGETS]}), "bpe")

    @cached_property
    def byte_vocab(self) -> DataFrame:
        """The learned vocabularies with byte-fallback pieces added; ids are not used."""
        return self.vocabs.select("vocab", "token", "is_special").unionByName(
            byte_pieces(self.words).select("vocab", "token", F.lit(False).alias("is_special"))
        )

    @cached_property
    def source_forms(self) -> DataFrame:
        return canonical_vocab(self.source_vocab)

    @cached_property
    def target_forms(self) -> DataFrame:
        return with_pairs(canonical_vocab(self.target_vocab), PAIRS)

    @cached_property
    def aux(self) -> DataFrame:
        return aux_from_corpus(self.target_corpus, self.target_vocab, DIM, MIN_COUNT, words=self.target_words)

    @cached_property
    def word_vocab(self) -> DataFrame:
        """All frequent whole words of the target languages, as marked pieces."""
        return materialize(frequent_words(self.target_words, MIN_COUNT), "word_vocab")

    @cached_property
    def word_vectors(self) -> DataFrame:
        return materialize(word_vectors_from_corpus(self.target_corpus, self.word_vocab, DIM, MIN_COUNT), "word_vectors")

    def transfer_parts(self, embeddings: DataFrame | None = None, aux: DataFrame | None = None, **options) -> TransferParts:
        options.setdefault("seed", SEED)
        return transfer_parts(
            self.source_vocab,
            options.pop("target_vocab", self.target_vocab),
            self.embeddings if embeddings is None else embeddings,
            self.aux if aux is None else aux,
            PAIRS,
            **options,
        )
