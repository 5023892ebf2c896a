"""Vocabulary families and comparable token forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraft.functions.text import BPE_MARK, BYTE_PIECE, WORD_MARK, decode_byte_level, is_symbol_text, ltrim_u
from lexigraft.session import per_name

FAMILIES = ("sentencepiece", "wordpiece", "bpe")

# More marked tokens than this make a family.
FAMILY_THRESHOLD = 100


def vocab_family(vocab: DataFrame) -> DataFrame:
    """``(vocab, family)``, one row per vocabulary."""
    marked = F.count_if(F.startswith("token", F.lit(WORD_MARK)))
    continued = F.count_if(F.startswith("token", F.lit("##")))
    return vocab.groupBy("vocab").agg(
        F.when(marked > FAMILY_THRESHOLD, "sentencepiece")
        .when(continued > FAMILY_THRESHOLD, "wordpiece")
        .otherwise("bpe")
        .alias("family")
    )


def decode_token(token: Column, family: Column) -> Column:
    return (
        F.when(family == "sentencepiece", F.replace(token, F.lit(WORD_MARK), F.lit(" ")))
        .when(family == "wordpiece", token)
        .otherwise(decode_byte_level(token))
    )


def _trimmed(decoded: Column, starts_word: Column) -> Column:
    text = ltrim_u(decoded)
    return F.when(starts_word, F.concat(F.lit(WORD_MARK), text)).otherwise(text)


def canonical_sentencepiece(token: Column, decoded: Column) -> tuple[Column, Column]:
    """Canonical form and word-start flag. Byte-fallback pieces stay as they are."""
    is_byte = token.rlike(BYTE_PIECE)
    starts = F.startswith(token, F.lit(WORD_MARK))
    return F.when(is_byte, token).otherwise(_trimmed(decoded, starts)), ~is_byte & starts


def canonical_wordpiece(token: Column, decoded: Column) -> tuple[Column, Column]:
    continued = F.startswith(decoded, F.lit("##"))
    form = F.when(continued, F.substring(decoded, 3, 1 << 30)).otherwise(F.concat(F.lit(WORD_MARK), decoded))
    return form, ~continued


def canonical_bpe(token: Column, decoded: Column) -> tuple[Column, Column]:
    starts = F.startswith(token, F.lit(BPE_MARK))
    return _trimmed(decoded, starts), starts


def with_decoded(vocab: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Vocabulary with ``family`` and a filled ``decoded`` column."""
    families = vocab_family(vocab) if families is None else families
    own = F.col("decoded") if "decoded" in vocab.columns else F.lit(None).cast("string")
    return vocab.join(per_name(families), "vocab").withColumn(
        "decoded", F.coalesce(own, decode_token(F.col("token"), F.col("family")))
    )


def canonical_vocab(vocab: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Adds ``family, decoded, canonical, fuzzy, uncased, no_ws, bow`` to a vocabulary."""
    token, decoded, family = F.col("token"), F.col("decoded"), F.col("family")
    sp, sp_bow = canonical_sentencepiece(token, decoded)
    wp, wp_bow = canonical_wordpiece(token, decoded)
    bpe, bpe_bow = canonical_bpe(token, decoded)
    canonical = F.col("canonical")
    bare = F.replace(canonical, F.lit(WORD_MARK), F.lit(""))
    return (
        with_decoded(vocab, families)
        .withColumns(
            {
                "canonical": F.when(family == "sentencepiece", sp).when(family == "wordpiece", wp).otherwise(bpe),
                "bow": F.when(family == "sentencepiece", sp_bow)
                .when(family == "wordpiece", wp_bow)
                .otherwise(bpe_bow),
            }
        )
        .withColumns({"fuzzy": F.lower(bare), "uncased": F.lower(canonical), "no_ws": bare})
    )


def flag_symbols(forms: DataFrame) -> DataFrame:
    """Adds ``is_symbol``: the fuzzy form is a special token of the same
    vocabulary, a number, punctuation (or empty) or white space."""
    specials = (
        forms.where("is_special")
        .select("vocab", F.col("token").alias("fuzzy"))
        .distinct()
        .withColumn("_special", F.lit(True))
    )
    return (
        forms.join(specials, ["vocab", "fuzzy"], "left")
        .withColumn("is_symbol", F.coalesce("_special", F.lit(False)) | is_symbol_text(F.col("fuzzy")))
        .drop("_special")
    )
