"""Counting words and learning vocabularies from a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraft.functions.text import WORD_MARK, encode_byte_level, split_words
from lexigraft.operators.ranking import number_rows, top_n
from lexigraft.session import DEFAULT_LIMITS, Limits

# Special tokens in id order.
SPECIAL_TOKENS = ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]
WORDPIECE_SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
BPE_SPECIALS = ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]


def count_words(corpus: DataFrame) -> DataFrame:
    """``(lang, w, n)``: occurrences of every word of ``corpus(lang, text)``."""
    return (
        corpus.select("lang", F.explode(split_words(F.col("text"))).alias("w"))
        .groupBy("lang", "w")
        .agg(F.count("*").alias("n"))
    )


def count_characters(words: DataFrame) -> DataFrame:
    """``(lang, ch, n)``: occurrences of every character."""
    return (
        words.select("lang", F.explode(F.split("w", "")).alias("ch"), "n")
        .where(F.col("ch") != "")
        .groupBy("lang", "ch")
        .agg(F.sum("n").alias("n"))
    )


def _ranked(
    pieces: DataFrame, sizes: dict[str, int], limits: Limits
) -> DataFrame:
    """Ids by (group, count descending, token), cut at the size of each vocabulary."""
    longest = max(sizes.values())
    numbered = number_rows(
        pieces,
        ["vocab"],
        [F.col("g"), F.col("n").desc(), F.col("token")],
        "id",
        limits,
        small=longest <= limits.window_rows,
    )
    size_of = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    return numbered.where(F.col("id") < F.element_at(size_of, F.col("vocab")))


def _specials(langs: DataFrame, tokens: list[str]) -> DataFrame:
    return langs.select(
        F.col("lang").alias("vocab"),
        F.posexplode(F.lit(tokens)).alias("pos", "token"),
    ).select("vocab", "token", (-F.col("pos")).cast("bigint").alias("n"), F.lit(0).alias("g"))


def learn_vocab(
    words: DataFrame,
    sizes: dict[str, int],
    n_chars: int | None = None,
    specials: list[str] | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Frequency-ranked word vocabulary with the given size per language.

    Order: special tokens, the lone word mark, the characters by frequency (only
    the ``n_chars`` most frequent if given), then whole words with the mark in
    front. Columns ``vocab, token, id,
    decoded, is_special, n``.
    """
    specials = SPECIAL_TOKENS if specials is None else specials
    words = words.where(F.col("lang").isin(*sizes))
    chars = count_characters(words).where(F.col("ch") != WORD_MARK)
    if n_chars is not None:
        # Distinct characters are bounded by Unicode, so one window per language does.
        frequent = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("ch"))
        chars = chars.withColumn("_rn", F.row_number().over(frequent)).where(F.col("_rn") <= n_chars)
    whole = top_n(words, ["lang"], [F.col("n").desc(), F.col("w")], max(sizes.values()), limits)
    langs = words.sparkSession.createDataFrame([(k,) for k in sizes], "lang string")
    pieces = (
        _specials(langs, specials)
        .unionByName(
            langs.select(
                F.col("lang").alias("vocab"),
                F.lit(WORD_MARK).alias("token"),
                F.lit(0).cast("bigint").alias("n"),
                F.lit(1).alias("g"),
            )
        )
        .unionByName(chars.select(F.col("lang").alias("vocab"), F.col("ch").alias("token"), "n", F.lit(2).alias("g")))
        .unionByName(
            whole.select(
                F.col("lang").alias("vocab"), F.concat(F.lit(WORD_MARK), "w").alias("token"), "n", F.lit(3).alias("g")
            )
        )
    )
    return _ranked(pieces, sizes, limits).select(
        "vocab",
        "token",
        "id",
        F.replace("token", F.lit(WORD_MARK), F.lit(" ")).alias("decoded"),
        (F.col("g") == 0).alias("is_special"),
        "n",
    )


def frequent_words(words: DataFrame, min_count: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """All words that occur ``min_count`` times, as marked pieces numbered by frequency within their language."""
    kept = words.where(F.col("n") >= min_count).select(
        F.col("lang").alias("vocab"),
        F.concat(F.lit(WORD_MARK), "w").alias("token"),
        F.concat(F.lit(" "), "w").alias("decoded"),
        F.lit(False).alias("is_special"),
        "n",
    )
    return number_rows(kept, ["vocab"], [F.col("n").desc(), F.col("token")], "id", limits)


def learn_wordpiece_vocab(
    words: DataFrame, sizes: dict[str, int], suffix_length: int = 3, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Word starts without a mark and word ends as ``##`` pieces, by frequency."""
    words = words.where(F.col("lang").isin(*sizes))
    endings = (
        words.where(F.length("w") > suffix_length)
        .groupBy("lang", F.right("w", F.lit(suffix_length)).alias("e"))
        .agg(F.sum("n").alias("n"))
    )
    pieces = words.select("lang", F.col("w").alias("token"), "n").unionByName(
        endings.select("lang", F.concat(F.lit("##"), "e").alias("token"), "n")
    )
    kept = top_n(
        pieces.groupBy("lang", "token").agg(F.sum("n").alias("n")),
        ["lang"],
        [F.col("n").desc(), F.col("token")],
        max(sizes.values()),
        limits,
    )
    langs = words.sparkSession.createDataFrame([(k,) for k in sizes], "lang string")
    pieces = _specials(langs, WORDPIECE_SPECIALS).unionByName(
        kept.where(~F.col("token").isin(WORDPIECE_SPECIALS)).select(
            F.col("lang").alias("vocab"), "token", "n", F.lit(1).alias("g")
        )
    )
    return _ranked(pieces, sizes, limits).select(
        "vocab", "token", "id", F.lit(None).cast("string").alias("decoded"), (F.col("g") == 0).alias("is_special"), "n"
    )


def learn_bpe_vocab(words: DataFrame, sizes: dict[str, int], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Single bytes of the corpus and whole words in the byte-level alphabet,
    the words with and without a leading space."""
    words = words.where(F.col("lang").isin(*sizes))
    hexed = F.hex(F.encode("w", "utf-8"))
    single = (
        words.select("lang", "n", F.explode(F.split(encode_byte_level(F.col("w")), "")).alias("token"))
        .where(F.col("token") != "")
        .groupBy("lang", "token")
        .agg(F.sum("n").alias("n"))
    )
    whole = top_n(words, ["lang"], [F.col("n").desc(), F.col("w")], max(sizes.values()), limits)
    spaced = whole.where(F.length(hexed) > 2).select("lang", encode_byte_level(F.col("w")).alias("token"), "n")
    starts = whole.select("lang", encode_byte_level(F.concat(F.lit(" "), "w")).alias("token"), "n")
    langs = words.sparkSession.createDataFrame([(k,) for k in sizes], "lang string")
    pieces = (
        _specials(langs, BPE_SPECIALS)
        .unionByName(single.select(F.col("lang").alias("vocab"), "token", "n", F.lit(1).alias("g")))
        .unionByName(
            starts.unionByName(spaced)
            .where(~F.col("token").isin(BPE_SPECIALS))
            .select(F.col("lang").alias("vocab"), "token", "n", F.lit(2).alias("g"))
        )
    )
    return _ranked(pieces, sizes, limits).select(
        "vocab", "token", "id", F.lit(None).cast("string").alias("decoded"), (F.col("g") == 0).alias("is_special"), "n"
    )


def byte_pieces(words: DataFrame) -> DataFrame:
    """``(vocab, token, n)``: byte-fallback pieces ``<0xHH>`` of the bytes in the corpus."""
    pairs = F.regexp_extract_all(F.hex(F.encode("w", "utf-8")), F.lit("(..)"), 1)
    return (
        words.select(F.col("lang").alias("vocab"), F.explode(pairs).alias("h"), "n")
        .groupBy("vocab", "h")
        .agg(F.sum("n").alias("n"))
        .select("vocab", F.concat(F.lit("<0x"), "h", F.lit(">")).alias("token"), "n")
    )


def extend_vocab(
    source: DataFrame,
    added: DataFrame,
    names: list[str],
    limits: Limits = DEFAULT_LIMITS,
    small: bool | None = None,
) -> DataFrame:
    """All tokens of ``source``, which is one vocabulary, with their ids, then the tokens of
    an ``added`` vocabulary not among them, with ids continuing in the order of their ids.

    One extended vocabulary per name in ``names``, called like the vocabulary
    that was added.
    """
    if source.select("vocab").distinct().limit(2).count() > 1:
        raise ValueError("extend one source vocabulary at a time")
    base = source.withColumn("vocab", F.explode(F.lit(names)))
    fresh = added.where(F.col("vocab").isin(names)).join(source.select("token"), "token", "left_anti")
    size = source.agg(F.max("id") + 1).scalar()
    numbered = number_rows(fresh, ["vocab"], [F.col("id")], "_rn", limits, small)
    return base.unionByName(numbered.withColumn("id", F.col("_rn") + size).drop("_rn"))
