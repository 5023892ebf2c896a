"""Readers of corpora, vocabularies and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraft.session import per_name, spread_small

VOCAB_SCHEMA = "vocab string, token string, id bigint, decoded string, is_special boolean"
SCORED_SCHEMA = f"{VOCAB_SCHEMA}, score double"
EMBEDDING_SCHEMA = "vocab string, matrix string, id bigint, vector array<float>"
VECTOR_SCHEMA = "vocab string, token string, vector array<double>"
WORD_VECTOR_SCHEMA = "lang string, word string, vector array<double>"


FORMATS = {"txt": "text", "json": "json", "jsonl": "json", "parquet": "parquet"}
COMPRESSIONS = ("gz", "bz2", "zst", "lz4", "snappy", "deflate")


def corpus_format(path: str) -> str:
    """Format of a file or pattern by its ending, behind which a compression's may stand."""
    parts = path.rstrip("/*").rsplit("/", 1)[-1].lower().split(".")
    if len(parts) > 2 and parts[-1] in COMPRESSIONS:
        parts.pop()
    found = FORMATS.get(parts[-1])
    if found is None:
        raise ValueError(f"unknown corpus format: {path}")
    return found


def read_corpus(
    spark: SparkSession, path: str, lang: str | None = None, format: str | None = None, corrupt: str = "fail"
) -> DataFrame:
    """Samples of a corpus as ``text`` (and ``lang`` if given).

    ``text``: one sample per line. ``json``: the field ``text`` of every line.
    ``parquet``: the column ``text``. Files may be compressed; a folder or pattern
    without an ending needs ``format``. A broken JSON line and a sample without
    ``text`` are errors; with ``corrupt="keep"`` they come back in a column
    ``corrupt`` with a null text, to be counted.
    """
    kind = format or corpus_format(path)
    if corrupt not in ("fail", "keep"):
        raise ValueError(f"corrupt must be 'fail' or 'keep', not {corrupt!r}")
    if kind == "text":
        df = spark.read.text(path).select(F.col("value").alias("text"))
    elif kind == "json" and corrupt == "keep":
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
        df = spark.read.options(**options).schema("text string, corrupt string").json(path)
    elif kind == "json":
        df = spark.read.option("mode", "FAILFAST").schema("text string").json(path)
    elif kind == "parquet":
        df = spark.read.parquet(path).select("text")
    else:
        raise ValueError(f"unknown corpus format: {kind}")
    if corrupt == "fail":
        missing = F.raise_error(F.lit(f"a sample without text in {path}")).cast("string")
        df = df.withColumn("text", F.when(F.col("text").isNull(), missing).otherwise(F.col("text")))
    df = spread_small(df)
    return df if lang is None else df.select(F.lit(lang).alias("lang"), *df.columns)


def read_vocab(spark: SparkSession, path: str, scored: bool = False) -> DataFrame:
    """A vocabulary; ``scored`` ones have a ``score`` per piece, for segmentation by the best score."""
    return spark.read.schema(SCORED_SCHEMA if scored else VOCAB_SCHEMA).parquet(path)


def duplicate_entries(vocab: DataFrame) -> DataFrame:
    """Ids and tokens that occur more than once in a vocabulary: ``(vocab, key, n)``."""
    ids = vocab.groupBy("vocab", F.concat(F.lit("id "), F.col("id").cast("string")).alias("key")).count()
    tokens = vocab.groupBy("vocab", F.concat(F.lit("token "), "token").alias("key")).count()
    return ids.unionByName(tokens).where("count > 1").withColumnRenamed("count", "n")


def require_unique(vocab: DataFrame) -> None:
    """An error if an id or a token stands twice in one vocabulary."""
    found = duplicate_entries(vocab).take(1)
    if found:
        raise ValueError(f"{found[0]['key']} is {found[0]['n']} times in vocabulary {found[0]['vocab']}")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDING_SCHEMA).parquet(path)


def read_token_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR_SCHEMA).parquet(path)


def read_word_vectors(spark: SparkSession, path: str, languages: list[str] | DataFrame) -> DataFrame:
    """Word vectors of some languages; the table is partitioned by ``lang``, so
    the other languages are not read.

    ``languages`` is a list or a table with a column ``lang``, such as the target side of a filtered table of
    pairs. The table's names are found when the job runs, and prune the scan then.
    """
    vectors = spark.read.schema(WORD_VECTOR_SCHEMA).parquet(path)
    if isinstance(languages, DataFrame):
        return vectors.join(per_name(languages.select("lang")), "lang", "left_semi")
    return vectors.where(F.col("lang").isin(languages))


def special_roles(maps: DataFrame) -> DataFrame:
    """``(vocab, role, token)`` from ``maps(vocab, json)``, for every role a map has.

    The value of a role is the token itself, an object with ``content``, or a list of
    both. Other values (switches, numbers, null, objects without ``content``) name no token.
    A null or empty map has none; text that is no JSON is an error.
    """
    parsed = maps.where(F.length(F.trim("json")) > 0).select("vocab", F.parse_json("json").alias("map"))
    spark = maps.sparkSession
    # One row per role: the schema of the maps is theirs, not this function's.
    roles = parsed.lateralJoin(spark.tvf.variant_explode(F.col("map").outer()))
    roles = roles.select("vocab", F.col("key").alias("role"), "value").where(F.col("role").isNotNull())
    values = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.array("value"))
    single = roles.select("vocab", "role", F.explode(values).alias("value"))
    kind = F.schema_of_variant("value")
    token = F.when(kind == "STRING", F.try_variant_get("value", "$", "string")).otherwise(
        F.try_variant_get("value", "$.content", "string")
    )
    return single.select("vocab", "role", token.alias("token")).where(F.col("token").isNotNull()).distinct()


def special_tokens(maps: DataFrame) -> DataFrame:
    """``(vocab, token)``: the tokens of :func:`special_roles`, each once."""
    return special_roles(maps).select("vocab", "token").distinct()


def read_special_roles(spark: SparkSession, pattern: str) -> DataFrame:
    """``(vocab, role, token)`` of the maps in tokenizer folders, one file each, named by the folders' paths."""
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    maps = spark.read.text(pattern, wholetext=True).select(folder.alias("vocab"), F.col("value").alias("json"))
    return special_roles(maps)


def read_special_tokens(spark: SparkSession, pattern: str) -> DataFrame:
    """Special tokens of tokenizer folders: ``(vocab, token)``."""
    return read_special_roles(spark, pattern).select("vocab", "token").distinct()
