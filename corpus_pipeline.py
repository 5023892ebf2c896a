"""A corpus pipeline out of five of the operators: from ``documents`` to token counts of what is worth keeping.

Each stage takes all that its predecessor kept. Decisions are held per (document id, text), so two texts under
one id are decided each on its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraft.llm.bpe import BpeModel, decode_ids, encode_texts
from lexigraft.llm.common import read_table, sized
from lexigraft.llm.decontamination import find_contained
from lexigraft.llm.line_dedup import without_repeated_lines
from lexigraft.llm.near_duplicates import near_duplicate_classes
from lexigraft.llm.quality_rules import judge_quality
from lexigraft.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds what a decision is held by; null ids sort last."""
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("row"))
    return docs.select(*COLUMNS, key.alias("_key"))


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose key is not among the rejected ones, whose number is checked before they are sent around."""
    gone = materialize(rejected.select("_key").distinct(), "rejected")
    return keyed.join(sized(gone, 32), "_key", "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    keyed = _keyed(docs)
    return _without(keyed, judge_quality(keyed, id_col="_key").where("NOT kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and with them the documents of which no word is left."""
    cut = without_repeated_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("n_chars"))
    return cut.where(~F.coalesce(emptied, F.lit(False))).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.cast("long").alias("n_chars")
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once."""
    keyed = _keyed(docs)
    classes = materialize(near_duplicate_classes(keyed, id_col="_key"), "classes")
    repeated = classes.where("kept").groupBy("_key").count().where("count > 1").select("_key")
    repeated = materialize(repeated, "repeated-rows")
    stay = _without(keyed, classes.where("NOT kept"))
    side = sized(repeated, 32)
    once = _keyed(stay).join(side, "_key", "left_anti").select(*COLUMNS)
    return once.unionByName(_keyed(stay).join(side, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    keyed = _keyed(docs)
    return _without(keyed, find_contained(keyed, read_table(spark, sf_dir, "benchmark"), id_col="_key"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its number of tokens and digests of its ids and of the decoded text."""
    model = BpeModel.load(public_tokenizers.path("word_bpe_49k.json"))
    about = F.struct("doc_id", "lang", "source", "n_chars").alias("about")
    decoded = decode_ids(encode_texts(docs.select(about, "text"), model, id_col="about"), model, id_col="about")
    return decoded.select(
        "about.*",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_round_trip", bpe_round_trip),
]

#: SQL has neither the tokenizer nor a usable form of the edit join; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
