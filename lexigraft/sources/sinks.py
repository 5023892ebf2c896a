"""Writers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexigraft.operators.lookup import COPIED, RANDOM, WEIGHTED, ZERO
from lexigraft.operators.segmentation import join_tokens


def write_tokenized(tokenized: DataFrame, path: str, as_text: bool = False) -> None:
    """Tokenised samples as parquet, or as lines of space-separated tokens."""
    if as_text:
        join_tokens(tokenized).select("text").write.text(path)
    else:
        tokenized.write.parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.parquet(path)


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.partitionBy("lang").parquet(path)


def write_matrix(result: DataFrame, path: str, pairs: Iterable[str] | None = None) -> list[tuple[str, str, int]]:
    """Target matrices by pair and matrix, every file holding a sorted range of ids.

    With the names of the ``pairs``, the rows are counted while they are written, and ``(pair_id, outcome, rows)`` of
    those there are comes back without another read. Rows of other pairs or outcomes are an error, found when all is
    written.
    """
    ranged = result.repartitionByRange("pair_id", "matrix", "id").sortWithinPartitions("pair_id", "matrix", F.col("id"))
    if pairs is None:
        ranged.write.partitionBy("pair_id", "matrix").parquet(path)
        return []
    groups = [(p, o) for p in sorted(set(pairs)) for o in (COPIED, WEIGHTED, RANDOM, ZERO)]
    counts = [F.count_if((F.col("pair_id") == p) & (F.col("outcome") == o)).alias(f"n{i}") for i, (p, o) in enumerate(groups)]
    # In the stage that writes: its tasks count once however often they run, and the sampling of the ranges is below.
    seen = Observation("written")
    ranged.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.partitionBy("pair_id", "matrix").parquet(path)
    got = seen.get
    found = [(p, o, got[f"n{i}"]) for i, (p, o) in enumerate(groups) if got[f"n{i}"]]
    if sum(n for _, _, n in found) != got["rows"]:
        raise ValueError(f"{got['rows']} rows written to {path}, {sum(n for _, _, n in found)} of them of the given pairs")
    return found


def write_special_maps(roles: DataFrame, path: str) -> None:
    """A special-token map per vocabulary out of ``roles(vocab, role, token, plain)``, one file each below ``vocab=…``.

    A role with ``plain`` is written as the token itself, one without as an object, and one with several
    tokens as a list. A vocabulary's map is one value, as long as its list of special tokens.
    """
    quoted = F.to_json(F.array("token"))
    value = F.when(F.col("plain"), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(
        F.to_json(F.struct(F.col("token").alias("content"), F.lit(False).alias("lstrip")))
    )
    by_role = roles.groupBy("vocab", "role").agg(F.array_sort(F.collect_set(value)).alias("values"))
    name = F.to_json(F.array("role"))
    text = F.when(F.size("values") == 1, F.get("values", F.lit(0))).otherwise(
        F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]"))
    )
    entry = F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(": "), text)
    maps = by_role.groupBy("vocab").agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("entries"))
    maps.select("vocab", F.concat(F.lit("{"), "entries", F.lit("}")).alias("value")).write.partitionBy("vocab").text(path)
