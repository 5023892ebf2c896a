"""Attaching source vectors, auxiliary vectors and membership to matched tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.functions.salting import every_salt, salt_of
from lexigraft.functions.vectors import is_usable
from lexigraft.session import DEFAULT_LIMITS, Limits, per_name

COPIED, WEIGHTED, RANDOM, ZERO = "copied", "weighted", "random", "zero"


def used_rows(parts: DataFrame, embeddings: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Source rows that ``parts(source, src_id)`` refers to, one copy per salt.

    Very many tokens can refer to the same source row; the salt spreads them.
    """
    vectors = embeddings.select(F.col("vocab").alias("source"), F.col("id").alias("src_id"), "matrix", "vector")
    used = vectors.join(parts.select("source", "src_id").distinct(), ["source", "src_id"], "left_semi")
    return used.withColumn("_salt", every_salt(limits.salts))


def or_missing(joined: DataFrame, key: str = "src_id") -> DataFrame:
    """``joined`` with an error for every row without a ``vector``."""
    what = F.concat(
        F.lit("no source vector for id "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" of "), F.coalesce("source", F.lit("null"))
    )
    kind = joined.schema["vector"].dataType
    return joined.withColumn(
        "vector", F.when(F.col("vector").isNull(), F.raise_error(what).cast(kind)).otherwise(F.col("vector"))
    )


def with_source_vectors(matched: DataFrame, embeddings: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Overlapping tokens with the vector of their first source token, one row per
    matrix. A source id without a row in the matrix is an error."""
    overlap = matched.where(F.col("match_kind").isNotNull())
    matrices = embeddings.select(F.col("vocab").alias("source"), "matrix").distinct()
    wanted = overlap.join(per_name(matrices), "source", "left").withColumn("_salt", salt_of(["pair_id", "id"], limits.salts))
    rows = used_rows(overlap, embeddings, limits)
    joined = wanted.join(rows, ["source", "matrix", "src_id", "_salt"], "left").drop("_salt")
    return or_missing(joined)


def flag_membership(matched: DataFrame, extend: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``in_extend``: the token is in the vocabulary that was added.

    Id 0 of that vocabulary counts as absent unless ``strict``.
    """
    members = extend if strict else extend.where(F.col("id") != 0)
    members = members.select("vocab", "token").withColumn("_member", F.lit(True))
    return (
        matched.join(members, ["vocab", "token"], "left")
        .withColumn("in_extend", F.coalesce("_member", F.lit(False)))
        .drop("_member")
    )


def with_auxiliary(
    matched: DataFrame, aux: DataFrame, extend: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Adds ``aux``, ``usable``, ``use_for_init`` and ``outcome``.

    The auxiliary vector is looked up by the native token. Overlapping tokens
    without a usable one are still copied but give no weight to others; new
    tokens without one are drawn at random.
    """
    flagged = (
        flag_membership(matched, extend, strict)
        if extend is not None
        else matched.withColumn("in_extend", F.lit(True))
    )
    # Grouped by what it is joined by: no further shuffle.
    vectors = aux.groupBy("vocab", "token").agg(F.first("vector").alias("aux"), F.count("*").alias("_n"))
    twice = F.raise_error(F.concat(F.lit("more than one auxiliary vector for "), F.coalesce("token", F.lit("null"))))
    one = F.when(F.col("_n") > 1, twice.cast(aux.schema["vector"].dataType)).otherwise(F.col("aux"))
    vectors = vectors.select("vocab", "token", one.alias("aux"))
    overlapping = F.col("match_kind").isNotNull()
    return (
        flagged.join(vectors, ["vocab", "token"], "left")
        .withColumn("usable", is_usable(F.col("aux")))
        .withColumns(
            {
                "use_for_init": overlapping & F.col("in_extend") & F.col("usable"),
                "outcome": F.when(overlapping, COPIED).when(F.col("usable"), WEIGHTED).otherwise(RANDOM),
            }
        )
    )
