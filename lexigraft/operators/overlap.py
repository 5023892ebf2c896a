"""Matching target tokens to source tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraft.operators.ranking import number_rows, top_n
from lexigraft.operators.vocab_forms import flag_symbols
from lexigraft.session import DEFAULT_LIMITS, Limits, per_name


# Names of the rules in results.
SYMBOL, EXACT, FUZZY = "numerical_symbol", "exact_match", "fuzzy_match"


def _view_order(key: str) -> list[Column]:
    """Order of the tokens that share a key: tokens whose canonical form is the
    key by id descending, then the others by id ascending."""
    other = F.col("canonical") != F.col(key)
    return [other.cast("int"), F.when(other, F.col("id")).otherwise(-F.col("id"))]


def first_by_key(forms: DataFrame, key: str) -> DataFrame:
    """``(vocab, key, src_id, src_token, n_sources)``: one row per key.

    Reduced before any join, so a key shared by very many tokens neither fans
    out nor travels: the aggregate combines on the map side.
    """
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_view_order(key))])
    return (
        forms.groupBy("vocab", key)
        .agg(F.min_by(F.struct("id", "token"), order).alias("_first"), F.count("*").alias("n_sources"))
        .select("vocab", key, F.col("_first.id").alias("src_id"), F.col("_first.token").alias("src_token"), "n_sources")
    )


def vocab_view(forms: DataFrame, key: str, limits: Limits = DEFAULT_LIMITS, small: bool | None = None) -> DataFrame:
    """The whole view as rows ``(vocab, key, pos, id, token)``, position 0 being
    the token that a match takes."""
    numbered = number_rows(forms, ["vocab", key], _view_order(key), "pos", limits, small)
    return numbered.select("vocab", F.col(key).alias("key"), "pos", "id", "token")


def match_tokens(
    target: DataFrame,
    source: DataFrame,
    exact_match_all: bool = True,
    match_symbols: bool = False,
    fuzzy_match_all: bool = False,
) -> DataFrame:
    """Every target token with the first rule that matches it.

    ``target`` holds token forms with ``pair_id`` and the name of its ``source``
    vocabulary, ``source`` token forms keyed by ``vocab``. Added columns:
    ``match_kind`` (``numerical_symbol``, ``exact_match``, ``fuzzy_match`` or
    null for a new token), ``src_id``, ``src_token``, ``n_sources``.
    """
    none = F.lit(None)
    picked = "struct<src_id:bigint,src_token:string,n_sources:bigint>"

    def lookup(df: DataFrame, key: str, name: str) -> DataFrame:
        view = first_by_key(source, key).select(
            F.col("vocab").alias("source"), key, F.struct("src_id", "src_token", "n_sources").alias(name)
        )
        return df.join(view, ["source", key], "left")

    out = flag_symbols(target) if match_symbols else target.withColumn("is_symbol", F.lit(False))
    out = lookup(out, "canonical", "_exact") if exact_match_all or match_symbols else out.withColumn(
        "_exact", none.cast(picked)
    )
    out = lookup(out, "fuzzy", "_fuzzy") if fuzzy_match_all or match_symbols else out.withColumn(
        "_fuzzy", none.cast(picked)
    )
    exact, fuzzy = F.col("_exact"), F.col("_fuzzy")
    either = F.coalesce(exact, fuzzy)
    symbol_rule = F.col("is_symbol") & either.isNotNull()
    exact_rule = F.lit(exact_match_all) & exact.isNotNull()
    fuzzy_rule = F.lit(fuzzy_match_all) & fuzzy.isNotNull()
    return (
        out.withColumn(
            "match_kind",
            F.when(symbol_rule, SYMBOL).when(exact_rule, EXACT).when(fuzzy_rule, FUZZY),
        )
        .withColumn("_src", F.when(symbol_rule, either).when(exact_rule, exact).when(fuzzy_rule, fuzzy))
        .select(
            *[c for c in target.columns],
            "is_symbol",
            "match_kind",
            F.col("_src.src_id").alias("src_id"),
            F.col("_src.src_token").alias("src_token"),
            F.col("_src.n_sources").alias("n_sources"),
        )
    )


def new_tokens_exact(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target tokens without an exact match, as an anti-join."""
    keys = source.select(F.col("vocab").alias("source"), "canonical")
    return target.join(keys, ["source", "canonical"], "left_anti")


def multi_source(
    matched: DataFrame, source: DataFrame, names: int = 5, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Exact and fuzzy matches with more than one source token, and the first names.

    ``(pair_id, id, token, n_sources, src_tokens)``. Only the first ``names``
    rows of a key are ever brought together.
    """
    several = matched.where("n_sources > 1")

    def named(rows: DataFrame, key: str) -> DataFrame:
        wanted = rows.select(F.col("source").alias("vocab"), key).distinct()
        order = _view_order(key)
        members = source.join(wanted, ["vocab", key], "left_semi").select("vocab", "canonical", "fuzzy", "id", "token")
        first = top_n(members, ["vocab", key], order, names, limits)
        listed = first.groupBy("vocab", key).agg(
            F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "token"))).alias("l")
        )
        tokens = listed.select(F.col("vocab").alias("source"), key, F.col("l.token").alias("src_tokens"))
        return rows.join(tokens, ["source", key]).select("pair_id", "id", "token", "n_sources", "src_tokens")

    # A symbol match uses the exact key when the source has it, as an exact match does.
    exact_keys = source.select(F.col("vocab").alias("source"), "canonical").distinct().withColumn("_hit", F.lit(True))
    routed = several.join(exact_keys, ["source", "canonical"], "left")
    by_exact = (F.col("match_kind") == EXACT) | (
        (F.col("match_kind") == SYMBOL) & F.coalesce("_hit", F.lit(False))
    )
    return named(routed.where(by_exact), "canonical").unionByName(named(routed.where(~by_exact), "fuzzy"))


def with_pairs(vocab: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Attaches ``pair_id`` and ``source`` to target vocabularies.

    ``pairs`` lists (pair_id, source vocabulary, target vocabulary).
    """
    names = vocab.sparkSession.createDataFrame(
        [(p, s, t) for p, s, t in pairs], "pair_id string, source string, vocab string"
    )
    return vocab.join(per_name(names), "vocab")
