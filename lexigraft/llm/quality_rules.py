"""Quality rules on whole texts with DataFrame functions only: counts, and divergence from language references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraft.llm.common import WORD_SPACE
from lexigraft.session import materialize

#: Very common words by language. Fixed values.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in a is that for it as was with be by on not he this are",
    "es": "de la que el en y a los se del las un por con no una su para es al",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au",
}
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Limits. A document is judged by a histogram only if it is long enough for it."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    min_chars_judged: int = 200
    max_char_distance: float = 0.25
    min_words_judged: int = 80
    max_word_distance: float = 0.28
    common_words: dict[str, str] = field(default_factory=lambda: dict(COMMON_WORDS))


def _word_list(lang: Column, common: dict[str, str]) -> Column:
    lists = F.array().cast("array<string>")
    for name, words in sorted(common.items()):
        lists = F.when(lang == name, F.array(*map(F.lit, words.split()))).otherwise(lists)
    return lists


def document_statistics(
    docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Counts of every text, one row per input row; null texts count as empty, a null language as "".

    Returns ``(id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars ARRAY, words ARRAY)``:
    the last two are histograms over character classes (lower case and other, upper case, digits, space,
    symbols, punctuation, beyond ASCII) and over the language's common words plus all others. Repetition
    inside a text is found by sorting hashes of its windows: no step takes quadratic time.
    """
    k = rules.window
    base = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(text_col, F.lit("")).alias("t"),
    )
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    with_words = base.select(
        "id",
        "lang",
        F.length("t").cast("long").alias("n_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("[0-9]")).cast("long").alias("n_digit"),
        F.regexp_count("t", F.lit(r"[!\"'()+,\-./:;=?@\[\\\]^_`{}~]")).cast("long").alias("n_punct"),
        F.regexp_count("t", F.lit(r"[^\x00-\x7F]")).cast("long").alias("n_beyond"),
        lines.alias("lines"),
        F.array_remove(F.split("t", WORD_SPACE), "").alias("w"),
    )
    # A column that the next step reads more than once is computed once, also inside lambdas.
    position = F.transform("w", lambda x: F.array_position("list", F.lower(x)).cast("int"))
    hashed = with_words.withColumn("list", _word_list(F.col("lang"), rules.common_words)).select(
        "id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_chars",
        "n_symbols",
        "n_upper",
        "n_digit",
        "n_punct",
        "n_beyond",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("list").alias("n_list"),
        F.array_remove(position, 0).alias("common"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("hw"),
    )
    windows = F.when(
        F.size("hw") >= k,
        F.transform(F.sequence(F.lit(1), F.size("hw") - (k - 1)), lambda i: F.xxhash64(F.slice("hw", i, k))),
    ).otherwise(F.array().cast("array<bigint>"))
    windowed = hashed.withColumn("win", windows).drop("hw")
    repeated = F.when(
        F.size(F.array_distinct("win")) < F.size("win"),
        F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    sorted_windows = windowed.withColumn("s", repeated).drop("win")
    again = F.filter("s", lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]))
    starts = sorted_windows.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(k), F.coalesce(F.get("p", i + 1) - x, F.lit(k)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    n_space = F.col("n_chars") - F.col("word_chars")
    classes = ["n_upper", "n_digit", n_space, "n_symbols", "n_punct", "n_beyond"]
    classes = [F.col(c) if isinstance(c, str) else c for c in classes]
    rest = F.col("n_chars")
    for c in classes:
        rest = rest - c
    # How often each common word stands: what is gone when it is removed.
    words = F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("n_list"), F.lit(1))),
        lambda i: (F.size("common") - F.size(F.array_remove("common", i))).cast("long"),
    )
    return starts.select(
        "id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(rest, *classes).alias("chars"),
        F.when(F.col("n_list") == 0, F.array().cast("array<bigint>"))
        .otherwise(F.concat(words, F.array(F.col("n_words") - F.size("common"))))
        .alias("words"),
    )


def _shares(counts: Column | str) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: Column | str, q: Column | str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def language_references(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``(lang, ref_chars, ref_words)``: histograms over all documents of each language, as shares."""

    def total(name: str, n: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0)) for i in range(n)])

    longest = max((len(w.split()) for w in rules.common_words.values()), default=0) + 1
    sums = stats.groupBy("lang").agg(total("chars", 7).alias("c"), total("words", longest).alias("w"))
    return sums.select("lang", _shares("c").alias("ref_chars"), _shares("w").alias("ref_words"))


def judge_quality(
    docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Counts, distances and verdict for every input row.

    Adds to the statistics: ``char_distance`` and ``word_distance`` (null where the text is too short or
    the language has no list), ``base_failed`` (too few words, or too many in repeated windows) and ``kept``.
    Texts below the length guards are judged by the base rules alone. The references cover all documents of
    a language; the statistics are written once, so that texts are parsed once. An empty table gives no rows.
    """
    stats = materialize(document_statistics(docs, rules, id_col, text_col, lang_col), "quality")
    references = materialize(language_references(stats, rules), "references")
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    judged = stats.join(references, "lang").select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(n_chars >= rules.min_chars_judged, js_distance(_shares("chars"), F.col("ref_chars"))).alias(
            "char_distance"
        ),
        F.when(
            (F.col("n_words") >= rules.min_words_judged) & (F.size("words") > 0),
            js_distance(_shares("words"), F.slice("ref_words", F.lit(1), F.size("words"))),
        ).alias("word_distance"),
    )
    off = (F.coalesce("char_distance", F.lit(0.0)) > rules.max_char_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance
    )
    return judged.withColumn("kept", ~F.col("base_failed") & ~off)
