"""Learning subword vocabularies by merges of the most frequent neighbours.

Counted words stay where they are; only counts of neighbouring symbols are kept, and changed by what each round adds
and takes away. A round makes all merges that one after the other would make as well: they do not touch each other's
neighbours, and no new pair can overtake them. Only words that hold a merged string are cut again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraft.functions.text import WORD_MARK
from lexigraft.operators.ranking import top_n
from lexigraft.operators.vocab_learning import SPECIAL_TOKENS
from lexigraft.session import DEFAULT_LIMITS, Limits, materialize

#: Pairs looked at in a round, and merges made in it at most. They decide the number of rounds only.
CANDIDATES, ROUND_MERGES = 256, 64

PAIR_SCHEMA = "lang string, a int, b int, cnt bigint"
MERGE_SCHEMA = "vocab string, rank int, left string, right string, token string, cnt bigint"


@dataclass
class Merges:
    """Symbols of one vocabulary by number, characters first and by code point, and the merges so far."""

    symbols: list[str]
    pairs: list[tuple[int, int, int]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    done: bool = False

    def __post_init__(self):
        self.number = {s: k for k, s in enumerate(self.symbols)}

    def merged(self, a: int, b: int) -> str:
        return self.symbols[a] + self.symbols[b]

    def add(self, a: int, b: int, count: int) -> None:
        token = self.merged(a, b)
        if token not in self.number:
            self.number[token] = len(self.symbols)
            self.symbols.append(token)
        self.pairs.append((a, b, self.number[token]))
        self.counts.append(count)


def ranks_of(merges: Merges) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(rank, merged symbol) of every pair, ascending; a pair can be merged again after other merges have made it anew."""
    ranks: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for rank, (a, b, c) in enumerate(merges.pairs):
        ranks.setdefault((a, b), []).append((rank, c))
    return ranks


def cut(symbols: list[int], ranks: dict, first: int, last: int) -> list[int]:
    """Makes the merges of ranks ``first`` to ``last`` (exclusive) one after the other, each from the left."""
    while len(symbols) > 1:
        best = last, 0, 0, 0
        for pair in zip(symbols, symbols[1:]):
            for rank, merged in ranks.get(pair, ()):
                if rank >= first:
                    best = min(best, (rank, *pair, merged))
                    break
        rank, a, b, merged = best
        if rank >= last:
            break
        out, i = [], 0
        while i < len(symbols):
            if symbols[i] == a and i + 1 < len(symbols) and symbols[i + 1] == b:
                out.append(merged)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols, first = out, rank + 1
    return symbols


def choose(candidates: list[tuple[int, int, int, int, int]], known: Merges, most: int) -> list[tuple[int, int, int]]:
    """The merges of a round, out of ``(count, a, b, most before a, most after b)`` in the order of preference.

    A merge of (a, b) changes counts of other pairs only where they overlap it: pairs that end with a or start with
    b. What it makes anew counts at most its own count, and at most what stands before a or after b. The list
    ends where a pair overlaps an earlier one or is rarer than what that may have made; among equals older symbols come
    first, so a new symbol does not overtake. A merge whose string is a symbol already adds to pairs of that
    symbol and ends the list too.
    """
    chosen: list[tuple[int, int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    names: set[str] = set()
    bound = 0
    for count, a, b, before, after in candidates[:most]:
        name = known.merged(a, b)
        if chosen and (count < bound or b in lefts or a in rights or name in names):
            break
        chosen.append((a, b, count))
        if name in known.number:
            break
        lefts.add(a)
        rights.add(b)
        names.add(name)
        bound = max(bound, min(count, before), min(count, after))
    return chosen


def _changes(words: DataFrame, state: dict[str, Merges], first: dict[str, int]) -> DataFrame:
    """How the counts of pairs change by the merges from ``first`` on: ``(lang, a, b, cnt)``, added up per task."""
    shared = words.sparkSession.sparkContext.broadcast(
        {lang: (m.number, ranks_of(m), first.get(lang, 0), len(m.pairs)) for lang, m in state.items()}
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changed: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                number, ranks, start, end = shared.value[lang]
                before = cut([number[c] for c in word], ranks, 0, start)
                after = cut(before, ranks, start, end)
                if len(after) < len(before):
                    for pair in zip(before, before[1:]):
                        changed[lang, *pair] -= n
                    for pair in zip(after, after[1:]):
                        changed[lang, *pair] += n
        rows = [(*key, n) for key, n in changed.items() if n]
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "a", "b", "cnt"])

    return words.select("lang", "word", "n").mapInArrow(run, PAIR_SCHEMA)


def _candidates(counts: DataFrame, limits: Limits) -> dict[str, list[tuple]]:
    """The most frequent pairs of each vocabulary, in order, with the most frequent pairs before and after them."""
    order = [F.col("cnt").desc(), F.greatest("a", "b"), F.col("a"), F.col("b")]
    best = top_n(counts, ["lang"], order, CANDIDATES, limits)
    before = counts.groupBy("lang", F.col("b").alias("a")).agg(F.max("cnt").alias("before"))
    after = counts.groupBy("lang", F.col("a").alias("b")).agg(F.max("cnt").alias("after"))
    rows = best.join(before, ["lang", "a"], "left").join(after, ["lang", "b"], "left").fillna(0, ["before", "after"]).collect()
    found: dict[str, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (-r["cnt"], max(r["a"], r["b"]), r["a"], r["b"])):
        found.setdefault(r["lang"], []).append((r["cnt"], r["a"], r["b"], r["before"], r["after"]))
    return found


def _holding(strings: dict[str, list[str]]) -> Column:
    """Words of a language that hold one of its strings."""
    conditions = [
        (F.col("lang") == lang) & reduce(Column.__or__, [F.contains("word", F.lit(s)) for s in given])
        for lang, given in strings.items()
    ]
    return reduce(Column.__or__, conditions)


def learn_merges(words: DataFrame, sizes: dict[str, int], min_count: int = 2, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The first merges of each language: ``(vocab, rank, left, right, token, cnt)``.

    ``words(lang, w, n)`` are counted words, ``sizes`` the number of merges per language; learning ends earlier when
    no pair occurs ``min_count`` times. A word starts as its characters behind the word mark. Each merge joins the
    most frequent pair of neighbours, of equals the one with the oldest symbols (characters by code point, then merges
    by rank), in all words from the left; the result is that of one merge after the other. Null words and languages
    are left out; words of equal spelling count together.

    Per round one pass over the words and one sum over the pairs; all languages go in the same rounds. The driver
    holds the merges, and some candidates per language.
    """
    spark = words.sparkSession
    known = words.where(F.col("lang").isin(*sizes) & F.col("w").isNotNull())
    counted = materialize(known.select("lang", F.concat(F.lit(WORD_MARK), "w").alias("word"), "n"), "spelled")
    characters = counted.select("lang", F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''")
    alphabet: dict[str, list[str]] = {}
    for lang, c in characters.distinct().collect():
        alphabet.setdefault(lang, []).append(c)
    state = {lang: Merges(sorted(found)) for lang, found in alphabet.items()}
    if not state:
        return spark.createDataFrame([], MERGE_SCHEMA)
    numbers = F.create_map(
        *[x for lang, m in state.items() for x in (F.lit(lang), F.create_map(*[y for c, k in m.number.items() for y in (F.lit(c), F.lit(k))]))]
    )
    symbols = F.filter(F.split("word", ""), lambda c: c != "")
    spelled = counted.select("lang", "n", F.transform(symbols, lambda c: F.element_at(F.element_at(numbers, F.col("lang")), c)).alias("s"))
    neighbours = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = spelled.select("lang", "n", F.explode(neighbours).alias("p")).groupBy("lang", "p.a", "p.b").agg(F.sum("n").alias("cnt"))
    counts = materialize(pairs, "pair-counts")
    while True:
        first: dict[str, int] = {}
        new: dict[str, list[str]] = {}
        for lang, candidates in _candidates(counts.where(F.col("lang").isin(*[k for k, m in state.items() if not m.done])), limits).items():
            merges = state[lang]
            first[lang] = len(merges.pairs)
            frequent = [c for c in candidates if c[0] >= min_count]
            for a, b, count in choose(frequent, merges, min(ROUND_MERGES, sizes[lang] - len(merges.pairs))):
                merges.add(a, b, count)
                new.setdefault(lang, []).append(merges.merged(a, b))
        for lang, merges in state.items():
            merges.done = merges.done or lang not in new or len(merges.pairs) >= sizes[lang]
        if all(m.done for m in state.values()):
            break
        changes = _changes(counted.where(_holding(new)), state, first)
        summed = counts.unionByName(changes).groupBy("lang", "a", "b").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
        counts = materialize(summed, "pair-counts")
    rows = [
        (lang, rank, m.symbols[a], m.symbols[b], m.symbols[c], n)
        for lang, m in state.items()
        for rank, ((a, b, c), n) in enumerate(zip(m.pairs, m.counts))
    ]
    return spark.createDataFrame(rows, MERGE_SCHEMA)


def merge_vocab(words: DataFrame, merges: DataFrame, specials: list[str] | None = None) -> DataFrame:
    """``(vocab, token, id, decoded, is_special)`` of learned merges: special tokens, the word mark and the characters
    of the words by code point, then merged pieces by rank, a piece made twice only once."""
    specials = SPECIAL_TOKENS if specials is None else specials
    langs = merges.select(F.col("vocab").alias("lang")).distinct()
    first = langs.select(F.col("lang").alias("vocab"), F.posexplode(F.lit(specials)).alias("at", "token")).withColumn("g", F.lit(0))
    characters = (
        words.join(langs, "lang", "left_semi")
        .select(F.col("lang").alias("vocab"), F.explode(F.array_distinct(F.split(F.concat(F.lit(WORD_MARK), "w"), ""))).alias("token"))
        .where("token <> ''").distinct().select("vocab", F.lit(0).alias("at"), "token", F.lit(1).alias("g"))
    )
    made = merges.groupBy("vocab", "token").agg(F.min("rank").alias("at")).select("vocab", "at", "token", F.lit(2).alias("g"))
    pieces = first.unionByName(characters).unionByName(made)
    # A vocabulary's characters and merges, both bounded by its size.
    order = Window.partitionBy("vocab").orderBy("g", "at", "token")
    return pieces.select(
        "vocab",
        "token",
        (F.row_number().over(order) - 1).cast("bigint").alias("id"),
        F.replace("token", F.lit(WORD_MARK), F.lit(" ")).alias("decoded"),
        (F.col("g") == 0).alias("is_special"),
    )
