"""Segmentation, tokenisation, co-occurrence and auxiliary vectors."""

import math
import random
import time
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraft.operators.cooccurrence import cooccurrence, corpus_cooccurrence, count_pairs, name_pairs, ppmi, project, projected
from lexigraft.operators.segmentation import (
    METHODS,
    Pieces,
    best_scored,
    count_tokens,
    greedy,
    join_tokens,
    segment_words,
    size_bins,
    tokenize_corpus,
    vocab_parts,
)
from lexigraft.operators.vocab_learning import count_words
from lexigraft.operators.wordlevel import token_vectors
from lexigraft.plans.auxiliary import aux_from_corpus, load_auxiliary
from lexigraft.session import Limits, materialize

NO_BROADCAST = Limits(broadcast_rows=0)
# Of the two vocabularies of the fixture: each alone, and only the smaller one.
APART, MIXED = Limits(broadcast_rows=13), Limits(broadcast_rows=5)
PIECES = ["▁", "a", "b", "c", "ab", "abc", "▁a", "▁ab", "bc", "ca", "▁cab"]


def all_cuts(word, pieces):
    """Every way to write a word as pieces, unknown characters alone."""
    if not word:
        yield []
        return
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in all_cuts(word[n:], pieces):
                yield [word[:n], *rest]


@settings(max_examples=150, deadline=None)
@given(st.text("abcx", max_size=7), st.integers(0, 10**6))
def test_scored_cut_is_the_best_of_all(word, seed):
    rng = random.Random(seed)
    scores = {p: rng.uniform(-9, -1) for p in PIECES}
    pieces = Pieces.build([(p, p, s) for p, s in scores.items()], "?")
    worst = min(scores.values()) - 10

    def value(cut):
        return sum(scores.get(p, worst) for p in cut)

    got = best_scored(word, pieces)
    best = max(value(c) for c in all_cuts(word, scores))
    assert sum(scores.get(p, worst) for p in got) == pytest.approx(best)


@settings(max_examples=150, deadline=None)
@given(st.text("abcx▁", max_size=9))
def test_greedy_takes_the_longest_piece(word):
    got = greedy(word, Pieces.build([(p, p, 0.0) for p in PIECES], "?"))
    rest = word
    for piece in got:
        longest = max((p for p in PIECES if rest.startswith(p)), key=len, default=None)
        assert piece == (longest or "?")
        rest = rest[len(longest or "x") :]
    assert rest == ""


@pytest.fixture
def vocab(spark):
    rows = [("xx", "<unk>", 0, True, 0.0), ("xx", "<s>", 1, True, 0.0)]
    rows += [("xx", p, i + 2, False, -1.0 - i % 4) for i, p in enumerate(PIECES)]
    rows += [("yy", "<unk>", 0, True, 0.0), ("yy", "▁", 1, False, -1.0), ("yy", "z", 2, False, -2.0)]
    return spark.createDataFrame(rows, "vocab string, token string, id bigint, is_special boolean, score double")


@pytest.fixture
def corpus(spark):
    rng = random.Random(5)
    texts = []
    for i in range(60):
        # A third of all words are the same one, and every third document is a copy.
        words = ["cab" if rng.random() < 0.34 else "".join(rng.choice("abcx") for _ in range(rng.randint(1, 6))) for _ in range(20)]
        texts.append((i, "xx", "cab cab ab" if i % 3 == 0 else " ".join(words)))
    texts += [(100, "yy", "zz qz　z"), (101, "xx", ""), (102, "xx", None)]
    return spark.createDataFrame(texts, "doc_id int, lang string, text string")


def plain_greedy(word, tokens, mark=""):
    """Longest first by trying every length; pieces behind the first character bear ``mark``."""
    out, at = [], 0
    while at < len(word):
        ends = [e for e in range(len(word), at, -1) if (mark if at else "") + word[at:e] in tokens]
        if not ends:
            if mark:
                return ["?"]
            out.append("?")
        else:
            out.append((mark if at else "") + word[at : ends[0]])
        at = ends[0] if ends else at + 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé😀#", max_size=4), max_size=12), st.lists(st.text("abé😀#", max_size=9), max_size=6))
def test_pieces_of_many_words_at_once(tokens, words):
    marked = [*tokens, *("##" + t for t in tokens[::2])]
    for family, mark, vocab in (("sentencepiece", "", tokens), ("wordpiece", "##", marked)):
        pieces = Pieces.build([(t, t, 0.0) for t in vocab] + [("a", None, 0.0)] * ("a" not in vocab), "?", None, family)
        for word, cut in zip(words, METHODS["greedy"](words, pieces)):
            assert cut == plain_greedy(word, set(vocab) - {""}, mark)


@pytest.mark.parametrize("method", ["greedy", "score"])
def test_a_very_long_word_takes_linear_time(method):
    """Every place starts a piece and is followed to its end; substrings times lengths would be 1.5 million times 40."""
    pieces = Pieces.build([("a" * n, n, -1.0) for n in (1, 2, 39, 40)], 0)
    took = []
    for size in (100_000, 800_000):
        start = time.process_time()
        cut = METHODS[method](["a" * size + "b"], pieces)[0]
        took.append(time.process_time() - start)
        assert cut == [40] * (size // 40) + [0]
    assert took[1] < 8 * 4 * max(took[0], 0.05)


@pytest.mark.parametrize("kind", ["wordpiece", "bpe"])
@pytest.mark.parametrize("method", ["greedy", "score"])
def test_families_by_parts_of_the_vocabulary(spark, kind, method):
    rng = random.Random(3)
    mark = "##" if kind == "wordpiece" else "Ġ"
    plain = sorted({"".join(rng.choices("abÃ©", k=rng.randint(1, 3))) for _ in range(30)})
    rows = [("v", t, i, -1.0 - i % 5, kind) for i, t in enumerate([*plain, *(mark + t for t in plain), "[UNK]"])]
    vocab = spark.createDataFrame(rows, "vocab string, token string, id bigint, score double, family string")
    vocab = vocab.withColumn("is_special", F.lit(False))
    texts = {"".join(rng.choices("abé", k=rng.randint(0, 9))) for _ in range(60)} | {"ab" * 3000}
    words = spark.createDataFrame([("v", w, 1) for w in sorted(texts)], "lang string, w string, n int")
    whole = segment_words(words, vocab, "id", method)
    parts = segment_words(words, vocab, "id", method, Limits(broadcast_rows=25))
    assert whole.exceptAll(parts).count() == 0 and whole.count() == parts.count() == len(texts)


def test_parts_are_ranges_of_the_wanted_size(vocab):
    rows, count = vocab_parts(vocab.where("NOT is_special"), Limits(broadcast_rows=4))
    sizes = {r["_part"]: (r["n"], r["low"], r["high"]) for r in rows.groupBy("_part").agg(
        F.count("*").alias("n"), F.min(F.struct("vocab", "token")).alias("low"), F.max(F.struct("vocab", "token")).alias("high")).collect()}
    assert count == 4 and sum(n for n, *_ in sizes.values()) == 13 and max(n for n, *_ in sizes.values()) <= 8
    ordered = [sizes[k] for k in sorted(sizes)]
    assert all(a[2] < b[1] for a, b in zip(ordered, ordered[1:]))


def test_vocabularies_are_binned_by_size(vocab):
    assert size_bins(vocab, Limits()) == ([["xx", "yy"]], [])
    assert size_bins(vocab, APART) == ([["xx"], ["yy"]], [])
    assert size_bins(vocab, MIXED) == ([["yy"]], ["xx"])
    assert size_bins(vocab, NO_BROADCAST) == ([], ["xx", "yy"])
    assert size_bins(vocab, Limits(broadcast_bytes=10)) == ([["yy"]], ["xx"])


@pytest.mark.parametrize("limits", [NO_BROADCAST, APART, MIXED])
@pytest.mark.parametrize("method", ["greedy", "score"])
def test_segmentation_without_broadcast_is_the_same(vocab, corpus, method, limits):
    words = count_words(corpus)
    a = segment_words(words, vocab, method=method)
    b = segment_words(words, vocab, method=method, limits=limits)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 20


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("keep,limits", [(None, NO_BROADCAST), ("keep", NO_BROADCAST), ("keep", APART), (None, MIXED)])
def test_tokenising_without_broadcast_is_the_same(vocab, corpus, whole, keep, limits):
    flagged = vocab.withColumn("keep", ~F.col("token").isin("a", "▁", "<unk>"))
    a = tokenize_corpus(corpus, flagged, keep=keep, whole_words=whole)
    b = tokenize_corpus(corpus, flagged, keep=keep, whole_words=whole, limits=limits).select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == 63


@pytest.mark.parametrize("limits", [Limits(), NO_BROADCAST])
@pytest.mark.parametrize("lang", ["ww", None])
def test_a_language_without_vocabulary_is_an_error(spark, vocab, corpus, limits, lang):
    more = corpus.unionByName(spark.createDataFrame([(103, lang, "abc")], corpus.schema))
    with pytest.raises(Exception, match="no vocabulary for language"):
        tokenize_corpus(more, vocab, limits=limits).collect()
    assert tokenize_corpus(more, vocab, limits=limits, drop_missing=True).count() == 63


@pytest.mark.parametrize("limits", [Limits(), NO_BROADCAST])
def test_unknown_characters_cost_the_same_in_both_forms(spark, limits):
    rows = [("▁a", -20.0), ("bc", -20.0), ("▁ab", -1.0), ("zzz", -100.0)]
    pieces = spark.createDataFrame([("v", t, k, False, s) for k, (t, s) in enumerate(rows)], "vocab string, token string, id int, is_special boolean, score double")
    words = spark.createDataFrame([("v", "abc")], "lang string, w string")
    got = segment_words(words, pieces, method="score", limits=limits).first()["pieces"]
    assert got == ["▁a", "bc"]


def test_tokens_and_counts(vocab, corpus):
    tokens = {r["doc_id"]: r["tokens"] for r in tokenize_corpus(corpus, vocab).collect()}
    assert tokens[0] == ["▁cab", "▁cab", "▁ab"] and tokens[101] == tokens[102] == []
    assert tokens[100] == ["▁", "z", "z", "▁", "<unk>", "z", "▁", "z"]
    text = {r["doc_id"]: r["text"] for r in join_tokens(tokenize_corpus(corpus, vocab)).collect()}
    assert text[0] == "▁cab ▁cab ▁ab"
    want = Counter(t for d, ts in tokens.items() if d != 100 for t in ts)
    got = {r["token"]: r["cnt"] for r in count_tokens(count_words(corpus), vocab).where("vocab = 'xx'").collect()}
    assert got == want


def brute_pairs(samples, window):
    found = Counter()
    for s in samples:
        for i, j in product(range(len(s)), repeat=2):
            if i != j and abs(i - j) <= window:
                found[s[i], s[j]] += 1
    return found


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=9), max_size=5), st.integers(1, 6))
def test_pair_counts(samples, window):
    low, high, n = count_pairs(samples, window)
    got = Counter()
    for a, b, c in zip(low.tolist(), high.tolist(), n.tolist()):
        got[a, b] += c
        got[b, a] += c
    assert got == brute_pairs(samples, window)


def test_cooccurrence_paths_agree(vocab, corpus):
    flagged = vocab.withColumn("keep", F.col("token") != "<unk>")
    tokens = tokenize_corpus(corpus, flagged, emit="id", keep="keep")
    want = brute_pairs([r["tokens"] for r in tokens.where("lang = 'xx'").collect()], 5)
    for pairs in (
        cooccurrence(tokens),
        corpus_cooccurrence(corpus, flagged, keep="keep"),
        corpus_cooccurrence(corpus, flagged, keep="keep", limits=NO_BROADCAST),
    ):
        assert {(r["token"], r["ctx"]): r["n"] for r in pairs.where("lang = 'xx'").collect()} == want


def test_ppmi_and_projection(spark):
    counts = {("a", "b"): 6, ("b", "a"): 6, ("a", "c"): 1, ("c", "a"): 1, ("c", "c"): 4}
    pairs = spark.createDataFrame([("l", w, c, n) for (w, c), n in counts.items()], "lang string, token string, ctx string, n bigint")
    total, by = sum(counts.values()), Counter()
    for (w, _), n in counts.items():
        by[w] += n
    weighted = ppmi(pairs, 160)
    got = {(r["token"], r["ctx"]): r["ppmi"] for r in weighted.collect()}
    for (w, c), n in counts.items():
        assert got[w, c] == pytest.approx(max(0.0, math.log(n * total / (by[w] * by[c]))))
    vectors = {r["token"]: np.array(r["vector"]) for r in project(weighted, 160).collect()}
    # One context: every entry is plus or minus its weight over the root of the dimension.
    assert np.allclose(np.abs(vectors["b"]), got["b", "a"] / math.sqrt(160), atol=1e-8)
    assert 0.3 < (vectors["b"] > 0).mean() < 0.7 and len(set(np.sign(vectors["b"][:32]) - np.sign(vectors["b"][128:]))) > 1


def test_auxiliary_vectors_do_not_depend_on_partitioning(spark, vocab, corpus):
    a = aux_from_corpus(corpus.repartition(5), vocab, dim=8, min_count=3)
    b = aux_from_corpus(corpus.coalesce(1), vocab, dim=8, min_count=3)
    assert a.exceptAll(b).count() == 0 and a.count() > 5


@pytest.mark.parametrize("limits", [Limits(), NO_BROADCAST])
def test_families_write_words_their_own_way(spark, limits):
    wp = [("wp", t, i, t.startswith("["), "wordpiece") for i, t in enumerate(["[UNK]", "walk", "##ing", "##i", "##n", "##g", "a", "##é"])]
    space, e = "Ġ", "".join(["Ã", "©"])
    bl = [("bl", t, i, False, "bpe") for i, t in enumerate([space + "walk", "ing", space, *"walking", "Ã", "©", e])]
    vocab = spark.createDataFrame(wp + bl, "vocab string, token string, id bigint, is_special boolean, family string")
    words = ["walking", "walks", "aé", "king", "é"]
    df = spark.createDataFrame([(v, w) for v in ("wp", "bl") for w in words], "lang string, w string")
    got = {(r["lang"], r["w"]): r["pieces"] for r in segment_words(df, vocab, limits=limits).collect()}
    assert got["wp", "walking"] == ["walk", "##ing"] and got["wp", "walks"] == ["[UNK]"]
    assert got["wp", "aé"] == ["a", "##é"] and got["wp", "king"] == got["wp", "é"] == ["[UNK]"]
    assert got["bl", "walking"] == [space + "walk", "ing"] and got["bl", "walks"] == [space + "walk", None]
    assert got["bl", "aé"] == [space, "a", e] and got["bl", "king"] == [space, "k", "ing"]


def test_two_vocabularies_of_one_language(spark, corpus):
    rows = [("small", "▁cab", 0), ("small", "▁ab", 1), ("large", "▁cab", 0), ("large", "▁ab", 1), ("large", "▁a", 2)]
    vocab = spark.createDataFrame([(v, t, i, False) for v, t, i in rows], "vocab string, token string, id bigint, is_special boolean")
    both = aux_from_corpus(corpus, vocab, 4, 2, vocab_langs={"small": "xx", "large": "xx"})
    one = aux_from_corpus(corpus, vocab.where("vocab = 'small'"), 4, 2, vocab_langs={"small": "xx"})
    assert {r["vocab"] for r in both.collect()} == {"small", "large"}
    assert sorted(map(str, both.where("vocab = 'small'").collect())) == sorted(map(str, one.collect()))


def test_word_level_vectors(spark, make_vocab):
    words = spark.createDataFrame(
        [("v", "haus", [1.0, 0.0]), ("v", "haut", [0.0, 1.0]), ("v", "12", [3.0, 3.0])], "lang string, word string, vector array<double>"
    )
    vocab = make_vocab([("▁haus", 0, " haus"), ("▁hau", 1, " hau "), ("▁zzzz", 2, " zzzz"), ("▁", 3, " ")])
    got = {r["token"]: r["vector"] for r in token_vectors(vocab, words, 2).collect()}
    salted = {r["token"]: r["vector"] for r in token_vectors(vocab, words, 2, Limits(broadcast_bytes=0)).collect()}
    assert salted == got
    assert got["▁haus"] == [1.0, 0.0]
    # <hau> shares <ha, hau and <hau with both words; au> and the longer ones with none.
    assert got["▁hau"] == pytest.approx([0.5, 0.5])
    assert got["▁zzzz"] == [0.0, 0.0] and got["▁"] == [0.0, 0.0]


def test_source_selection_errors(spark, vocab, corpus):
    table = spark.createDataFrame([("v", "a", [1.0])], "vocab string, token string, vector array<double>")
    with pytest.raises(ValueError):
        load_auxiliary(vocab, "other", table=table)
    with pytest.raises(ValueError):
        load_auxiliary(vocab)
    with pytest.raises(ValueError):
        load_auxiliary(vocab, "wordlevel", word_vectors=table)
    with pytest.warns(UserWarning):
        assert load_auxiliary(vocab, table=table, corpus=corpus).count() == 1


def test_language_filter_reaches_the_scan(spark, tmp_path):
    rows = [("x", "ab ca"), ("y", "bc")]
    path = str(tmp_path / "corpus")
    spark.createDataFrame(rows, "lang string, text string").write.parquet(path)
    vocab = spark.createDataFrame(
        [("x", t, i, None, False) for i, t in enumerate(PIECES)] + [("y", t, i, None, False) for i, t in enumerate(PIECES[:4])],
        "vocab string, token string, id bigint, decoded string, is_special boolean",
    )
    found = tokenize_corpus(spark.read.parquet(path), vocab)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(lang, [x,y])" in plan and "ReadSchema: struct<lang:string>" in plan
    assert {r.lang: r.tokens for r in found.collect()} == {"x": ["▁ab", "▁", "ca"], "y": ["▁", "b", "c"]}
    assert "PartitionFilters: []" not in tokenize_corpus(
        spark.read.parquet(_partitioned(spark, path, tmp_path)), vocab
    )._jdf.queryExecution().executedPlan().toString()


def _partitioned(spark, path, tmp_path):
    out = str(tmp_path / "by-lang")
    spark.read.parquet(path).write.partitionBy("lang").parquet(out)
    return out


def test_pairs_of_a_token_leave_one_task(spark, vocab, corpus):
    """So that one vector per token is shuffled, not one per token and task."""
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        pairs = corpus_cooccurrence(corpus.repartition(3), vocab)
        tasks = pairs.withColumn("task", F.spark_partition_id()).groupBy("lang", "token").agg(F.count_distinct("task").alias("n"))
        assert {r["n"] for r in tasks.collect()} == {1} and pairs.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set(coalesce, before)
    pairs = materialize(pairs, "pairs")
    want = project(ppmi(name_pairs(pairs, vocab), 70), 70)
    for limits in (Limits(), Limits(broadcast_bytes=0)):
        got = projected(pairs, vocab, 70, limits)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 2


def test_counts_of_a_bucket_are_added_up_in_parts(monkeypatch):
    from lexigraft.operators import cooccurrence as c

    rng = np.random.default_rng(1)
    samples = [rng.integers(0, 9000, 300).tolist() for _ in range(4)] + [[], [None, 7, None, 7], [300, 70_000]]
    monkeypatch.setattr(c, "CHUNK_TOKENS", 250)
    monkeypatch.setattr(c, "WAITING", 1)
    counter = c._Counter(3)
    batches = [b for s in samples for b in counter.add(["x"], [s])] + list(counter.rest())
    assert len(batches) > 3
    rows = pa.Table.from_batches(batches).sort_by([("lang", "ascending"), ("bucket", "ascending")]).to_batches()
    got = [r for b in c._added_up(rows) for r in b.to_pylist()]
    want = brute_pairs([[t for t in s if t is not None] for s in samples], 3)
    assert {(r["token"], r["ctx"]): r["n"] for r in got} == want and len(got) == len(want)


def test_texts_are_cut_in_runs_however_large_a_batch_is():
    from lexigraft.operators import segmentation as s

    texts = ["ab " * 400_000, None, "", "ab", "ab " * 400_000, "ab"] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(["v"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    runs = list(s.text_runs([batch, batch.slice(0, 0)]))
    assert [t for r in runs for t in r.column("text").to_pylist()] == texts and len(runs) >= 4
    assert all(r.num_rows == 1 or sum(len(t or "") for t in r.column("text").to_pylist()) <= s.CHUNK_CHARS for r in runs)


def test_a_task_lays_out_the_pairs_of_some_buckets_at_a_time():
    import tracemalloc

    from lexigraft.operators import cooccurrence as c

    tokens = np.random.default_rng(2).integers(0, 60_000, 200_000).tolist()
    counter = c._Counter(5)
    tracemalloc.start()
    rows = [b.num_rows for b in [*counter.add(["x"], [tokens]), *counter.rest()]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) == c.BUCKETS and max(rows) <= c.COUNTED_BUCKETS
    # Two million pairs in both directions.
    assert peak < 30e6


def test_words_are_searched_in_bounded_runs():
    import tracemalloc

    from lexigraft.operators import segmentation as s

    rng = np.random.default_rng(3)
    words = ["".join(w) for w in rng.choice(list("abcdefgh"), (100_000, 8))]
    pieces = Pieces.build([(c, k, 0.0) for k, c in enumerate([*"abcdefgh", "abc", "▁a"])], None)
    tracemalloc.start()
    parts = s.cut_texts(["x"], [" ".join(words)], ({"x": pieces}, {}), "greedy", False, {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts[0]) > 700_000 and peak < 75e6, peak
