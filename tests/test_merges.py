"""Learning merges against a learner that makes one after the other."""

import random
from collections import Counter

from lexigraft.operators import merge_learning
from lexigraft.operators.merge_learning import MERGE_SCHEMA, learn_merges, merge_vocab
from lexigraft.operators.segmentation import segment_words

WORDS = "lang string, w string, n bigint"


def brute_merges(words, size, min_count=2):
    """Most frequent pair first, of equals the one with the oldest symbols."""
    cuts = [(list("▁" + w), n) for w, n in words]
    number = {c: k for k, c in enumerate(sorted({c for s, _ in cuts for c in s}))}
    out = []
    while len(out) < size:
        counts = Counter()
        for s, n in cuts:
            for pair in zip(s, s[1:]):
                counts[pair] += n
        best = min(
            ((-c, max(number[a], number[b]), number[a], number[b], a, b) for (a, b), c in counts.items() if c >= min_count), default=None
        )
        if best is None:
            break
        *_, a, b = best
        number.setdefault(a + b, len(number))
        out.append((len(out), a, b, a + b, -best[0]))
        merged = []
        for s, n in cuts:
            t, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [a, b]:
                    t.append(a + b)
                    i += 2
                else:
                    t.append(s[i])
                    i += 1
            merged.append((t, n))
        cuts = merged
    return out


def test_merges_equal_one_after_the_other(spark, monkeypatch):
    rng = random.Random(3)
    langs = {}
    for lang, letters in (("x", "abc"), ("y", "abcdefgh"), ("z", "aé😀")):
        words = {"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(120)}
        langs[lang] = [(w, rng.choice([1, 1, 2, 3, 5, 50])) for w in sorted(words)]
    langs["z"] += [("aaaaaaa", 7), ("aaaa", 3)]
    rounds = []
    whole = merge_learning._candidates
    monkeypatch.setattr(merge_learning, "_candidates", lambda *a: rounds.append(1) or whole(*a))
    df = spark.createDataFrame([(lang, w, n) for lang, words in langs.items() for w, n in words], WORDS)
    df = df.unionByName(spark.createDataFrame([("x", None, 5), (None, "a", 5), ("other", "ab", 9)], WORDS))
    sizes = {"x": 12, "y": 45, "z": 10_000, "none": 5}
    got = learn_merges(df, {"x": 12, "y": 45, "z": 30, "none": 5}).collect()
    for lang in langs:
        want = brute_merges(langs[lang], min(sizes[lang], 30 if lang == "z" else 10**6))
        assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.rank) if r.vocab == lang] == want
    assert {r.vocab for r in got} == set(langs)
    assert len(rounds) < 45


def test_rounds_end_where_order_could_change():
    known = merge_learning.Merges(list("abcd"))
    # (b, c) starts with what (a, b) takes; (a, d) shares its left side and does not.
    assert merge_learning.choose([(9, 0, 1, 0, 0), (8, 1, 2, 0, 0)], known, 9) == [(0, 1, 9)]
    assert merge_learning.choose([(9, 0, 1, 0, 0), (8, 0, 3, 0, 0)], known, 9) == [(0, 1, 9), (0, 3, 8)]
    # Seven times something stands before a: it may form a new pair as frequent.
    assert merge_learning.choose([(9, 0, 1, 7, 0), (6, 0, 3, 7, 0)], known, 9) == [(0, 1, 9)]
    assert merge_learning.choose([(9, 0, 1, 7, 0), (7, 0, 3, 7, 0)], known, 1) == [(0, 1, 9)]


def test_a_pair_can_be_merged_twice():
    words = [("abcd", 10), ("abc", 9), ("xab", 8), ("bcx", 8), ("abcdabcd", 4), ("bc", 30), ("cd", 6)]
    merges = merge_learning.Merges(sorted({c for w, _ in words for c in "▁" + w}))
    for _, a, b, _, n in brute_merges(words, 20):
        merges.add(merges.number[a], merges.number[b], n)
    ranks = merge_learning.ranks_of(merges)
    for w, _ in words:
        whole = merge_learning.cut([merges.number[c] for c in "▁" + w], ranks, 0, len(merges.pairs))
        parts = [merges.number[c] for c in "▁" + w]
        for k in range(len(merges.pairs)):
            parts = merge_learning.cut(parts, ranks, k, k + 1)
        assert whole == parts and "".join(merges.symbols[k] for k in whole) == "▁" + w


def test_learned_vocabulary_cuts_words(spark):
    words = spark.createDataFrame([("x", "lower", 9), ("x", "lowest", 7), ("x", "slow", 5)], WORDS)
    vocab = merge_vocab(words, learn_merges(words, {"x": 4}))
    rows = vocab.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows)))
    assert [r.token for r in rows][:6] == ["<s>", "<pad>", "</s>", "<unk>", "<mask>", "e"]
    made = [m[3] for m in brute_merges([("lower", 9), ("lowest", 7), ("slow", 5)], 4)]
    assert [r.token for r in rows if len(r.token) > 1 and not r.is_special] == made
    cut = {r.w: r.pieces for r in segment_words(words, vocab).collect()}
    assert all("".join(p) == "▁" + w and "<unk>" not in p for w, p in cut.items())
    assert len(cut["lower"]) < 6
    assert learn_merges(words.limit(0), {"x": 4}).collect() == [] and MERGE_SCHEMA.count(",") == 5
