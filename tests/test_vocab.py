"""Token forms, families and vocabulary views on hand-made vocabularies."""

import random

import pytest
from pyspark.sql import functions as F

from lexigraft.functions.text import SPACE, decode_byte_level, encode_byte_level, is_symbol_text, ltrim_u, trim_u
from lexigraft.operators.overlap import first_by_key, match_tokens, multi_source, new_tokens_exact, vocab_view
from lexigraft.operators.ranking import number_rows, top_n
from lexigraft.operators.vocab_forms import canonical_vocab, flag_symbols, vocab_family
from lexigraft.operators.vocab_learning import count_words, extend_vocab, learn_vocab
from lexigraft.session import Limits


def test_trim_is_unicode_wide(spark):
    texts = ["　\x1c x ", " y", "z\x85", "​w", "", " \t\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(ltrim_u(F.col("t")), trim_u(F.col("t"))).collect()
    assert [r[0] for r in rows] == [t.lstrip() for t in texts]
    assert [r[1] for r in rows] == [t.strip() for t in texts]


def test_space_class_matches_isspace(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string")
    found = {r[0] for r in df.where(F.col("t").rlike(f"^{SPACE}$")).select("c").collect()}
    assert found == {c for c in points if chr(c).isspace()}


def test_symbols(spark):
    texts = ["", "12", "½", "一", "...", "!?a", "\x1c", "　", "a", "1.5", "²³", "_", "!\n", "12\n", "12\u2028", ");\n", "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(is_symbol_text(F.col("t"))).collect()]
    punctuation = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    assert got == [t.isnumeric() or all(c in punctuation for c in t) or t.isspace() for t in texts]


def test_special_test_uses_lower_cased_form(make_vocab, family):
    vocab = make_vocab([("<s>", 0, "<s>", True), ("[CLS]", 1, "[CLS]", True), ("abc", 2, "abc")])
    rows = flag_symbols(canonical_vocab(vocab, family("v", "sentencepiece"))).collect()
    assert {r["token"]: r["is_symbol"] for r in rows} == {"<s>": True, "[CLS]": False, "abc": False}


@pytest.mark.parametrize(
    "n_marked,n_continued,want", [(101, 200, "sentencepiece"), (100, 101, "wordpiece"), (100, 100, "bpe")]
)
def test_family_thresholds_are_strict(make_vocab, n_marked, n_continued, want):
    tokens = [f"▁{i}" for i in range(n_marked)] + [f"##{i}" for i in range(n_continued)] + [""]
    assert vocab_family(make_vocab([(t, i) for i, t in enumerate(tokens)])).first()["family"] == want


def forms(make_vocab, family, kind, rows):
    got = canonical_vocab(make_vocab(rows), family("v", kind)).collect()
    return {r["token"]: (r["canonical"], r["bow"]) for r in got}


def test_sentencepiece_forms(make_vocab, family):
    got = forms(make_vocab, family, "sentencepiece", [("▁Haus", 0), ("us", 1), ("▁", 2), ("a▁b", 3), ("▁　x", 4)])
    assert got == {
        "▁Haus": ("▁Haus", True),
        "us": ("us", False),
        "▁": ("▁", True),
        "a▁b": ("a b", False),
        "▁　x": ("▁x", True),
    }


def test_byte_fallback_pieces_stay(make_vocab, family):
    rows = [("<0x0A>", 0, "\n"), ("<0xFF>", 1, "�"), ("<0x,A>", 2, " q"), ("<0xZZ>", 3, " z"), ("<0x0A>x", 4, " y")]
    got = forms(make_vocab, family, "sentencepiece", rows)
    assert got == {
        "<0x0A>": ("<0x0A>", False),
        "<0xFF>": ("<0xFF>", False),
        "<0x,A>": ("<0x,A>", False),
        "<0xZZ>": ("z", False),
        "<0x0A>x": ("<0x0A>x", False),
    }


def test_wordpiece_forms(make_vocab, family):
    got = forms(make_vocab, family, "wordpiece", [("[CLS]", 0), ("the", 1), ("##ing", 2), ("x", 3, " x")])
    assert got == {"[CLS]": ("▁[CLS]", True), "the": ("▁the", True), "##ing": ("ing", False), "x": ("▁ x", True)}


def test_bpe_forms_and_partial_bytes(make_vocab, family):
    got = forms(make_vocab, family, "bpe", [("Ġthe", 0), ("the", 1), ("Ġ", 2), ("Ã", 3), ("©", 4), ("Ã©", 5)])
    assert got == {
        "Ġthe": ("▁the", True),
        "the": ("the", False),
        "Ġ": ("▁", True),
        "Ã": ("�", False),
        "©": ("�", False),
        "Ã©": ("é", False),
    }


def test_other_forms(make_vocab, family):
    row = canonical_vocab(make_vocab([("▁A▁B", 0, "▁A▁B")]), family("v", "sentencepiece")).first()
    assert (row["fuzzy"], row["uncased"], row["no_ws"]) == ("ab", "▁▁a▁b", "AB")


def test_byte_alphabet_round_trip(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZ é▁ß😀\n\x00\xad中") for _ in range(rng.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", decode_byte_level(encode_byte_level(F.col("t")))).collect()
    assert all(a == b for a, b in rows)
    assert spark.range(1).select(decode_byte_level(F.lit("中a"))).first()[0] == "中a"


DUPLICATES = [("the", 3, "the"), ("▁the", 5, "▁the"), ("The", 4, "The"), ("▁The", 8, "▁The"), ("x", 7, "same"), ("y", 9, "same")]


def test_view_orders(make_vocab, family):
    source = canonical_vocab(make_vocab(DUPLICATES, "s"), family("s", "sentencepiece"))
    exact = {(r["key"], r["pos"]): r["id"] for r in vocab_view(source, "canonical").collect()}
    assert (exact["same", 0], exact["same", 1]) == (9, 7)
    fuzzy = sorted((r["pos"], r["id"]) for r in vocab_view(source, "fuzzy").where("key = 'the'").collect())
    assert fuzzy == [(0, 3), (1, 4), (2, 5), (3, 8)]
    firsts = {r["canonical"]: (r["src_id"], r["n_sources"]) for r in first_by_key(source, "canonical").collect()}
    assert firsts["same"] == (9, 2)


def match(make_vocab, family, target, source, **flags):
    s = canonical_vocab(make_vocab(source, "s"), family("s", "sentencepiece"))
    t = canonical_vocab(make_vocab(target, "t"), family("t", "sentencepiece"))
    t = t.withColumns({"pair_id": F.lit("p"), "source": F.lit("s")})
    return t, s, match_tokens(t, s, **flags)


def test_rule_priority(make_vocab, family):
    source = [("▁haus", 0), ("12", 1), ("▁Baum", 2), ("...", 3)]
    target = [("▁haus", 0), ("▁12", 1), ("12", 2), ("▁baum", 3), ("▁neu", 4), ("▁...", 5)]
    _, _, all_rules = match(make_vocab, family, target, source, match_symbols=True, fuzzy_match_all=True)
    got = {r["token"]: (r["match_kind"], r["src_token"]) for r in all_rules.collect()}
    assert got == {
        "▁haus": ("exact_match", "▁haus"),
        "▁12": ("numerical_symbol", "12"),
        "12": ("numerical_symbol", "12"),
        "▁baum": ("fuzzy_match", "▁Baum"),
        "▁neu": (None, None),
        "▁...": ("numerical_symbol", "..."),
    }
    _, _, only = match(make_vocab, family, target, source, match_symbols=True, exact_match_all=False)
    assert {r["token"] for r in only.where("match_kind is not null").collect()} == {"▁12", "12", "▁..."}


def test_lone_mark_is_a_symbol_and_matches_empty_forms(make_vocab, family):
    _, _, got = match(make_vocab, family, [("▁", 0)], [("▁▁", 4, "▁▁"), ("q", 5)], match_symbols=True, exact_match_all=False)
    assert got.first()["match_kind"] == "numerical_symbol" and got.first()["src_id"] == 4


def test_partial_bytes_do_not_fan_out(make_vocab, family):
    tokens = [(chr(161 + i), i) for i in range(12)]
    s = canonical_vocab(make_vocab(tokens, "s"), family("s", "bpe"))
    t = canonical_vocab(make_vocab(tokens, "t"), family("t", "bpe"))
    t = t.withColumns({"pair_id": F.lit("p"), "source": F.lit("s")})
    rows = match_tokens(t, s).collect()
    assert len(rows) == 12 and {r["src_id"] for r in rows} == {11} and {r["n_sources"] for r in rows} == {12}


def test_multi_source_lists_first_five(make_vocab, family):
    source = [(f"t{i}", i, "same") for i in range(9)]
    t, s, matched = match(make_vocab, family, [("x", 0, "same")], source)
    row = multi_source(matched, s).first()
    assert row["n_sources"] == 9 and row["src_tokens"] == ["t8", "t7", "t6", "t5", "t4"]
    assert new_tokens_exact(t, s).count() == 0


def test_extended_vocabulary(make_vocab):
    source = make_vocab([("a", 0), ("b", 1)], "s")
    added = make_vocab([("c", 0), ("b", 1), ("d", 2)], "t")
    got = {r["token"]: r["id"] for r in extend_vocab(source, added, ["t"]).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def skewed(spark):
    rows = [("hot", i % 50, f"t{i:04d}") for i in range(1500)] + [(f"k{i % 40}", i % 7, f"u{i:04d}") for i in range(1500)]
    return spark.createDataFrame(rows, "k string, n int, t string")


def test_range_positions_equal_window_positions(spark):
    df, order = skewed(spark), [F.col("n").desc(), F.col("t")]
    small = number_rows(df, ["k"], order, "r", small=True)
    large = number_rows(df, ["k"], order, "r", small=False)
    assert small.exceptAll(large.select(small.columns)).count() == 0 and large.count() == 3000


def test_top_n_forms_agree(spark):
    df, order = skewed(spark), [F.col("n").desc(), F.col("t")]
    salted = top_n(df, ["k"], order, 20)
    ranged = top_n(df, ["k"], order, 20, Limits(window_rows=10))
    assert salted.exceptAll(ranged).count() == 0 and salted.count() == ranged.count() == 41 * 20


def test_learned_vocabulary(spark):
    corpus = spark.createDataFrame([("xx", "b a  a　c"), ("xx", "a ▁ b"), ("yy", "q")], "lang string, text string")
    words = count_words(corpus)
    assert {(r.w, r.n) for r in words.where("lang = 'xx'").collect()} == {("a", 3), ("b", 2), ("c", 1), ("▁", 1)}
    vocab = learn_vocab(words, {"xx": 11}).orderBy("id").collect()
    assert [r["token"] for r in vocab] == ["<s>", "<pad>", "</s>", "<unk>", "<mask>", "▁", "a", "b", "c", "▁a", "▁b"]
    ranged = learn_vocab(words, {"xx": 11}, limits=Limits(window_rows=5)).orderBy("id").collect()
    assert [(r["token"], r["id"]) for r in ranged] == [(r["token"], r["id"]) for r in vocab]
