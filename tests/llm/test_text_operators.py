"""Operators that look at one text at a time, against plain Python."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigraft.llm.bpe import BpeModel, Encoder, decode_ids, encode_texts
from lexigraft.llm.decontamination import find_contained
from lexigraft.llm.html_density import extract_main_text, main_text
from lexigraft.llm.license_scan import TEMPLATES, scan_licenses, words_of
from lexigraft.llm.quality_rules import Rules, js_distance, judge_quality
from lexigraft.llm.token_counts import UnigramPieces, count_distinct, count_tokens, read_pieces

BPE_FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t ", "It's ΑΣ ΟΔΟΣ. don't I'LL x<|endoftext|>y<|startoftext|>", "a\x1cb\x1d c\x85d", "İI ß ﬀ 漢字 123 ½",
    "😀😀 👩‍👩‍👧 ​﻿ a　b᠎c", "<|endoftext|", "a" * 3000, "\x00\x01 a\x00b", "é öx",
]


def test_bpe_equals_the_library(documents):
    library = Tokenizer.from_file(BPE_FILE)
    model = BpeModel.load(BPE_FILE)
    rows = [*enumerate(ODD), (0, ODD[3]), (None, "null id"), (3, ODD[3])]
    out = decode_ids(encode_texts(documents(rows), model), model).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    decoded = [library.decode(x, skip_special_tokens=False) for x in want]
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in out) == sorted(
        (str(i), x, d) for (i, _), x, d in zip(rows, want, decoded, strict=True)
    )


def test_bpe_memory_stays_bounded():
    encoder = Encoder(BpeModel.load(BPE_FILE), remembered=8)
    free = Encoder(BpeModel.load(BPE_FILE))
    text = " ".join(f"word{i % 37}x" for i in range(500))
    assert encoder.encode(text) == free.encode(text)
    assert len(encoder._chunk_ids) <= 8


def test_bpe_empty_table(documents):
    assert encode_texts(documents([]), BpeModel.load(BPE_FILE)).count() == 0


def brute_tokens(word, scores):
    """Best (score, fewest tokens) over all cuts."""
    unknown = min(scores.values()) - 10.0
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = [
            (best[a][0] + scores[word[a:end]], -(best[a][1] + 1)) for a in range(end) if word[a:end] in scores
        ]
        if word[end - 1] not in scores:
            options.append((best[end - 1][0] + unknown, -(best[end - 1][1] + len(word[end - 1].encode()))))
        s, n = max(options)
        best[end] = (s, -n)
    return best[len(word)][1]


def test_unigram_counts_equal_all_cuts():
    rng = random.Random(2)
    scores = {"".join(rng.choices("abc", k=rng.randint(1, 4))): -float(rng.randint(1, 9)) for _ in range(30)}
    words = list({"".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(400)})
    counts = count_distinct(words, UnigramPieces(scores))
    assert counts == {w: brute_tokens(w, scores) for w in words}


def test_token_counts_per_document(documents):
    scores = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = [*enumerate(ODD), (0, "the the the"), (None, "x"), (7, " ".join(["word"] * 30000))]
    got = count_tokens(documents(rows), scores).collect()
    words = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    want = [(str(i), len(w), sum(brute_tokens("▁" + x, scores) for x in set(w) for _ in range(w.count(x)) if len(x) < 100)) for i, w in words]
    short = [w for w, (_, t) in zip(want, rows, strict=True) if len(t or "") < 2000 or " " in t]
    assert set(short) <= {(str(r.doc_id), r.n_words, r.n_tokens) for r in got}
    assert len(got) == len(rows)
    assert count_tokens(documents([]), scores).count() == 0


def brute_blocks(text, size=128):
    """(label, word, containment) of every block against every template, without any filter."""
    words, out = words_of(text), set()
    starts = [i for i in range(0, len(words) + 1, size // 2) if i == 0 or i + size // 2 < len(words)]
    for i in starts:
        block = words[i : i + size]
        best = {}
        for t in TEMPLATES:
            tokens = set(words_of(t.notice))
            part = len(tokens & set(block)) / len(tokens)
            marks = [words_of(m) for m in t.marks]
            held = any(block[j : j + len(m)] == m for m in marks for j in range(len(block)))
            if 10 * len(tokens & set(block)) >= 8 * len(tokens) and held:
                best[t.label] = max(best.get(t.label, 0), part)
        out |= {(label, i, part) for label, part in best.items()}
    return out


WRAPPED = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
GPL_NOTICE = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version."""


def test_license_scan(documents):
    rng = random.Random(8)
    notices = [t.notice for t in TEMPLATES]
    texts = [
        None, "", "CC BY cc-by; C.C. by", "all rights reserved All  Rights\nReserved", "the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.",
        "x\nLicensed under the Apache License, Version 2.0.", "licence", "éall rights reserved", "mit license " * 5000,
        WRAPPED, "long " * 30_000 + notices[0], " ".join(notices),
    ]
    for _ in range(60):  # notices with words lost or swapped, among others, around the edges of blocks
        words = rng.choice(notices).split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(["the license"] * rng.randrange(70) + words + ["of 2 0 by"] * rng.randrange(40)))
    rows = [*enumerate(texts), (1, texts[5]), (None, texts[5])]
    got = scan_licenses(documents(rows)).collect()
    assert len(got) == len(rows)
    by_text = {(i, len(words_of(t))): t for i, t in rows}
    for r in got:
        text = by_text[r.doc_id, r.n_words]
        assert {(b.label, b.word, b.containment) for b in r.blocks} == brute_blocks(text)
        joined = b" " + b" ".join(words_of(text)) + b" "
        assert len(r.places) == sum(
            len(re.findall(b"(?= " + p + b" )", joined)) for p in (b"cc by", b"general public license", b"all rights reserved")
        )
    assert scan_licenses(documents([])).count() == 0


def test_license_labels(documents):
    """Licences that share nearly all words of their notices, and notices broken over lines."""
    want = {
        "Released under the BSD license": {"bsd"},
        "Released under the MIT license": {"mit"},
        "Licensed under the GNU Lesser General Public License version 2.1": {"lgpl-2.1"},
        "Licensed under the GNU Lesser General Public License, version 3": {"lgpl-3.0"},
        "Licensed under the GNU Affero General Public License version 3": {"agpl-3.0"},
        "Licensed under the GNU General Public License version 2": {"gpl-2.0"},
        "This work is licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
        "Licensed under CC BY 4.0": {"cc-by-4.0"},
        "Licensed under CC BY-NC 4.0": {"cc-by-nc-4.0"},
        "Licensed under CC BY-SA 4.0": {"cc-by-sa-4.0"},
        "Licensed under CC BY-NC-SA 4.0": {"cc-by-nc-sa-4.0"},
        "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": {"cc-by-sa-4.0"},
        "Licensed under the Apache\n// License, Version 2.0": {"apache-2.0"},
        WRAPPED: {"bsd"},
        GPL_NOTICE.format("", 2): {"gpl-2.0"},
        GPL_NOTICE.format("", 3): {"gpl-3.0"},
        GPL_NOTICE.format("Lesser ", "2.1"): {"lgpl-2.1"},
        GPL_NOTICE.format("Affero ", 3): {"agpl-3.0"},
        "Licensed under the GNU General Public License version 2 and the Apache License, version 2.0": {"gpl-2.0", "apache-2.0"},
        "a license to use the source code of this work is released by the public": set(),
    }
    got = scan_licenses(documents(list(enumerate(want)))).collect()
    assert {r.doc_id: {b.label for b in r.blocks} for r in got} == dict(enumerate(want.values()))


def brute_quality(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(documents):
    rng = random.Random(4)
    texts = [None, "", "a\n\na\n \na", "x " * 8, "x " * 9, "😀 a\x0bb\x1cc", "word " * 20000]
    texts += [" ".join(rng.choices("abc", k=rng.randint(1, 60))) + "\n#*" for _ in range(60)]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[3])]
    got = judge_quality(documents(rows)).collect()
    assert len(got) == len(rows)
    counts = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert counts == sorted(brute_quality(t) for _, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert judge_quality(documents([])).count() == 0


def test_quality_judges_divergence_of_long_texts(spark):
    rng = random.Random(5)
    common = "the of and to in a is that for it".split()
    def text(symbol=""):
        return " ".join(rng.choice([rng.choice(common), f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 0)}word{rng.randint(0, 9999)}"]) + symbol for _ in range(150))
    rows = [(i, text(), "en") for i in range(40)] + [(40, text("#$%&"), "en"), (41, text().upper(), "en"), (42, text(), None)]
    got = {r.doc_id: r for r in judge_quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(40)) and not got[40].kept and not got[41].kept
    assert got[42].word_distance is None


def test_js_distance(spark):
    p, q = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    row = spark.range(1).select(js_distance(p, q).alias("far"), js_distance(p, p).alias("same")).first()
    assert row.far == pytest.approx(1.0) and row.same == 0.0
    assert Rules().window == 8


PAGES = {
    "<body><header class=top><a href=x>Home</a></header><div id=content><h1>T</h1><p>Hello <b>big</b>&nbsp;world, this is text"
    "<p>second one<ul><li>a b<li>c d</ul><table><tr><td>x<td>y</table></div><div class=comments><p>nice post</p></div>"
    "<div class=cookie-notice>we use</div></body>": "T\nHello big world, this is text\nsecond one\na b\nc d\nx\ny",
    "<html><body><main><header><h1>Tit</h1></header><section><p>aaa bbb</p><p>ddd</p></section><section><p>eee</p></section></main>"
    "<aside>z</aside>": "Tit\naaa bbb\nddd\neee",
    "just text &amp; more": "just text & more",
    "<p>": "",
    "<article><p>one<br>two <i>x</i></p><script>var t='</p>';</script><form>f</form></article><footer>no</footer>": "one\ntwo x",
    "<body><nav>menu</nav><article><p>cut &am</p><p>here </artic": "cut &am\nhere",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text(page) == PAGES[page]


def test_main_text_beside_the_largest_block():
    texts = [f"{k} " + "word and more " * 36 for k in range(30)]
    lines = [" ".join(t.split()) for t in texts]
    sections = ["".join(f"<p>{t}</p>" for t in texts[k : k + 10]) for k in (0, 10, 20)]
    links = "<div>" + "".join(f"<a href=x>link number {k} to another page</a> " for k in range(40)) + "</div>"
    page = "<body>" + links + "".join(f"<div>{x}</div>" for x in sections) + "<div>small print</div></body>"
    assert main_text(page) == "\n".join(lines)
    # One of them further down, and text of the body itself.
    page = f"<body><div>{sections[0]}</div>{links}<div><ul><li>a<li>b</ul>{links}<div>{sections[1]}</div></div>{texts[20]}</body>"
    assert main_text(page) == "\n".join(lines[:21])


@pytest.mark.parametrize("tag", ["div class=content-sidebar-wrap", "div class='has-sidebar x'", "div id=no-sidebar", "form action=x"])
def test_marked_wrapper_keeps_the_article(tag):
    article = "<p>" + "word and more " * 30 + "</p><p>end of it, which is long enough</p>"
    inner = "<div class=sidebar><p>other texts of ours</p></div><form>search</form>"
    page = f"<body><{tag}>{article}{inner}</{tag.split()[0]}></body>"
    assert main_text(page) == " ".join(("word and more " * 30).split()) + "\nend of it, which is long enough"
    page = f"<body><div>{article}</div><{tag}>some words aside</{tag.split()[0]}></body>"
    assert "aside" not in main_text(page)


def test_pages_with_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x y"), (2, "u", ""), (3, "u", "<div>" * 20000 + "deep")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text")).collect()
    assert sorted(r.text for r in got) == ["", "", "", "deep", "x y"]
    assert extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def brute_shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_decontamination(spark, documents):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 12, 40, 90])))) for i in range(30)] + [(30, None), (31, ""), (None, "a b c d e f")]
    rows = [(0, None), (1, ""), (None, items[5][1])]
    for d in range(2, 120):
        text = rng.choices(words, k=rng.choice([10, 300, 2000]))
        for _ in range(rng.randint(0, 3)):
            piece = (items[rng.randrange(30)][1]).split()
            for _ in range(rng.randint(0, 3)):
                piece[rng.randrange(len(piece))] = "Edited"
            at = rng.randrange(len(text))
            text[at:at] = piece
        rows.append((d, "\n".join([" ".join(text[:7]), "  ".join(text[7:])]).upper()))
    rows.append(rows[5])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limits in ({}, {"block_items": 7}, {"block_bytes": 900}):
        got = {(r.doc_id, r.item_id, r.n_shared) for r in find_contained(documents(rows), bench, **limits).collect()}
        want = set()
        for d, t in rows:
            for i, x in items:
                s = brute_shingles(x)
                n = len(s & brute_shingles(t))
                if s and n >= 0.75 * len(s):
                    want.add((d, i, n))
        assert got == want and len(want) > 30
    assert find_contained(documents([]), bench).count() == 0
    assert find_contained(documents(rows), bench.limit(0)).count() == 0
