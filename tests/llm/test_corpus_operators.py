"""Operators that compare documents with each other, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexigraft.llm import line_dedup, near_duplicates, suffix_repeats, warc
from lexigraft.llm.components import connected_components
from lexigraft.llm.queries import QUERIES
from lexigraft.llm.shingles import shingle_set, words_lower


def rank(d):
    return (d is None, d or 0)


# Repeats of bytes


def brute_repeats(rows, m=100):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda x: rank(x[0])):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - m + 1):
            if data[p : p + m] in seen:
                covered[p : p + m] = b"\x01" * m
            seen.add(data[p : p + m])
        kept = bytes(x for x, c in zip(data, covered, strict=True) if not c)
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out[d] = (len(data), sum(covered), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most_runs", [1000, 4])
def test_repeats_equal_brute_force(documents, monkeypatch, most_runs):
    # With 4, crowded keys go through their single windows.
    monkeypatch.setattr(suffix_repeats, "MOST_RUNS", most_runs)
    rng = random.Random(5)

    def text(n):
        return "".join(rng.choices("abcdé ", k=n))

    passages = [text(rng.choice([60, 99, 100, 101, 130, 400])) for _ in range(10)]
    rows = [
        (i, text(rng.randint(0, 80)) + rng.choice(passages)[: rng.randint(80, 400)] + text(40) + rng.choice(passages))
        for i in range(300)
    ]
    rows += [(5000, "a" * 5000), (5001, "ab" * 700), (5002, None), (5003, ""), (None, rows[3][1]), (5004, passages[0] * 30)]
    rows += [(5005, "x" + "a" * 300 + "y"), (5006, ("q" * 99 + "z") * 40), rows[7], rows[3], (5000, "a" * 5000)]
    got = suffix_repeats.without_repeats(documents(rows)).collect()
    assert len(got) == len(rows)
    want = brute_repeats(rows)
    for r in got:
        removed = sum(x.end - x.start for x in r.spans)
        assert (r.n_bytes, removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id]


def test_crowded_keys_are_split_from_the_start(documents, monkeypatch):
    monkeypatch.setattr(suffix_repeats, "crowded_keys", lambda placed, m, **_: _all_keys(placed, m))

    def _all_keys(placed, m):
        import numpy as np

        texts = [r.text.encode() for r in placed.select("text").collect()]
        return np.unique(np.concatenate([suffix_repeats.sample_runs(t, m)[0] for t in texts]))

    rng = random.Random(6)
    passage = "".join(rng.choices("abcd ", k=160))
    rows = [(i, "".join(rng.choices("abcd ", k=90)) + passage + "".join(rng.choices("abcd ", k=90))) for i in range(60)]
    got = suffix_repeats.without_repeats(documents(rows)).collect()
    want = brute_repeats(rows)
    assert all(sum(x.end - x.start for x in r.spans) == want[r.doc_id][1] for r in got)


def test_two_texts_under_one_id_and_empty_table(documents):
    rows = [(1, "a1" * 80), (1, "b2" * 80 + "a1" * 80), (2, "c" * 20)]
    got = suffix_repeats.without_repeats(documents(rows)).collect()
    assert sorted(r.n_bytes for r in got) == [20, 160, 320]
    assert suffix_repeats.without_repeats(documents([])).count() == 0


def test_repeats_of_many_texts_without_id(documents):
    rng = random.Random(12)
    passage = "".join(rng.choices("abcd ", k=150))
    rows = [(None, "".join(rng.choices("abcd ", k=200))) for _ in range(1200)]
    rows += [(None, "x" * 150), (None, "y" + passage), (3, passage), (4, "".join(rng.choices("abcd ", k=200)))]
    rows += [(7, "".join(rng.choices("efgh ", k=150))) for _ in range(800)]
    got = suffix_repeats.without_repeats(documents(rows)).collect()
    removed = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in got if r.spans]
    assert sorted(removed, key=str) == [(None, 150, b"x"), (None, 151, b"y")]
    assert sum(len(r.spans) for r in got) == 2


def test_repeats_in_a_text_of_several_pieces(documents):
    rng = random.Random(13)
    text = "".join(rng.choices("abcdefgh", k=suffix_repeats.PIECE + 30_000))
    at = suffix_repeats.PIECE - 120
    rows = [(1, text), (2, "x" * 40 + text[at : at + 300] + "y"), (3, text[-400:])]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_repeats.without_repeats(documents(rows)).collect()}
    assert got == {1: [], 2: [(40, 340)], 3: [(0, 400)]}
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_repeats.without_repeats(documents(rows), 255).collect()}
    assert got == {1: [], 2: [(40, 340)], 3: [(0, 400)]}


def test_ids_of_repeats_are_whole_numbers(documents):
    with pytest.raises(ValueError, match="whole numbers"):
        suffix_repeats.without_repeats(documents([(1, "a")]).withColumn("doc_id", F.col("doc_id").cast("string")))


def test_intervals_of_a_suffix_array():
    texts = sorted([b"abcx", b"abcy", b"abd", b"abd", b"b"])
    found = set(suffix_repeats.prefix_intervals(texts))
    assert found == {(0, 1, 3), (2, 3, 3), (0, 3, 2)}


def test_maximal_groups_have_all_occurrences():
    left, right = b"L" * 30, b"r" * 80
    occurrences = [(left + b"1", right + b"x"), (left + b"2", right + b"y"), (left + b"3", right + b"x"), (b"zz", right + b"q")]
    groups = {(a, b, tuple(sorted(g))) for a, b, g in suffix_repeats.maximal_repeats(occurrences, 100)}
    assert groups == {(30, 80, (0, 1, 2)), (30, 81, (0, 2))}


# Near duplicates


def brute_components(rows):
    rows = list(dict.fromkeys(rows))
    sets = [shingle_set(words_lower(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d, key=rank)
    return {row: (len(sets[i]), least[find(i)]) for i, row in enumerate(rows)}


@pytest.mark.parametrize("cell", [1024, 3])
def test_components_equal_brute_force(documents, cell):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "One two"), (10_004, "one TWO"), (None, "one two")]
    d = 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 120, 600]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            text = list(base)
            # A chain: each copy starts from the last one, so its ends may not be similar.
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.5:
                base = text
            rows.append((d, " ".join(text)))
            d += 1
    rows += [rows[9], rows[9], (20_000, rows[9][1])]
    settings = near_duplicates.Settings(cell=cell, members_per_task=2)
    got = near_duplicates.near_duplicate_classes(documents(rows), settings).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    expected = sorted((str(i), *map(str, want[i, t]), str(i == want[i, t][1])) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.n_shingles), str(r.component_id), str(r.kept)) for r in got) == expected


def test_near_copies_without_id(documents):
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(60):
        base = rng.choices(vocabulary, k=60)
        for i in range(rng.choice([1, 3, 9])):
            text = list(base)
            text[rng.randrange(60)] = f"own{k}x{i}"
            rows.append((rng.choice([None, None, len(rows)]), " ".join(text)))
    rows += [(None, "One two"), (None, "one two"), (None, None), (None, "")]
    got = near_duplicates.near_duplicate_classes(documents(rows)).collect()
    want = brute_components(rows)
    assert sorted(map(str, got)) == sorted(
        str(type(got[0])(doc_id=i, n_shingles=want[i, t][0], component_id=want[i, t][1], kept=i == want[i, t][1])) for i, t in rows
    )


def test_near_duplicates_of_nothing(documents):
    assert near_duplicates.near_duplicate_classes(documents([])).count() == 0


def test_connected_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    edges += [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(20)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# Lines


def brute_lines(rows):
    def compared(x):
        return len(x) >= line_dedup.MIN_CHARS and x.strip(" \t\n\x0b\x0c\r")

    lines = sorted(
        {(rank(d), p, x) for d, t in rows for p, x in enumerate((t or "").split("\n")) if compared(x)}
    )
    distinct = {x for _, _, x in lines}
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    blanked = {}
    long_ = {x for x in distinct if len(x) >= line_dedup.NEAR_CHARS}
    for x in long_:
        for i in range(len(x)):
            blanked.setdefault((i, x[:i], x[i + 1 :]), []).append(x)
            if x[:i] + x[i + 1 :] in long_:
                root[find(x)] = find(x[:i] + x[i + 1 :])
    for group in blanked.values():
        for x in group[1:]:
            root[find(x)] = find(group[0])
    first = {}
    for place in lines:
        first.setdefault(find(place[2]), place)
    out = {}
    for d, t in rows:
        kept, near = [], 0
        for p, x in enumerate((t or "").split("\n")):
            f = first[find(x)] if compared(x) else None
            if f and f[:2] != (rank(d), p):
                near += f[2] != x
            else:
                kept.append(x)
        out[d] = (near, None if t is None else "\n".join(kept))
    return out


@pytest.mark.parametrize("pairwise", [48, 2])
def test_lines_equal_brute_force(documents, monkeypatch, pairwise):
    # With 2, nearly all links come from wildcard keys.
    monkeypatch.setattr(line_dedup, "PAIRWISE", pairwise)
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefgh é😀", k=60))
    rows = [
        (i, "\n".join([base[:-3] + str(i % 90).zfill(3), f"line number {i * 7919} is long enough to count", base[: i % 50] + "Q" + base[i % 50 :]]))
        for i in range(150)
    ]
    rows += [(5000, None), (5001, ""), (5002, "\n\n"), (None, base), (5003, "short\nshort"), (5004, base[1:]), (5005, " " * 40), (5006, "x" * 20000)]
    rows += [rows[4], rows[4]]
    got = line_dedup.without_repeated_lines(documents(rows)).collect()
    assert len(got) == len(rows)
    want = brute_lines(rows)
    for r in got:
        assert (r.n_near, r.kept_text) == want[r.doc_id], r.doc_id
        assert r.n_lines == (len(r.text.split("\n")) if r.text is not None else 0)


def test_banded_edit_distance(spark):
    rng = random.Random(10)
    pairs = []
    for _ in range(800):
        a = rng.choices("abé😀", k=rng.randint(1, 9))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice("abé😀"))
            b.pop(rng.randrange(len(b)))
        pairs.append(("".join(a), "".join(b)))
        pairs.append(("".join(a), "".join(b) + "a"))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.select("a", "b", F.split("a", "").alias("ca"), F.split("b", "").alias("cb"))
    for most in (1, 2):
        rows = df.select(line_dedup.edit_distance(F.col("ca"), F.col("cb"), most).alias("d"), F.levenshtein("a", "b").alias("want"))
        assert all(min(r.d, most + 1) == min(r.want, most + 1) for r in rows.collect())


def test_short_lines_repeat_if_equal(documents):
    rows = [
        (1, "Ietzte.\n \nAll rights reserved.\nx"), (2, "Ietzte.\n \nx\nown line"), (3, "Ietzta.\nAll rights reserved\nIetzte."),
        (None, "All rights reserved.\nIetzta."),
    ]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_near, r.kept_text) for r in line_dedup.without_repeated_lines(documents(rows)).collect()}
    assert got == {
        1: (4, 0, 0, rows[0][1]), 2: (4, 2, 0, " \nown line"), 3: (3, 1, 0, "Ietzta.\nAll rights reserved"), None: (2, 2, 0, ""),
    }


@pytest.mark.parametrize(("edits", "pairwise"), [(1, 2), (3, 48), (4, 2)])
def test_lines_several_edits_apart(spark, monkeypatch, edits, pairwise):
    # With 2, nearly all lines go through further keys, and many through cells.
    monkeypatch.setattr(line_dedup, "PAIRWISE", pairwise)
    monkeypatch.setattr(line_dedup, "CELL", 3)
    rng = random.Random(edits)
    texts = set()
    for size in [30, 31, 33, 47, 56, 60, 64, 95, 112, 121, 128, 150, 160, 200, 256, 300] * 2:
        base = rng.choices("abcdefgh é😀", k=size)
        for _ in range(9):
            line = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choices("abé😀", k=rng.randint(0, 1))
            texts.add("".join(line))
    texts |= {"the same long beginning of many lines and " + "".join(rng.choices("abcdefgh", k=40)) for _ in range(30)}
    lines = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(sorted(t for t in texts if len(t) >= 30))], "lid bigint, line string, n int")
    v = lines.select(F.col("lid").alias("v"), F.col("line").alias("b"), F.col("n").alias("k"))
    most = F.least(F.floor(F.least("n", "k") / 30), F.lit(edits))
    near = lines.join(v, F.col("lid") > F.col("v")).where(F.levenshtein("line", "b") <= most).select(F.col("lid").alias("u"), "v")
    links = line_dedup._near_links(lines, edits)
    assert links.count() and not links.exceptAll(near).count()
    assert {tuple(r) for r in connected_components(links).collect()} == {tuple(r) for r in connected_components(near).collect()}


def test_lines_with_a_common_part_are_few_pairs(spark, monkeypatch):
    # Under one key, but with nothing else in common: before, each was compared with each.
    rows, write = {}, line_dedup.materialize

    def counted(df, label):
        out = write(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    rng = random.Random(12)
    texts = ["the same long beginning of many lines, and " + "".join(rng.choices("abcdefgh", k=90)) for _ in range(45)]
    texts.append(texts[7][:60] + "xyz" + texts[7][60:])
    lines = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(texts)], "lid bigint, line string, n int")
    assert [tuple(r) for r in line_dedup._near_links(lines, 4).collect()] == [(45, 7)]
    assert rows["line-pairs"] + rows.get("cell-pairs", 0) < 3 * len(texts)


def test_query_finds_replaced_words(documents):
    line = "the quick brown fox jumps over the lazy dog, and then it sleeps for the rest of a long summer's day without a dream"
    rows = [(1, line), (2, line.replace("quick", "slack")), (3, line.replace("quick brown", "black bird")), (None, "x\n" + line.replace("lazy ", ""))]
    got = {r.doc_id: (r.n_removed, r.n_near) for r in line_dedup.without_repeated_lines(documents(rows), edits=line_dedup.EDITS).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (0, 0), None: (0, 0)}
    with pytest.raises(ValueError, match="edits"):
        line_dedup.line_classes(documents(rows), edits=15)


def test_crowded_lines_are_one_row_each_until_their_keys_meet(spark, monkeypatch):
    rng = random.Random(5)
    lines = {k: "a common beginning " * 6 + "".join(rng.choice("abcdefgh") for _ in range(60)) for k in range(30)}
    lines[30] = lines[7][:-1] + "z"
    rows, write = {}, line_dedup.materialize

    def counted(df, label):
        out = write(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    table = spark.createDataFrame([(k, x, len(x)) for k, x in lines.items()], "lid long, line string, n int")
    assert [tuple(r) for r in line_dedup._near_links(table, 4).collect()] == [(30, 7)]
    assert rows["crowded-lines"] == rows["line-keys"] == 31


def test_lines_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.kept_text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {d: t for d, (_, t) in brute_lines([(r.doc_id, r.text) for r in docs.collect()]).items()}


def test_lines_of_nothing(documents):
    assert line_dedup.without_repeated_lines(documents([], extra=False)).count() == 0


def test_lines_need_no_python(documents):
    rows = [(1, "a line that is long enough to be compared\nb"), (2, "a line that is long enough to be compared")]
    plan = line_dedup.without_repeated_lines(documents(rows, extra=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Archives


def test_archives_round_trip(spark):
    rng = random.Random(11)
    page = "<p>é" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(i, f"http://h/{i}", page if i % 3 else "".join(rng.choices("ab\r\n", k=1500))) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: y", ""), (102, "u", "short"), (103, "u", "short"), (None, "n", page), (7, "http://h/7", rows[7][2])]
    rows += [(200, "big", "z" * (9 << 20))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as size", "'x' as digest")
    index = warc.archive_pages(pages, "2024-05-06T07:08:09Z")
    got = warc.read_records(index).collect()
    assert {r.date for r in got} == {"2024-05-06T07:08:09Z"}
    bare = warc.read_records(index, payloads=False)
    assert "payload" not in bare.columns and bare.exceptAll(warc.read_records(index).drop("payload")).count() == 0
    with pytest.raises(ValueError):
        warc.archive_pages(pages, "yesterday")
    assert index.count() == len(got) == len(rows)
    last = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None:
            last[data] = max(last.get(data, i), i)
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and i is not None and i != last[data]
        expected.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", str(last[data]) if revisit else "None"))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(expected)
    stored = {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"}
    assert all(hashlib.sha1(p).hexdigest() for _, p in stored) and (200, b"z" * (9 << 20)) in stored
    some = warc.read_records(index.where("page_id = 102")).collect()
    assert [bytes(r.payload) for r in some] == [b"short"]


def test_archives_of_nothing(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_ranges_are_joined():
    rows = [(0, 10), (12, 8), (100, 5), (105, 5)]
    assert list(warc.coalesce_ranges(rows, gap=4, most=50)) == [(0, 20, rows[:2]), (100, 110, rows[2:])]


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    from tools.check_oracle import compare

    assert compare(spark, name, "/root/testdata/sf0.001").startswith(("ok", "rows only"))
