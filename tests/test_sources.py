"""Readers, writers and the cache."""

import gzip
import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexigraft.sources import cache, sinks, tables


def test_corpus_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo words\n")
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"text": t, "x": 1}) for t in ["one", "line\nbreak"]))
    lines = sorted(r["text"] for r in tables.read_corpus(spark, str(tmp_path / "a.txt")).collect())
    assert lines == ["", "one", "two words"]
    got = tables.read_corpus(spark, str(tmp_path / "b.jsonl"), "de").collect()
    assert {(r["lang"], r["text"]) for r in got} == {("de", "one"), ("de", "line\nbreak")}
    with pytest.raises(ValueError):
        tables.read_corpus(spark, str(tmp_path / "c.csv"))
    (tmp_path / "d.jsonl.gz").write_bytes(gzip.compress(b'{"text": "packed"}\n'))
    assert [r["text"] for r in tables.read_corpus(spark, str(tmp_path / "d.jsonl.gz")).collect()] == ["packed"]
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "part").write_text("x\n")
    assert tables.read_corpus(spark, str(tmp_path / "folder"), format="text").count() == 1


@pytest.mark.parametrize("bad", ['{"text": "x"', '{"other": 1}', '{"text": null}'])
def test_broken_samples_are_errors(spark, tmp_path, bad):
    (tmp_path / "a.jsonl").write_text('{"text": "good"}\n' + bad + "\n")
    with pytest.raises(Exception):
        tables.read_corpus(spark, str(tmp_path / "a.jsonl")).collect()
    kept = tables.read_corpus(spark, str(tmp_path / "a.jsonl"), corrupt="keep").collect()
    assert sorted(r["text"] is None for r in kept) == [False, True]


def test_special_token_maps(spark, tmp_path):
    folder = tmp_path / "xx"
    folder.mkdir()
    (folder / "map.json").write_text(json.dumps({"bos_token": "<s>", "mask_token": {"content": "<mask>"}, "eos_token": "<s>"}, indent=1))
    got = tables.read_special_tokens(spark, str(tmp_path / "*" / "map.json")).collect()
    assert {r["token"] for r in got} == {"<s>", "<mask>"} and len(got) == 2
    assert Path(got[0]["vocab"]).name == "xx"


def test_additional_special_tokens(spark):
    text = json.dumps({"unk_token": "[UNK]", "additional_special_tokens": ["<a>", {"content": "<b>"}]})
    maps = spark.createDataFrame([("v", text)], "vocab string, json string")
    assert {r["token"] for r in tables.special_tokens(maps).collect()} == {"[UNK]", "<a>", "<b>"}



def test_special_roles_of_any_map(spark):
    text = {
        "bos_token": "<s>", "image_token": {"content": "<img>", "special": True}, "extra": [{"content": "<a>"}, "<b>", {"id": 1}, 7, None],
        "add_space": True, "length": 512, "nothing": None, "other": {"name": "x"}, "empty": [], "odd.name": "<s>",
    }
    maps = spark.createDataFrame([("v", json.dumps(text)), ("w", "{}"), ("x", None), ("y", " ")], "vocab string, json string")
    got = sorted((r["vocab"], r["role"], r["token"]) for r in tables.special_roles(maps).collect())
    assert got == [("v", "bos_token", "<s>"), ("v", "extra", "<a>"), ("v", "extra", "<b>"), ("v", "image_token", "<img>"), ("v", "odd.name", "<s>")]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        tables.special_roles(spark.createDataFrame([("v", '{"bos_token": ')], "vocab string, json string")).collect()
    assert tables.special_roles(maps.limit(0)).count() == 0


def test_special_maps_round_trip(spark, tmp_path):
    rows = [("de", "bos_token", "<s>", True), ("de", "x", 'a"b\\', False), ("de", "x", "ü", True), ("fr", "bos_token", "[B]", False)]
    sinks.write_special_maps(spark.createDataFrame(rows, "vocab string, role string, token string, plain boolean"), str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("*/*.txt"))) == 2
    got = {(r["vocab"][-2:], r["role"], r["token"]) for r in tables.read_special_roles(spark, str(tmp_path / "m" / "*" / "*.txt")).collect()}
    assert got == {r[:3] for r in rows}


def test_duplicate_entries(make_vocab):
    got = tables.duplicate_entries(make_vocab([("a", 0), ("a", 1), ("b", 1)])).collect()
    assert {(r["key"], r["n"]) for r in got} == {("token a", 2), ("id 1", 2)}


def test_word_vectors_are_pruned_by_language(spark, tmp_path):
    rows = [("de", "a", [1.0]), ("fr", "b", [2.0])]
    sinks.write_word_vectors(spark.createDataFrame(rows, tables.WORD_VECTOR_SCHEMA), str(tmp_path / "w"))
    df = tables.read_word_vectors(spark, str(tmp_path / "w"), ["fr"])
    assert [r["word"] for r in df.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(lang#" in df._jdf.queryExecution().toString()



def test_word_vectors_are_pruned_by_the_pairs(spark, tmp_path):
    rows = [(lang, f"{lang}{i}", [float(i)]) for lang in ("de", "fr", "es") for i in range(3)]
    sinks.write_word_vectors(spark.createDataFrame(rows, tables.WORD_VECTOR_SCHEMA), str(tmp_path / "w"))
    pairs = spark.createDataFrame([("1", "en", "fr"), ("2", "en", "fr"), ("3", "xx", "de")], "pair_id string, source string, target string")
    pairs.write.parquet(str(tmp_path / "p"))
    wanted = spark.read.parquet(str(tmp_path / "p")).where("source = 'en'").select(F.col("target").alias("lang"))
    df = tables.read_word_vectors(spark, str(tmp_path / "w"), wanted)
    assert sorted(r["word"] for r in df.collect()) == ["fr0", "fr1", "fr2"]
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()


def test_matrix_sink(spark, tmp_path):
    rows = [("p", "input", i, f"t{i}", "copied", [float(i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "pair_id string, matrix string, id bigint, token string, outcome string, vector array<float>")
    sinks.write_matrix(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).select(df.columns).exceptAll(df).count() == 0



def test_matrix_sink_counts_what_it_writes(spark, tmp_path):
    rows = [(f"p{i % 3}", m, i, f"t{i}", "copied" if i % 7 else "random", [float(i)]) for i in range(200) for m in ("input", "output")]
    df = spark.createDataFrame(rows, "pair_id string, matrix string, id bigint, token string, outcome string, vector array<float>")
    got = sinks.write_matrix(df.repartition(5), str(tmp_path / "m"), ["p0", "p1", "p2", "unused"])
    want = spark.read.parquet(str(tmp_path / "m")).groupBy("pair_id", "outcome").count()
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and sum(n for _, _, n in got) == 400
    with pytest.raises(ValueError, match="400 rows written"):
        sinks.write_matrix(df, str(tmp_path / "n"), ["p0", "p1"])
    assert sinks.write_matrix(df.limit(0), str(tmp_path / "o"), ["p0"]) == []


def test_fingerprint_follows_content_not_order(spark):
    rows = [("v", f"t{i}", i) for i in range(50)]
    make = lambda r: spark.createDataFrame(r, "vocab string, token string, id bigint")
    key = cache.cache_key("data/x.txt", make(rows), dim=3)
    assert key == cache.cache_key("data/x.txt", make(rows[::-1]).repartition(3), dim=3)
    assert key.startswith("data_x.txt-")
    changed = [("v", "other", 0), *rows[1:]]
    # Two equal rows cancel in an exclusive or, but not here.
    doubled = [*rows, ("v", "z", 99), ("v", "z", 99)]
    others = [cache.cache_key("data/x.txt", make(changed), dim=3), cache.cache_key("data/x.txt", make(doubled), dim=3)]
    others += [cache.cache_key("data/x.txt", make(rows), dim=4), cache.cache_key("y", make(rows), dim=3)]
    assert len({key, *others}) == 5


def test_fingerprints_do_not_collide(spark):
    pairs = [("x:y", "z"), ("x", "y:z"), (None, "z"), ("", "z"), ("z", None), ("1:x", ""), ("-", "z")]
    keys = [cache.cache_key("k", spark.createDataFrame([p], "a string, b string")) for p in pairs]
    keys.append(cache.cache_key("k", spark.createDataFrame([pairs[0]], "a string, c string")))
    keys += [cache.cache_key("k", spark.range(1), a="1, b=2"), cache.cache_key("k", spark.range(1), a=1, b=2)]
    assert len(set(keys)) == len(keys)


def test_key_of_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    key = cache.cache_key("k", df, by="files")
    assert key == cache.cache_key("k", df, by="files") != cache.cache_key("k", df)
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert cache.cache_key("k", spark.read.parquet(str(tmp_path / "t")), by="files") != key


def test_compute_or_load(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert cache.compute_or_load(spark, str(tmp_path), "k", build)[1] is False
    df, found = cache.compute_or_load(spark, str(tmp_path), "k", build)
    assert found and df.count() == 3 and len(calls) == 1
    for f in (tmp_path / "k" / "manifest").glob("*"):
        f.unlink()
    assert cache.compute_or_load(spark, str(tmp_path), "k", build)[1] is False and len(calls) == 2


def entry_folders(root):
    return sorted(f for f in (root / "k").iterdir() if f.name.startswith("data-"))


def test_an_interrupted_build_is_never_read(spark, tmp_path):
    root = tmp_path / "cache"

    def breaks():
        return spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        cache.compute_or_load(spark, str(root), "k", breaks)
    # A build whose data are whole, but whose manifest was not published.
    spark.range(9).write.parquet(str(root / "k" / "data-0"))
    (root / "k" / "manifest" / "_temporary").mkdir(parents=True)
    table, found = cache.compute_or_load(spark, str(root), "k", lambda: spark.range(3))
    assert not found and table.count() == 3
    assert cache.compute_or_load(spark, str(root), "k", breaks)[1]


def test_the_second_builder_yields_to_the_first(spark, tmp_path):
    root, inner = str(tmp_path / "cache"), []

    def slow():
        inner.append(cache.compute_or_load(spark, root, "k", lambda: spark.range(5).withColumn("by", F.lit("fast"))))
        return spark.range(5).withColumn("by", F.lit("slow"))

    table, found = cache.compute_or_load(spark, root, "k", slow)
    assert not found and not inner[0][1]
    assert {r["by"] for r in table.collect()} == {r["by"] for r in inner[0][0].collect()} == {"fast"}
    again, found = cache.compute_or_load(spark, root, "k", slow)
    assert found and again.first()["by"] == "fast" and len(inner) == 1


def test_both_manifests_at_once_give_one_table(spark, tmp_path):
    """Two builders that publish without seeing each other: all later readers take the same one."""
    root = tmp_path / "cache"
    for name in ("a", "b"):
        cache.compute_or_load(spark, str(root / name), "k", lambda: spark.range(4).withColumn("by", F.lit(name)))
    both = root / "both" / "k"
    for name in ("a", "b"):
        shutil.copytree(root / name / "k", both, dirs_exist_ok=True)
    for _ in range(2):
        table, found = cache.compute_or_load(spark, str(root / "both"), "k", lambda: spark.range(0))
        assert found and {r["by"] for r in table.collect()} == {"a"}


@pytest.mark.parametrize("damage", ["missing", "longer", "gone", "rows"])
def test_a_damaged_entry_is_built_anew(spark, tmp_path, damage):
    root, verify = tmp_path / "cache", "content" if damage == "rows" else "files"

    def load():
        return cache.compute_or_load(spark, str(root), "k", lambda: spark.range(0, 50, 1, 3), verify)

    spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")  # numbers stand in the file as they are
    load()
    spark.conf.unset("spark.sql.parquet.compression.codec")
    (folder,) = entry_folders(root)
    parts = sorted(folder.glob("part-*"))
    if damage == "missing":
        parts[0].unlink()
    elif damage == "longer":
        parts[0].write_bytes(parts[0].read_bytes() + b"x")
    elif damage == "gone":
        for f in folder.iterdir():
            f.unlink()
    else:  # another row in a file of the same name and length
        data = parts[0].read_bytes()
        five, other = ((n).to_bytes(8, "little") for n in (5, 105))
        assert data.count(five) == 1
        parts[0].write_bytes(data.replace(five, other))
    for f in folder.glob(".*.crc"):
        f.unlink()
    with pytest.warns(UserWarning):
        table, found = load()
    assert not found and sorted(r["id"] for r in table.collect()) == list(range(50)) and len(entry_folders(root)) == 2
    with pytest.warns(UserWarning):
        assert load()[1]
    with pytest.raises(ValueError):
        cache.compute_or_load(spark, str(root), "k", lambda: spark.range(1), "none")
