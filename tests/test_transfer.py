"""Similarity, combination, random rows and whole transfers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraft import transfer, transfer_parts
from lexigraft.operators.combination import combine_vectors
from lexigraft.operators.lookup import with_source_vectors
from lexigraft.operators.similarity import cosine_summary, nearest, neighbour_weights, sparsemax, support_mask
from lexigraft.operators.statistics import dimension_stats, random_vectors
from lexigraft.plans import checks
from lexigraft.session import Limits


def project_on_simplex(z):
    falling = np.sort(z)[::-1]
    total = np.cumsum(falling)
    k = np.arange(1, len(z) + 1)
    size = k[1 + k * falling > total].max()
    return np.maximum(z - (total[size - 1] - 1) / size, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=30))
def test_support(z):
    z = np.array(z)
    kept = support_mask(z[None, :])[0]
    weights = project_on_simplex(z)
    assert kept[weights > 1e-9].all() and not kept[weights <= 0][z[weights <= 0] < z.max() - 1 - 1e-9].any()


def test_support_larger_than_the_sorted_columns():
    z = np.vstack([np.full(300, 0.4), np.linspace(0.4, 0.401, 300), np.r_[5.0, np.zeros(299)]])
    mask = support_mask(z)
    for row, kept in zip(z, mask):
        assert (kept == (project_on_simplex(row) > 0)).mean() > 0.99
    assert mask[0].all() and mask[2].sum() == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=2, max_size=40), st.integers(1, 6))
def test_support_of_slices_holds_the_support_of_the_row(z, slices):
    z = np.array(z)
    union = np.zeros(len(z), dtype=bool)
    for part in np.array_split(np.arange(len(z)), slices):
        if len(part):
            union[part] = support_mask(z[None, part])[0]
    weights = project_on_simplex(z)
    assert union[weights > 1e-9].all()
    again = np.zeros(len(z))
    again[union] = project_on_simplex(z[union])
    assert np.allclose(again, weights, atol=1e-9)


def test_sparsemax_ties_and_dominant_value(spark):
    rows = [("t", 1, 0.5), ("t", 2, 0.5), ("d", 1, 3.0), ("d", 2, 0.1), ("e", 1, 0.2), ("e", 2, 0.2), ("e", 3, 0.2)]
    got = sparsemax(spark.createDataFrame(rows, "g string, i int, z double"), ["g"], "i").collect()
    assert sorted((r["g"], r["i"], round(r["w"], 9)) for r in got) == [
        ("d", 1, 1.0),
        ("e", 1, round(1 / 3, 9)),
        ("e", 2, round(1 / 3, 9)),
        ("e", 3, round(1 / 3, 9)),
        ("t", 1, 0.5),
        ("t", 2, 0.5),
    ]


@pytest.fixture(scope="module")
def annotated(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(90):
        kind = "copied" if i % 3 else "weighted"
        # One pair holds most tokens.
        pair = "q" if i >= 81 else "p"
        rows.append((pair, "s", i, f"t{i}", kind, kind == "copied", i + 1000, rng.normal(size=6).tolist()))
    schema = "pair_id string, source string, id bigint, token string, outcome string, use_for_init boolean, src_id bigint, aux array<double>"
    return spark.createDataFrame(rows, schema).cache()


def brute_similarities(rows):
    out = {}
    for n in rows:
        for o in rows:
            if n["pair_id"] == o["pair_id"] and n["outcome"] == "weighted" and o["use_for_init"]:
                a, b = np.array(n["aux"]), np.array(o["aux"])
                out.setdefault((n["pair_id"], n["id"]), {})[o["id"]] = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    return out


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_weights_against_dense_computation(annotated, cell_rows):
    z = brute_similarities(annotated.collect())
    got = {}
    for r in neighbour_weights(annotated, Limits(cell_rows=cell_rows)).collect():
        got.setdefault((r["pair_id"], r["id"]), {})[r["nbr_id"]] = r["w"]
        assert r["src_id"] == r["nbr_id"] + 1000
    assert got.keys() == z.keys()
    for key, row in z.items():
        ids = sorted(row)
        want = project_on_simplex(np.array([row[i] for i in ids]))
        assert np.allclose([got[key].get(i, 0.0) for i in ids], want, atol=1e-12)


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_nearest_and_summary(annotated, cell_rows):
    z = brute_similarities(annotated.collect())
    limits = Limits(cell_rows=cell_rows)
    best = {}
    for r in nearest(annotated, 3, limits).collect():
        best.setdefault((r["pair_id"], r["id"]), {})[r["rank"]] = r["nbr_id"]
    for key, row in z.items():
        want = sorted(row, key=lambda i: (-row[i], i))[:3]
        assert [best[key][k] for k in (1, 2, 3)] == want
    for r in cosine_summary(annotated, limits).collect():
        row = z[r["pair_id"], r["id"]]
        assert r["n_pairs"] == len(row)
        assert r["z_sum"] == pytest.approx(sum(row.values())) and r["z_max"] == pytest.approx(max(row.values()))


def test_new_tokens_without_neighbours_are_an_error(annotated):
    with pytest.raises(Exception, match="no overlapping token"):
        neighbour_weights(annotated.where("outcome = 'weighted'")).collect()
    assert neighbour_weights(annotated.where("outcome = 'copied'")).count() == 0


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(1)
    rows = [("s", m, i, rng.normal(size=4).astype("float32").tolist()) for m in ("input", "output") for i in range(40)]
    return spark.createDataFrame(rows, "vocab string, matrix string, id bigint, vector array<float>").cache()


def test_combination_folds_in_blocks(spark, embeddings):
    rng = np.random.default_rng(2)
    rows = [("p", t, "s", k + 1, int(rng.integers(40)), float(rng.random())) for t in range(5) for k in range(17)]
    # One source row takes part in a third of all sums.
    rows += [("p", t, "s", 18 + k, 7, 0.25) for t in range(5) for k in range(9)]
    parts = spark.createDataFrame(rows, "pair_id string, id bigint, source string, k int, src_id bigint, w double")
    table = {(r["matrix"], r["id"]): np.array(r["vector"]) for r in embeddings.collect()}
    for limits in (Limits(), Limits(fold_rows=2, salts=3)):
        for r in combine_vectors(parts, embeddings, ["pair_id", "id"], limits).collect():
            want = sum(w * table[r["matrix"], s] for _, t, _, _, s, w in rows if t == r["id"])
            assert np.allclose(r["vector"], want)


def test_combination_has_the_same_bits_in_all_blocks(spark, embeddings):
    rng = np.random.default_rng(3)
    # Every token needs row 7; the others are shared by some of them.
    rows = [("p", t, "s", k + 1, 7 if k == 0 else int(rng.integers(40)), float(rng.random())) for t in range(60) for k in range(1 + t % 11)]
    parts = spark.createDataFrame(rows, "pair_id string, id bigint, source string, k int, src_id bigint, w double")
    table = {(r["matrix"], r["id"]): np.array(r["vector"]) for r in embeddings.collect()}
    by_token = {}
    for _, t, _, k, s, w in rows:
        by_token.setdefault(t, []).append((k, s, w))

    def folded(matrix, token, fold):
        blocks = {}
        for k, s, w in sorted(by_token[token]):
            at = (k - 1) // fold
            blocks[at] = blocks.get(at, np.zeros(4)) + w * table[matrix, s]
        total = np.zeros(4)
        for at in sorted(blocks):
            total = total + blocks[at]
        return total.tolist()

    for fold in (3, 256):
        seen = []
        # From one block for all tokens to one weight a block.
        for size in (32 << 20, 400, 1):
            limits = Limits(fold_rows=fold, product_bytes=size)
            got = {(r["matrix"], r["id"]): r["vector"] for r in combine_vectors(parts.repartition(5), embeddings, ["pair_id", "id"], limits).collect()}
            assert got == {(m, t): folded(m, t, fold) for m in ("input", "output") for t in by_token}
            seen.append(got)
        assert seen[0] == seen[1] == seen[2]


def test_combination_needs_one_source_row_per_matrix(spark, embeddings):
    def combined(rows, table=embeddings):
        parts = spark.createDataFrame(rows, "pair_id string, id bigint, source string, k int, src_id bigint, w double")
        return combine_vectors(parts, table, ["pair_id", "id"]).collect()

    good = ("p", 1, "s", 1, 3, 1.0)
    assert len(combined([good])) == 2 and combined([]) == []
    for bad in [("p", 2, "s", 1, 99, 1.0), ("p", 2, "unknown", 1, 3, 1.0), ("p", 2, None, 1, 3, 1.0), ("p", 2, "s", 1, None, 1.0)]:
        with pytest.raises(Exception, match="no source vector"):
            combined([good, bad])
    with pytest.raises(Exception, match="more than one source vector for id 3"):
        combined([good], embeddings.unionByName(embeddings.where("id = 3")))


def test_statistics_use_all_rows(embeddings):
    got = {(r["matrix"], r["pos"]): (r["mean"], r["std"]) for r in dimension_stats(embeddings).collect()}
    for m in ("input", "output"):
        x = np.array([r["vector"] for r in embeddings.where(F.col("matrix") == m).collect()], dtype="float64")
        assert np.allclose([got[m, d] for d in range(4)], np.c_[x.mean(0), x.std(0, ddof=1)], atol=1e-9)


def test_random_rows(spark, embeddings):
    tokens = spark.range(3000).select(F.lit("p").alias("pair_id"), F.lit("s").alias("source"), "id")
    stats = dimension_stats(embeddings)
    a = random_vectors(tokens, stats, 7)
    b = random_vectors(tokens.orderBy(F.desc("id")).repartition(3), stats, 7)
    assert a.exceptAll(b).count() == 0 and a.count() == 6000
    assert random_vectors(tokens, stats, 8).intersect(a).count() == 0
    x = np.array([r["vector"] for r in a.where("matrix = 'input'").collect()])
    want = {r["pos"]: (r["mean"], r["std"]) for r in stats.where("matrix = 'input'").collect()}
    for d in range(4):
        assert abs(x[:, d].mean() - want[d][0]) < 0.1 and abs(x[:, d].std() - want[d][1]) < 0.1


@pytest.fixture
def small(spark, embeddings):
    """A source of 40 tokens; targets with copied, rare, new and unknown tokens."""
    schema = "vocab string, token string, id bigint, decoded string, is_special boolean"
    source = spark.createDataFrame([("s", f"▁w{i}", i, f" w{i}", False) for i in range(40)], schema)
    target = [(f"▁w{i}", i) for i in range(12)] + [(f"▁n{i}", 12 + i) for i in range(6)]
    target = spark.createDataFrame([("t", t, i, t.replace("▁", " "), False) for t, i in target], schema)
    rng = np.random.default_rng(3)
    aux = [("t", f"▁w{i}", rng.normal(size=3).tolist()) for i in range(10)]
    aux += [("t", "▁w10", [0.0, 0.0, 0.0])]
    aux += [("t", f"▁n{i}", rng.normal(size=3).tolist()) for i in range(4)] + [("t", "▁n4", [0.0, 0.0, 0.0])]
    aux = spark.createDataFrame(aux, "vocab string, token string, vector array<double>")
    return source, target, embeddings, aux, [("p", "s", "t")]


def test_outcomes(small):
    parts = transfer_parts(*small)
    got = {r["token"]: (r["outcome"], r["use_for_init"]) for r in parts.annotated.collect()}
    assert all(got[f"▁w{i}"] == ("copied", True) for i in range(10))
    assert got["▁w10"] == got["▁w11"] == ("copied", False)
    assert all(got[f"▁n{i}"] == ("weighted", False) for i in range(4))
    assert got["▁n4"] == got["▁n5"] == ("random", False)
    neighbours = {r["nbr_id"] for r in parts.weights.collect()}
    assert neighbours <= set(range(10))
    bad = checks.convex_weights(parts.weights).first()
    assert bad["n"] == 4 and bad["n_bad"] == 0
    report = {r["outcome"]: (r["n"], r["n_pruned"]) for r in checks.init_report(parts.annotated).collect()}
    assert report["copied"] == (12, 2) and report["random"] == (2, 0)


def test_a_missing_source_row_is_an_error(small):
    source, target, embeddings, *rest = small
    for lost in ("id != 3", "NOT (matrix = 'output' AND id = 3)", "false"):
        with pytest.raises(Exception, match="no source (vector|matrix)"):
            transfer(source, target, embeddings.where(lost), *rest).collect()


def test_two_auxiliary_vectors_for_a_token_are_an_error(small):
    source, target, embeddings, aux, *rest = small
    with pytest.raises(Exception, match="more than one auxiliary vector"):
        transfer(source, target, embeddings, aux.unionByName(aux.limit(1)), *rest).collect()


def test_a_doubled_vocabulary_entry_is_an_error(small):
    source, target, *rest = small
    with pytest.raises(ValueError, match="2 times"):
        transfer(source, target.unionByName(target.where("id = 1")), *rest)


def test_checks_count_lost_rows(small):
    parts = transfer_parts(*small)
    result = transfer(*small).where("id != 5")
    found = checks.overlap_copied(result, parts.annotated, small[2]).first()
    assert found["n_differing"] == 2


@pytest.mark.parametrize("centre,width", [(0.0, 1e-7), (1e3, 1e-4), (0.0, 1e5), (5500.0, 1500.0), (7.0, 0.0)])
def test_statistics_at_every_scale(spark, centre, width):
    rng = np.random.default_rng(1)
    x = (centre + width * rng.standard_normal((300, 2))).astype(np.float32)
    df = spark.createDataFrame([("v", "m", i, r.tolist()) for i, r in enumerate(x)], "vocab string, matrix string, id bigint, vector array<float>")
    got = {r["pos"]: (r["mean"], r["std"]) for r in dimension_stats(df).collect()}
    x = x.astype(float)
    for d in range(2):
        assert got[d] == pytest.approx((x[:, d].mean(), x[:, d].std(ddof=1)), rel=1e-6, abs=1e-12)


def test_transfer_assembles_all_rows(small):
    rows = transfer(*small, target_sizes={"p": 20}).collect()
    assert len(rows) == 40
    table = {(r["matrix"], r["id"]): r["vector"] for r in small[2].collect()}
    for r in rows:
        assert len(r["vector"]) == 4
        if r["id"] < 12:
            assert r["outcome"] == "copied" and r["vector"] == table[r["matrix"], r["id"]]
        elif r["id"] >= 18:
            assert r["outcome"] == "zero" and r["token"] is None and not any(r["vector"])
        else:
            assert any(r["vector"])
    rows = {(r["matrix"], r["id"]): r["vector"] for r in rows}
    assert rows["input", 13] != rows["output", 13]


def test_transfer_is_reproducible(spark, small):
    first = transfer(*small, seed=1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        source, target, emb, aux, pairs = small
        second = transfer(source.repartition(7), target.repartition(5), emb.coalesce(1), aux.repartition(3), pairs, seed=1)
        got = checks.differing_rows(first, second).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (got["n_rows"], got["n_differing"]) == (36, 0)


@pytest.mark.parametrize("strict", [False, True])
def test_extension_counts_id_zero_as_absent(spark, small, strict):
    source, target, emb, aux, pairs = small
    extend = target.where("id < 12 or id >= 14")
    parts = transfer_parts(source, target, emb, aux, pairs, extend_vocab=extend, strict_membership=strict)
    got = {r["id"]: r["use_for_init"] for r in parts.annotated.collect()}
    assert got[0] is strict and got[1] is True
    # Membership only concerns overlapping tokens.
    assert {r["id"] for r in parts.annotated.where("outcome = 'weighted'").collect()} == {12, 13, 14, 15}


def test_missing_source_row_is_an_error(small):
    source, target, emb, aux, pairs = small
    parts = transfer_parts(source, target, emb, aux, pairs)
    with pytest.raises(Exception, match="no source vector for id 3"):
        with_source_vectors(parts.annotated, emb.where("id <> 3")).select("vector").collect()


def test_no_new_tokens(small):
    source, target, emb, aux, pairs = small
    rows = transfer(source, target.where("id < 12"), emb, aux, pairs).collect()
    assert len(rows) == 24 and {r["outcome"] for r in rows} == {"copied"}
