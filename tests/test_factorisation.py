"""Learned vectors against numpy's own decomposition."""

import numpy as np
import pytest

from lexigraft.operators.factorisation import cell_product, factorise, orthonormal_map
from lexigraft.plans.auxiliary import load_auxiliary
from lexigraft.session import Limits

SCHEMA = "lang string, token string, ctx string, ppmi double"


def random_table(n, rank, seed, density=0.4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, rank)) * 2.0 ** -np.arange(rank)
    m = base @ base.T + 0.01 * rng.normal(size=(n, n))
    m = np.where(rng.random((n, n)) < density, np.maximum(m, 0), 0)
    return np.maximum(m, m.T)


def rows_of(matrix, lang):
    return [(lang, f"t{i:03}", f"t{j:03}", float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]


def best(matrix, dim):
    values, vectors = np.linalg.eigh(matrix)
    strong = np.argsort(-np.abs(values))[:dim]
    return vectors[:, strong] * np.sqrt(np.abs(values[strong])), values[strong]


def as_matrix(found, lang, n):
    by_token = {r.token: r.vector for r in found if r.vocab == lang}
    return np.array([by_token[f"t{i:03}"] for i in range(n)])


@pytest.mark.parametrize("cell_rows", [4096, 17])
def test_factors_are_the_strongest(spark, cell_rows):
    tables = {"x": random_table(90, 6, 1), "y": random_table(40, 4, 2)}
    for m in tables.values():
        assert m.any(axis=1).all()
    df = spark.createDataFrame([r for lang, m in tables.items() for r in rows_of(m, lang)], SCHEMA)
    limits = Limits(cell_rows=cell_rows, broadcast_bytes=(64 << 20) if cell_rows == 17 else 0)
    found = factorise(df, 4, steps=12, limits=limits).collect()
    for lang, m in tables.items():
        got = as_matrix(found, lang, len(m))
        want, values = best(m, 4)
        # Up to the signs of the columns, by the products of equally signed ones.
        np.testing.assert_allclose(got @ got.T, want @ want.T, atol=2e-3)
        signed = (got * np.sign((got * (m @ got)).sum(axis=0))) @ got.T
        residual = np.linalg.norm(m - signed)
        assert residual <= np.linalg.norm(m - (want * np.sign(values)) @ want.T) * (1 + 1e-5)


def test_bits_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(rows_of(random_table(60, 5, 3), "x"), SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in (3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = factorise(df.repartition(n, "ctx"), 5, steps=3, limits=Limits(cell_rows=16)).collect()
            results.append({r.token: r.vector for r in found})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) == 60


def test_tables_of_low_rank_and_none(spark):
    one = np.zeros((5, 5))
    one[0, 1] = one[1, 0] = 2.0
    found = factorise(spark.createDataFrame(rows_of(one, "x"), SCHEMA), 3).collect()
    got = np.array([r.vector for r in sorted(found, key=lambda r: r.token)])
    assert got.shape == (2, 3)
    np.testing.assert_allclose(np.abs(got[:, :2]), 1.0)
    np.testing.assert_allclose(got[:, 2], 0.0, atol=1e-12)
    assert factorise(spark.createDataFrame([], SCHEMA), 3).collect() == []
    assert factorise(spark.createDataFrame([("x", "a", "b", 0.0)], SCHEMA), 3).collect() == []


def test_products_and_bases():
    rng = np.random.default_rng(4)
    m = random_table(30, 3, 5)
    r, c = np.nonzero(m)
    b = rng.normal(size=(30, 7))
    np.testing.assert_allclose(cell_product(r, c, m[r, c], b, 30), m @ b)
    q = b @ orthonormal_map(b.T @ b)
    np.testing.assert_allclose(q.T @ q, np.eye(7), atol=1e-9)


def test_vectors_of_a_corpus_find_companions(spark):
    rng = np.random.default_rng(6)
    groups = [[f"{g}{k}" for k in range(6)] for g in "abc"]
    lines = [" ".join(rng.choice(groups[i % 3], 12)) for i in range(300)]
    corpus = spark.createDataFrame([("x", t) for t in lines], "lang string, text string")
    names = ["▁", *sorted({c for g in groups for w in g for c in w}), *[f"▁{w}" for g in groups for w in g]]
    vocab = spark.createDataFrame(
        [("x", t, i, None, False) for i, t in enumerate(names)], "vocab string, token string, id bigint, decoded string, is_special boolean"
    )
    found = load_auxiliary(vocab, corpus=corpus, dim=4, min_count=5, reduction="factorise").collect()
    vectors = {r.token: np.array(r.vector) for r in found if len(r.token) == 3}
    assert len(vectors) == 18

    def cosine(a, b):
        return vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])

    near = [cosine(f"▁{a}", f"▁{b}") for g in groups for a in g for b in g if a < b]
    far = [cosine(f"▁{a}", f"▁{b}") for a in groups[0] for b in groups[1] + groups[2]]
    assert min(near) > max(far) + 0.3
    with pytest.raises(ValueError, match="reduction"):
        load_auxiliary(vocab, corpus=corpus, reduction="none")
