"""The pipeline's stages, each against what it must do with its own input."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lexigraft.llm.shingles import shingle_set, words_lower

from .test_corpus_operators import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and result of every stage, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"": docs.collect()}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def test_columns(stages):
    for name, _ in pipeline.STAGES[:-1]:
        assert stages[name][0].asDict().keys() == stages[""][0].asDict().keys()


def test_quality_keeps_good_documents(spark, stages):
    kept = {r.doc_id for r in stages["quality_rules"]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in stages[""]}
    good = [d for d, q in labels.items() if q == 1 and len(texts[d].split()) >= 40]
    assert len([d for d in good if d in kept]) >= 0.97 * len(good)
    assert len([d for d, q in labels.items() if q == 0 and d not in kept]) > 0.5 * sum(q == 0 for q in labels.values())


def test_line_dedup(stages):
    rows = [(r.doc_id, r.text) for r in stages["quality_rules"]]
    want = {d: t for d, (_, t) in brute_lines(rows).items()}
    got = {r.doc_id: r.text for r in stages["line_dedup"]}
    assert got == {d: t for d, t in want.items() if t.strip() or t == dict(rows)[d]}
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"] if r.text != dict(rows)[r.doc_id])


def test_near_dedup(stages):
    rows = [(r.doc_id, r.text) for r in stages["line_dedup"]]
    classes = brute_components(rows)
    assert {r.doc_id for r in stages["near_dedup"]} == {d for d, t in rows if classes[d, t][1] == d}


def test_decontamination(spark, stages):
    items = [shingle_set(words_lower(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def clean(text):
        own = shingle_set(words_lower(text))
        return not any(len(s & own) >= 0.75 * len(s) for s in items)

    want = {r.doc_id for r in stages["near_dedup"] if clean(r.text)}
    assert {r.doc_id for r in stages["decontamination"]} == want


def test_round_trip(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in stages["decontamination"]}
    for r in stages["bpe_round_trip"]:
        joined = " ".join(map(str, ids[r.doc_id])).encode()
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(joined).hexdigest())
    assert len(stages["bpe_round_trip"]) == len(ids)


def test_odd_rows(spark, documents):
    good = " ".join(f"word{i} the of" for i in range(60))
    rows = [(1, good), (1, good), (None, good), (2, None), (3, ""), (None, None), (4, good + " more")]
    docs = documents(rows)
    kept = {
        "quality_rules": {1, None, 4},
        "line_dedup": {1, 2, 3, None, 4},
        "near_dedup": {1, 2, 3, None},
        "decontamination": {1, 2, 3, None, 4},
    }
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF).collect()
        assert {r.doc_id for r in got} == kept[name], name
        assert all(set(r.asDict()) == set(pipeline.COLUMNS) for r in got)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()} == {1, 2, 3, None}
    assert pipeline.near_dedup(spark, docs, SF).where("doc_id = 1").count() == 1
    assert pipeline.bpe_round_trip(spark, docs, SF).count() == len(rows)
