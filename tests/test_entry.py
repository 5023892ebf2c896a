"""The driver contract, and queries against their SQL twins on the smallest data."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUICK = [
    "scan_text", "special_tokens", "tokenized_text", "token_min_count", "learn_vocab", "segment_words", "canon_bpe",
    "canon_byte_fallback", "symbol_tokens", "view_fuzzy", "overlap_all_rules", "multi_source_tokens", "aux_ppmi", "aux_oov_ngrams",
    "emb_std", "topk_neighbours", "transfer_full", "transfer_extend",
]
NAMES = sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else QUICK

# Custom algorithms that SQL cannot express; they come with a folder of their own.
LLM_WITHOUT = {n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"} - set(entry.oracle_sql())
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.queries()) - set(entry.oracle_sql()) == {"aux_factorised", "learn_merges", *LLM_WITHOUT}


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    from tools.check_oracle import compare

    assert compare(spark, name, DATA).startswith(("ok", "rows only"))
