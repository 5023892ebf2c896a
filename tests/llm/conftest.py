import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A table of documents out of (id, text) with extra columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if extra:
            for name in ("n", "key", "d", "row", "line", "spans", "component_id", "kept", "_key", "id", "page_id"):
                df = df.selectExpr("*", f"cast(null as string) as `{name}`")
        return df

    return make
