import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("lexigraft-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    import __spark_entry__

    __spark_entry__._ship(session)
    yield session
    session.stop()


@pytest.fixture
def make_vocab(spark):
    def make(rows, name="v"):
        """Rows of (token, id), (token, id, decoded) or (token, id, decoded, is_special)."""
        full = [(name, r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else False) for r in rows]
        return spark.createDataFrame(full, "vocab string, token string, id bigint, decoded string, is_special boolean")

    return make


@pytest.fixture
def family(spark):
    def of(name, kind):
        return spark.createDataFrame([(name, kind)], "vocab string, family string")

    return of
