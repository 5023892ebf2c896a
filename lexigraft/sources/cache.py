"""Compute-or-load cache of written tables."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
import warnings
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexigraft.functions.hashing import row_digest


def fingerprint(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """Order-free content fingerprint ``(…, n, digest)``.

    The exclusive or cancels equal rows, so the sum of the low digits and the
    row count go in as well. Everything combines on the map side.
    """
    digest = row_digest(*[F.col(c) for c in columns])
    hashed = df.select(*(group or []), digest.alias("_h"))
    low = F.col("_h").bitwiseAND(F.lit((1 << 24) - 1))
    parts = hashed.groupBy(*(group or [])).agg(
        F.count("*").alias("n"), F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("x"), F.coalesce(F.sum(low), F.lit(0)).alias("s")
    )
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "x", "s")])
    return parts.select(*(group or []), "n", F.md5(text).alias("digest"))


def files_fingerprint(df: DataFrame) -> str:
    """Fingerprint of the files behind a table: path, length and time of change, no content."""
    files = df.sparkSession.read.format("binaryFile").load(df.inputFiles())
    return fingerprint(files, ["path", "length", "modificationTime"]).first()["digest"]


def cache_key(name: str, *inputs: DataFrame, by: str = "content", **params: object) -> str:
    """Key of a derived table: name, schemas and inputs, parameters.

    ``by="files"`` takes the files of the inputs instead of their rows: an answer
    without reading a corpus, for inputs that are read straight from files.
    """
    if by not in ("content", "files"):
        raise ValueError(f"by must be 'content' or 'files', not {by!r}")
    digests = [
        files_fingerprint(df) if by == "files" else fingerprint(df, df.columns).first()["digest"] for df in inputs
    ]
    text = json.dumps([by, [df.schema.simpleString() for df in inputs], digests, sorted((k, repr(v)) for k, v in params.items())])
    return f"{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}-{hashlib.sha256(text.encode()).hexdigest()[:32]}"


# One row per finished build of an entry.
MANIFEST = "builder string, at double, folder string, n_files bigint, files string, n_rows bigint, digest string"


def _files(df: DataFrame) -> tuple[int, str]:
    """Number of the files behind a written table, and a digest of their names and lengths; no content is read."""
    files = df.sparkSession.read.format("binaryFile").load(df.inputFiles())
    row = fingerprint(files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length"), ["name", "length"]).first()
    return row["n"], row["digest"]


def _content(df: DataFrame) -> tuple[int, str]:
    row = fingerprint(df, df.columns).first()
    return row["n"], row["digest"]


def _manifests(spark: SparkSession, path: str) -> list[Row]:
    """The finished builds of an entry, first published first."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").where("digest IS NOT NULL").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: (r["at"], r["builder"]))


def _load(spark: SparkSession, path: str, verify: str) -> DataFrame | None:
    """The first finished build that is as its manifest says."""
    for row in _manifests(spark, path):
        folder = f"{path}/{row['folder']}"
        try:
            table = spark.read.parquet(folder)
            sound = _files(table) == (row["n_files"], row["files"])
            if sound and verify == "content":
                sound = _content(table) == (row["n_rows"], row["digest"])
        except (PySparkException, Py4JJavaError) as e:
            warnings.warn(f"cannot read {folder}: {e}", stacklevel=3)
            continue
        if sound:
            return table
        warnings.warn(f"{folder} is not as it was written", stacklevel=3)
    return None


def compute_or_load(
    spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame], verify: str = "files"
) -> tuple[DataFrame, bool]:
    """The table stored under ``root/key``, built and written if it is not there.

    Returns the table and whether it was found. Several jobs can share a ``root``: a builder writes to a folder
    of its own and then publishes a manifest (files, rows, digest of the rows as read back). What has no manifest, such
    as the rest of an interrupted build, is never read. A builder that finds another's manifest when it has finished takes
    that table, so all take the first one published; its own folder stays unused. Nothing is overwritten or deleted.

    On load a table is compared with its manifest: names and lengths of its files, and with ``verify="content"``
    also its rows, which reads it once more. One that differs is passed over with a warning and built anew.
    """
    if verify not in ("files", "content"):
        raise ValueError(f"verify must be 'files' or 'content', not {verify!r}")
    path = f"{root.rstrip('/')}/{key}"
    found = _load(spark, path, verify)
    if found is not None:
        return found, True
    builder = uuid.uuid4().hex
    folder = f"data-{builder}"
    build().write.parquet(f"{path}/{folder}")
    first = _load(spark, path, verify)
    if first is not None:
        return first, False
    written = spark.read.parquet(f"{path}/{folder}")
    entry = (builder, time.time(), folder, *_files(written), *_content(written))
    spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    first = _load(spark, path, verify)
    if first is None:
        raise RuntimeError(f"{path}/{folder} changed while it was written")
    return first, False
