"""Salts that spread the rows of a hot join key over several tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salt_of(cols: list[str], salts: int) -> Column:
    """Salt of a row on the many-row side, from columns that tell its rows apart."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts).cast("bigint"))


def every_salt(salts: int) -> Column:
    """One copy per salt, for the side with one row per key."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
