"""Order-free sums.

A floating sum depends on the order in which shuffled rows arrive. Values are
therefore turned into whole multiples of a small step and summed as integers,
which gives the same bits under every partitioning and keeps partial
aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_BITS = 30


def to_steps(x: Column, bits: int = STEP_BITS) -> Column:
    # Rounds half away from zero like round(), which would go through decimals.
    scaled = x.cast("double") * F.lit(2.0**bits)
    return (F.signum(scaled) * F.floor(F.abs(scaled) + F.lit(0.5))).cast("bigint")
