"""Values keyed by a hash, so that they do not depend on row order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNS_PER_DIGEST = 128


def _hex_number(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def normal_draw(seed: int, row_id: Column, dim: Column) -> Column:
    """Standard normal number (Box-Muller) from ``md5('seed:id:dim')``."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string"), dim.cast("string")))
    scale = float(1 << 52)
    u1 = (_hex_number(digest, 1, 13).cast("double") + 0.5) / scale
    u2 = _hex_number(digest, 17, 13).cast("double") / scale
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def sign_words(key: Column, dim: int) -> list[Column]:
    """Random signs of ``key`` as 32-bit words (eight hex digits of md5 each).

    One digest serves 128 dimensions; further ones hash the key with the number
    of the digest appended.
    """
    words = []
    for word in range(math.ceil(dim / 32)):
        digest_no, part = divmod(word, SIGNS_PER_DIGEST // 32)
        text = key if digest_no == 0 else F.concat_ws(":", key, F.lit(str(digest_no)))
        words.append(_hex_number(F.md5(text), 1 + 8 * part, 8))
    return words


def sign_of(word: str, j: int) -> str:
    """SQL text of sign j of the 32-bit word in column ``word``: bit j%4 of its hex
    digit j//4, counted from the left."""
    digit, bit = divmod(j % 32, 4)
    return f"(1 - 2 * (shiftright({word}, {4 * (7 - digit) + bit}) & 1))"


def row_digest(*cols: Column) -> Column:
    """60-bit number of a row that other engines can compute as well.

    Every value stands behind its length, and null is not the empty string, so
    that no two rows are written alike.
    """
    values = [c.cast("string") for c in cols]
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)) for v in values]
    text = F.concat(*parts)
    return _hex_number(F.md5(text), 1, 15)
