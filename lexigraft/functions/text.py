"""String expressions with Unicode-wide whitespace and number classes."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_MARK = "▁"
BPE_MARK = "Ġ"

# White space as Python's str.isspace sees it; the class reads the same in Java and RE2.
SPACE = r"[\t-\r\x1c-\x1f \x85\p{Z}]"

# The ASCII punctuation characters, as ranges.
PUNCTUATION = r"[!-/:-@\[-`{-~]"

# Fixed value: byte-fallback pieces (the class holds a comma, and only the start is tested).
BYTE_PIECE = r"^<0x[0-9,A-F]{2}>"


def ltrim_u(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+", "")


def trim_u(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def split_words(text: Column) -> Column:
    """Words of a text in order, without empty strings."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


@cache
def numeric_class() -> str:
    """Regex class of the characters for which ``str.isnumeric`` holds.

    The number categories miss ideographs with a numeric value; those come from
    the Unicode database.
    """
    extra = "".join(
        chr(cp)
        for cp in range(sys.maxunicode + 1)
        if chr(cp).isnumeric() and not unicodedata.category(chr(cp)).startswith("N")
    )
    return rf"[\p{{N}}{extra}]"


def is_symbol_text(c: Column) -> Column:
    """All numeric, all ASCII punctuation (true for the empty string) or all white space.

    ``$`` would also match before a line end that closes the text.
    """
    return (
        c.rlike(rf"\A{numeric_class()}+\z")
        | c.rlike(rf"\A{PUNCTUATION}*\z")
        | c.rlike(rf"\A{SPACE}+\z")
    )


# Byte-level alphabet: bytes that print as themselves keep their code point, the
# others are numbered from 256 upwards in byte order.
_SELF_PRINTING = [(33, 126), (161, 172), (174, 255)]


@cache
def shifted_bytes() -> tuple[int, ...]:
    """Bytes that do not print as themselves, in byte order."""
    return tuple(b for b in range(256) if not any(lo <= b <= hi for lo, hi in _SELF_PRINTING))


def byte_to_char(byte: Column) -> Column:
    """Alphabet character of a byte value."""
    kept = [byte.between(lo, hi) for lo, hi in _SELF_PRINTING]
    position = F.array_position(F.lit(list(shifted_bytes())), byte.cast("int"))
    code = F.when(kept[0] | kept[1] | kept[2], byte).otherwise(position + 255)
    return _code_point(code)


def _code_point(code: Column) -> Column:
    # chr() wraps at 256, so code points below 2048 are assembled from their UTF-8 bytes.
    code = code.cast("int")
    one = F.lpad(F.hex(code), 2, "0")
    two = F.concat(
        F.hex(F.lit(0xC0).bitwiseOR(F.shiftright(code, 6))),
        F.hex(F.lit(0x80).bitwiseOR(code.bitwiseAND(63))),
    )
    return F.unhex(F.when(code < 128, one).otherwise(two)).cast("string")


def encode_byte_level(c: Column) -> Column:
    """UTF-8 bytes of a text written in the byte-level alphabet."""
    hexed = F.hex(F.encode(c, "utf-8"))
    pairs = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed), F.lit(2)))
    chars = F.transform(
        F.coalesce(pairs, F.array().cast("array<int>")),
        lambda i: byte_to_char(F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("int")),
    )
    return F.array_join(chars, "")


def decode_byte_level(c: Column) -> Column:
    """Text of a byte-level token; bytes that form no character become U+FFFD.

    A token holding a character outside the alphabet is returned as it is.
    """
    shifted = F.lit(list(shifted_bytes()))

    def byte_of(ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 256, code).otherwise(F.get(shifted, code - 256))

    codes = F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), byte_of)
    hexed = F.array_join(F.transform(codes, lambda b: F.lpad(F.hex(b), 2, "0")), "")
    text = F.make_valid_utf8(F.unhex(hexed).cast("string"))
    return F.when(F.exists(codes, lambda b: b.isNull()), c).otherwise(text)
