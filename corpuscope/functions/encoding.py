"""Encoding detection (S-1) and decoding (S-2) on raw bytes, entirely with native functions.

The statistical codec guesser of the reference is replaced by a deterministic ladder:

====================  ================  ==========
bytes                 encoding          confidence
====================  ================  ==========
empty                 null              0.0
EF BB BF ...          UTF-8-SIG         1.0
FF FE / FE FF ...     UTF-16            1.0
valid UTF-8, ASCII    ascii             1.0
valid UTF-8           utf-8             0.99
anything else         ISO-8859-1        0.5
====================  ================  ==========
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: accepted encodings and minimum confidence of the encoding check ---
ACCEPTED_ENCODINGS = ("UTF-8", "UTF8", "ASCII")
MIN_CONFIDENCE = 0.7
# encodings that count as unchanged in the repair step (lower-case)
UNCHANGED_ENCODINGS = ("utf-8", "utf8", "ascii")

BOM_UTF8 = "EFBBBF"


def _starts(content: Column, hex_prefix: str) -> Column:
    n = len(hex_prefix) // 2
    return F.hex(F.substring(content, 1, n)) == F.lit(hex_prefix)


def detect_encoding(content: Column) -> Column:
    """S-1: ``struct(encoding, confidence)`` for a BINARY column."""
    as_str = content.cast("string")
    valid = F.is_valid_utf8(as_str)
    ascii_ = valid & (F.octet_length(content) == F.length(as_str))
    enc = (
        F.when(content.isNull() | (F.octet_length(content) == 0), F.lit(None).cast("string"))
        .when(_starts(content, BOM_UTF8), F.lit("UTF-8-SIG"))
        .when(_starts(content, "FFFE") | _starts(content, "FEFF"), F.lit("UTF-16"))
        .when(ascii_, F.lit("ascii"))
        .when(valid, F.lit("utf-8"))
        .otherwise(F.lit("ISO-8859-1"))
    )
    conf = (
        F.when(content.isNull() | (F.octet_length(content) == 0), F.lit(0.0))
        .when(_starts(content, BOM_UTF8) | _starts(content, "FFFE") | _starts(content, "FEFF") | ascii_, F.lit(1.0))
        .when(valid, F.lit(0.99))
        .otherwise(F.lit(0.5))
    )
    return F.struct(enc.alias("encoding"), conf.alias("confidence"))


def encoding_problem(encoding: Column, confidence: Column, error: Column | None = None,
                     accept=ACCEPTED_ENCODINGS, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """F-1: error, or a known encoding outside ``accept``, or confidence below ``min_confidence``.
    A null encoding is caught by its confidence."""
    bad = (encoding.isNotNull() & ~F.upper(encoding).isin(list(accept))) | (confidence < F.lit(float(min_confidence)))
    if error is not None:
        bad = error.isNotNull() | bad
    return F.coalesce(bad, F.lit(False))


# Well-formed UTF-16 after its BOM: whole 16-bit units, surrogates only as high+low pairs
# (little endian puts the high byte second, big endian first). Checked on the hex text so that
# malformed bytes fall back instead of failing the task (Spark's decode raises on them).
UTF16LE_OK = "^FFFE(?:(?!..D[89A-F])[0-9A-F]{4}|..D[89AB]..D[C-F])*+$"
UTF16BE_OK = "^FEFF(?:(?!D[89A-F])[0-9A-F]{4}|D[89AB]..D[C-F]..)*+$"


def valid_utf16(content: Column) -> Column:
    h = F.hex(content)
    return F.when(_starts(content, "FFFE"), h.rlike(UTF16LE_OK)).when(_starts(content, "FEFF"), h.rlike(UTF16BE_OK)).otherwise(
        F.lit(False)
    )


def decode_bytes(content: Column, encoding: Column) -> Column:
    """S-2: ``struct(text, fallback)`` decoded by the detected label.

    A UTF-8 BOM is removed; UTF-16 uses its BOM; Latin-1 decodes every byte. Bytes that cannot
    be decoded under the label (malformed UTF-16) fall back to UTF-8 with replacement characters
    (``fallback``), as the reference does when decoding with the detected codec fails."""
    as_str = content.cast("string")
    n = F.octet_length(content)
    utf16_ok = (encoding == "UTF-16") & valid_utf16(content)
    text = (
        F.when(encoding == "UTF-8-SIG", F.make_valid_utf8(F.substring(content, 4, (1 << 31) - 1).cast("string")))
        .when(utf16_ok, F.decode(content, "UTF-16"))
        .when(encoding == "ISO-8859-1", F.decode(content, "ISO-8859-1"))
        .when(encoding.isin("ascii", "utf-8"), as_str)
        .when(n == 0, F.lit(""))
        .otherwise(F.make_valid_utf8(as_str))
    )
    fallback = (encoding.isNotNull() & ~encoding.isin("UTF-8-SIG", "UTF-16", "ISO-8859-1", "ascii", "utf-8")) | (
        (encoding == "UTF-16") & ~utf16_ok
    )
    return F.struct(text.alias("text"), fallback.alias("fallback"))
