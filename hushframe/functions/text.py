"""Scalar text functions: folding, normal forms, names, token-like strings, log redaction, canonical forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column

_WIDE = "".join(chr(c) for a, b in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(a, b + 1))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
#: White space as it is understood throughout: Unicode's, and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def fold_fullwidth(text: Column) -> Column:
    """Full-width digits and Latin letters as ASCII, one for one. Only texts that hold any are translated."""
    return F.when(text.rlike("[０-９Ａ-Ｚａ-ｚ]"), F.translate(text, _WIDE, _NARROW)).otherwise(text)


def _normal(form: str):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return run


def nfc_newlines(text: Column) -> Column:
    """NFC with CRLF and CR as LF. Python only sees text beyond ASCII."""
    nfc = F.when(text.rlike(r"[^\x00-\x7f]"), _normal("NFC")(text)).otherwise(text)
    return F.regexp_replace(nfc, "\r\n?", "\n")


def nfkc(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7f]"), _normal("NFKC")(text)).otherwise(text)


def nfkc_each(values: Column) -> Column:
    """NFKC of each string of an array; Python only gets arrays that hold more than ASCII."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda row: [None if x is None else unicodedata.normalize("NFKC", x) for x in row], na_action="ignore")

    wide = F.exists(values, lambda x: x.rlike(r"[^\x00-\x7f]"))
    # marked so that plans keep it where it stands and run it once
    return F.coalesce(run.asNondeterministic()(F.when(wide, values)), values)


def safe_filename(name: Column) -> Column:
    """The last part of a path of either kind, without NUL, at most 128 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.translate(name, "\\", "/"), "^.*/", ""), "\x00", ""), F.lit(128))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


#: Fixed formats: the token grammar, what looks like a token, and what logs must not show.
TOKEN_PREFIX, TOKEN_ALPHABET, TOKEN_LENGTH = "PGW_V1", "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 12
TOKEN = rf"\[\[{TOKEN_PREFIX}_[A-Z_]{{1,32}}_[{TOKEN_ALPHABET}]{{{TOKEN_LENGTH}}}\]\]"
TOKEN_LIKE = r"\[\[(\s*PGW[_A-Za-z0-9]*\s*|[A-Z_]+_[A-Z0-9]{8,})\]\]"
LOG_SECRETS = (r"(?i)\b(authorization|api[-_]?key|bearer)\b\s*[:=]\s*\S+", r"\b[0-9]{12,19}\b", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\[\[PGW_V1_[A-Z_]+_[A-Z0-9]+\]\]")


def escape_token_like(text: Column) -> Column:
    """Double brackets around what looks like a token become parentheses; lengths stay."""
    return F.regexp_replace(text, TOKEN_LIKE, "(($1))")


def count_token_like(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_LIKE))


def redact_log(message: Column) -> Column:
    for pattern in LOG_SECRETS:
        message = F.regexp_replace(message, pattern, "[REDACTED]")
    return message


def keyed_token(entity_type: Column, number_hex: Column) -> Column:
    """The token whose suffix spells the first 60 bits of a hex digest."""
    number = F.conv(F.left(number_hex, F.lit(15)), 16, 10).cast("long")
    digit = lambda i: F.substring(F.lit(TOKEN_ALPHABET), (F.shiftrightunsigned(number, 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    return F.concat(F.lit(f"[[{TOKEN_PREFIX}_"), entity_type, F.lit("_"), *(digit(i) for i in reversed(range(TOKEN_LENGTH))), F.lit("]]"))


def canonical(value: Column, entity_type: Column) -> Column:
    """What counts as the same value: NFKC, stripped, no space between CJK characters; then by type."""
    return canonical_of_normal(nfkc(value), entity_type)


def canonical_of_normal(value: Column, entity_type: Column) -> Column:
    """The same for a value in NFKC."""
    cjk = "㐀-鿿豈-﫿"
    text = F.regexp_replace(strip(value), rf"(?U)(?<=[{cjk}]){SPACE}+(?=[{cjk}])", "")
    return (
        F.when(entity_type.isin("PHONE", "BANK_CARD", "ID_CARD"), F.upper(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f\-‐-―().]", "")))
        .when(entity_type == "EMAIL", F.lower(text))
        .when(entity_type == "VEHICLE_PLATE", F.upper(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f·\-]", "")))
        .otherwise(F.regexp_replace(text, rf"(?U){SPACE}+", " "))
    )
