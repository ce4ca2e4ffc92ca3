"""Check digits and plausible dates, as expressions."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

#: Fixed values of the two national standards and their check characters.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECK = "10X98765432"
ORG_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
ORG_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)


def _weighted(text: Column, alphabet: str, weights: tuple[int, ...]) -> Column:
    return sum((F.greatest(F.instr(F.lit(alphabet), F.substring(text, i + 1, 1)) - 1, F.lit(0)) * w for i, w in enumerate(weights)), F.lit(0))


def luhn_ok(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


def id_ok(value: Column) -> Column:
    compact = F.regexp_replace(value, r"(?U)[\s\x1c-\x1f\-_]", "")
    check = F.substring(F.lit(ID_CHECK), _weighted(compact, "0123456789", ID_WEIGHTS) % 11 + 1, F.lit(1))
    return compact.rlike(r"^[0-9]{17}.$") & (F.upper(F.substring(compact, 18, 1)) == check)


def org_ok(value: Column) -> Column:
    text = F.upper(F.trim(value))
    left = (31 - _weighted(text, ORG_ALPHABET, ORG_WEIGHTS) % 31) % 31
    return text.rlike(rf"^[{ORG_ALPHABET}]{{18}}$") & (F.substring(text, 18, 1) == F.substring(F.lit(ORG_ALPHABET), left + 1, F.lit(1)))


def id_date_plausible(value: Column) -> Column:
    compact = F.regexp_replace(value, r"[^0-9Xx]", "")
    number = lambda a, n: F.substring(compact, a, n).try_cast("int")
    return F.coalesce((F.length(compact) >= 14) & number(7, 4).between(1900, 2100) & number(11, 2).between(1, 12) & number(13, 2).between(1, 31), F.lit(False))
