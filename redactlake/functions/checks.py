"""Checksums of identity, card and company numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of GB 11643 (identity numbers), GB 32100 (company codes) and of the card networks.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECK = "10X98765432"
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
CARD_PREFIXES = r"^(?:62|81|4|5[1-5]|2(?:2[2-9]|[3-6][0-9]|7[01]|720)|3[47]|35|6011|65)"


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _weighted(s: Column, weights: tuple[int, ...], value) -> Column:
    """Sum of value(character) times its weight."""
    terms = F.zip_with(F.split(F.substring(s, 1, len(weights)), ""), F.array(*map(F.lit, weights)), lambda c, w: F.coalesce(value(c) * w, F.lit(0)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _digit(c: Column) -> Column:
    return F.ascii(c) - 48


def is_valid_cn_id(value: str | Column, as_of: Column | None = None) -> Column:
    """18 characters with a real birth date from 1900 to as_of (now) and the right check character."""
    s = _c(value)
    now = as_of if as_of is not None else F.current_timestamp()
    born = F.try_to_date(F.substring(s, 7, 8), "yyyyMMdd")
    total = _weighted(s, ID_WEIGHTS, _digit)
    check = F.substring(F.lit(ID_CHECK), F.pmod(total, F.lit(11)) + 1, F.lit(1))
    good = born.isNotNull() & (F.substring(s, 7, 4) >= "1900") & (born.cast("timestamp") <= now) & (check == F.upper(F.substring(s, 18, 1)))
    return F.when(s.isNull(), F.lit(None).cast("boolean")).when(s.rlike(r"^[0-9]{17}[0-9Xx]\z"), F.coalesce(good, F.lit(False))).otherwise(False)


def luhn(value: str | Column) -> Column:
    """Digits only, the doubled sum divisible by 10. The empty string passes."""
    s = _c(value)
    digits = F.filter(F.split(F.reverse(s), ""), lambda x: x != "")
    total = F.aggregate(
        F.transform(digits, lambda x, i: F.when(i % 2 == 0, F.ascii(x) - 48).otherwise((F.ascii(x) - 48) * 2 - F.when(x > "4", 9).otherwise(0))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.when(s.isNull(), F.lit(None).cast("boolean")).when(s.rlike(r"^[0-9]*\z"), total % 10 == 0).otherwise(False)


def has_known_bin(value: str | Column) -> Column:
    return _c(value).rlike(CARD_PREFIXES)


def is_valid_uscc(value: str | Column) -> Column:
    s = _c(value)
    letters = "[0-9A-HJ-NPQRTUWXY]"
    total = _weighted(s, USCC_WEIGHTS, lambda c: F.instr(F.lit(USCC_ALPHABET), c) - 1)
    check = F.substring(F.lit(USCC_ALPHABET), F.pmod(31 - F.pmod(total, F.lit(31)), F.lit(31)) + 1, F.lit(1))
    return F.when(s.isNull(), F.lit(None).cast("boolean")).when(s.rlike(f"^{letters}{{2}}[0-9]{{6}}{letters}{{10}}\\z"), check == F.substring(s, 18, 1)).otherwise(False)
