"""Measures and heuristics on strings. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def shannon_entropy(value: str | Column) -> Column:
    """Bits per code point; 0 for the empty string. Characters are sorted, so each run is one character's count."""
    s = _c(value)
    chars = F.array_sort(F.filter(F.split(s, ""), lambda x: x != ""))
    n = F.length(s).cast("double")
    bits = lambda run: F.when(run > 0, run / n * F.log2(run / n)).otherwise(0.0)
    zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    state = F.aggregate(
        chars,
        zero,
        lambda a, x: F.when(a["last"] == x, F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(x.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + bits(a["run"])).alias("sum"))),
        lambda a: -(a["sum"] + bits(a["run"])),
    )
    return F.when(F.length(s) == 0, 0.0).otherwise(state)


def char_class_count(value: str | Column) -> Column:
    """How many of a-z, A-Z, 0-9 and anything else occur."""
    s = _c(value)
    return sum((s.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))


def mask_preview(value: str | Column, max_keep: int = 4) -> Column:
    """An eighth of the code points, max_keep at most, at each end; eight stars where that is none."""
    s = _c(value)
    keep = F.least(F.lit(max_keep), F.floor(F.length(s) / 8).cast("int"))
    return F.when(keep < 1, F.lit("********")).otherwise(F.concat(F.substring(s, F.lit(1), keep), F.lit("…"), F.substring(s, F.length(s) - keep + 1, keep)))


def clamp01(value: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(value).cast("double")))


def looks_like_code(value: str | Column, following: str | Column, quoted: str | Column | bool = False) -> Column:
    """Whether an unquoted value is an expression or a type name. following: the character after it."""
    s, q = _c(value), F.lit(quoted) if isinstance(quoted, bool) else _c(quoted)
    bare = F.regexp_replace(s, r"[)\]}!]+\z", "")
    access = r"^[A-Za-z_$][A-Za-z0-9_$]*(?:!?\??\.[A-Za-z_$][A-Za-z0-9_$]*|\[[^\]]*\])++\z"
    call = (F.coalesce(_c(following), F.lit("")) == "(") | F.contains(s, F.lit("("))
    return ~q & (call | bare.rlike(access) | bare.rlike(r"^[A-Za-z_$]+\z"))


def looks_like_version(value: str | Column) -> Column:
    return _c(value).rlike(r"^(?:[~^]|[<>]=?|=)?v?[0-9]+(?:\.[0-9]+)++(?:[-+][A-Za-z0-9_.]+)?\z")


def looks_like_path_or_url(value: str | Column) -> Column:
    s = _c(value)
    return s.rlike(r"^(?:\.{0,2}/|~/|[A-Za-z]:\\)") | F.contains(s, F.lit("://"))


def has_letter_and_digit(value: str | Column) -> Column:
    s = _c(value)
    return s.rlike("[A-Za-z]") & s.rlike("[0-9]")


def decode_base64(value: str | Column) -> Column:
    """The bytes as Latin-1 text, of either alphabet, padded or not; null if it is no base64."""
    s = F.translate(F.regexp_replace(_c(value), "[\\t\\n\\f\\r ]", ""), "-_", "+/")
    body = F.regexp_replace(s, "={0,2}\\z", "")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    ok = body.rlike("^[A-Za-z0-9+/]*\\z") & (F.length(body) % 4 != 1)
    return F.when(ok & (F.length(body) == 0), F.lit("")).when(ok, F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1"))


def utf16_length(value: str | Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(_c(value), "UTF-16BE")) / 2).cast("int")
