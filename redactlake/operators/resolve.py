"""Overlap resolution and redaction, as folds over a row's array of findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake.operators.spans import let, running
from redactlake.types import PIECE, cut, in_pieces, severity_rank

#: (finding, original text of its span) -> replacement.
Masker = Callable[[Column, Column], Column]


def _ordered(findings: Column, keys: Callable[[Column, Column], list[Column]]) -> Column:
    """Stable sort: keys, then the place in the array."""
    keyed = F.transform(findings, lambda f, i: F.struct(*[k.alias(f"k{n}") for n, k in enumerate(keys(f, i))], i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda x: x["f"])


def by_start(findings: Column) -> Column:
    return _ordered(findings, lambda f, i: [f["start"]])


def _greedy(findings: Column) -> Column:
    ranked = _ordered(findings, lambda f, i: [-severity_rank(f["severity"]), -f["confidence"], f["start"] - f["end"], f["start"]])
    kept = F.aggregate(
        ranked,
        F.slice(findings, F.lit(1), F.lit(0)),
        lambda a, f: F.when(F.exists(a, lambda k: (f["start"] < k["end"]) & (k["start"] < f["end"])), a).otherwise(F.array_append(a, f)),
    )
    return _ordered(kept, lambda f, i: [f["start"], -f["end"]])


def dedupe(findings: Column) -> Column:
    """Greedy choice: the strongest (severity, confidence, length) first, then whatever overlaps none chosen; spans
    that touch do not overlap. Of equals the one that starts first, then the earlier one, is stronger. Sorted by start.

    Sorted by start, findings fall into clusters that do not overlap; the choice is made in each cluster of several.
    """

    def clustered(s: Column) -> Column:
        return let(running(F.transform(s, lambda f: f["end"]), F.greatest), lambda reach: let(heads(s, reach), lambda h: chosen(s, h)))

    def heads(s: Column, reach: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["start"] >= F.get(reach, i - 2)))

    def chosen(s: Column, h: Column) -> Column:
        def one(first: Column, k: Column) -> Column:
            size = F.coalesce(F.get(h, k + 1), F.size(s) + 1) - first
            return let(F.slice(s, first, size), lambda own: F.when(F.size(own) > 1, _greedy(own)).otherwise(own))

        return F.flatten(F.transform(h, one))

    placed = _ordered(findings, lambda f, i: [f["start"], -f["end"]])
    return F.when(F.size(findings) > 1, let(placed, clustered)).otherwise(findings)


class masks:
    """Built-in maskers."""

    @staticmethod
    def label(finding: Column, original: Column) -> Column:
        return F.concat(F.lit("[REDACTED:"), finding["ruleId"], F.lit("]"))

    @staticmethod
    def plain(finding: Column, original: Column) -> Column:
        return F.lit("[REDACTED]")

    @staticmethod
    def char(ch: str = "*") -> Masker:
        """As many ch as code points."""
        return lambda finding, original: F.repeat(F.lit(ch), F.length(original))

    @staticmethod
    def partial(head: int = 4, tail: int = 4, ch: str = "*") -> Masker:
        """The first head and the last tail code points stay; of no more than these none does."""

        def mask(finding: Column, original: Column) -> Column:
            n = F.length(original)
            part = F.concat(F.substring(original, F.lit(1), F.lit(head)), F.repeat(F.lit(ch), n - head - tail), F.substring(original, n - tail + 1, F.lit(tail)))
            return F.when(n <= head + tail, F.repeat(F.lit(ch), n)).otherwise(part)

        return mask


def astral(text: Column) -> Column:
    """Whether UTF-16 offsets can differ from code points."""
    return (F.octet_length(text) > F.length(text)) & text.rlike("[\\x{10000}-\\x{10FFFF}]")


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def to_utf16(pieces: Column) -> Callable[[Column, Column], Column]:
    """(UTF-16 units up to the end of each piece, offset in code points) -> offset in UTF-16 units."""

    def at(units: Column, offset: Column) -> Column:
        k = F.floor(offset / PIECE).cast("int")
        inside = utf16_units(F.substring(F.coalesce(F.get(pieces, k), F.lit("")), F.lit(1), offset - k * PIECE))
        return F.coalesce(F.get(units, k - 1), F.lit(0)) + inside

    return at


class Units:
    """A text addressed by UTF-16 units: behind each character of two units stands a filler, so that units are counted
    as code points. pieces and wide are bound columns."""

    FILLER = "\uffff"

    def __init__(self, pieces: Column, wide: Column):
        self.pieces, self.wide = pieces, wide

    @staticmethod
    def of(text: Column) -> Column:
        """struct (pieces, wide, size)."""
        filled = F.regexp_replace(text, F.lit("[\\x{10000}-\\x{10FFFF}]"), F.lit("$0" + Units.FILLER))
        units = F.when(astral(text), filled).otherwise(text)
        return let(units, lambda u: F.struct(in_pieces(u).alias("pieces"), (F.length(u) > F.length(text)).alias("wide"), F.length(u).alias("size")))

    def cut(self, start: Column, end: Column) -> Column:
        part = cut(self.pieces, start, end - start)
        return F.when(self.wide, F.regexp_replace(part, F.lit(f"([\\x{{10000}}-\\x{{10FFFF}}]){self.FILLER}"), F.lit("$1"))).otherwise(part)


def redacted(text: Column, findings: Column, mask: Masker = masks.label, resolved: bool = False) -> Column:
    """The text with each finding's span replaced. findings (UTF-16 offsets) are deduplicated first, but where they
    are resolved already. Spans that begin before the text, or before the end of an earlier one, are left out."""

    def masked(u: Column, spans: Column) -> Column:
        units = Units(u["pieces"], u["wide"])

        def piece(f: Column, i: Column) -> Column:
            last = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
            return F.concat(units.cut(last, f["start"]), mask(f, units.cut(f["start"], f["end"])))

        rest = units.cut(F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)), u["size"])
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    def fitting(s: Column) -> Column:
        # Only spans of no length can begin inside another one here.
        cursor = running(F.transform(s, lambda f: f["end"]), F.greatest)
        return let(cursor, lambda c: F.filter(s, lambda f, i: f["start"] >= F.coalesce(F.get(c, i - 1), F.lit(0))))

    spans = findings if resolved else let(dedupe(findings), fitting)
    return F.when(F.size(findings) > 0, let(Units.of(text), lambda u: let(spans, lambda s: masked(u, s)))).otherwise(text)
