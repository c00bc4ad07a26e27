"""Findings: their schema and the order of severities."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}

#: A finding before the scanner completes it; offsets in code points. match: the text found, where the detector has it.
RAW = "ruleId string, category string, severity string, confidence double, start int, end int, preview string, description string, tag string, match string"
RAW_TYPE = f"array<struct<{RAW.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>"

#: A finding; start and end in UTF-16 code units. `match` follows only where it is asked for.
FINDING_FIELDS = ["ruleId", "detector", "category", "severity", "confidence", "start", "end", "preview", "description", "tag"]


def severity_rank(severity: str | Column) -> Column:
    """1 (low) to 4 (critical); null for anything else."""
    c = F.col(severity) if isinstance(severity, str) else severity
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


#: Code points in a piece of a text.
PIECE = 512


def in_pieces(text: Column) -> Column:
    """The text as an array of PIECE code points each, so that a place far inside is reached without counting up to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, size: Column | int) -> Column:
    """size code points from start on; fewer at the text's end, none where size is negative."""
    n = F.greatest(F.lit(size) if isinstance(size, int) else size, F.lit(0))
    inside = F.pmod(start, F.lit(PIECE)).cast("int")
    first = F.shiftright(start.cast("int"), PIECE.bit_length() - 1)
    held = F.slice(pieces, first + 1, F.shiftright((inside + n - 1).cast("int"), PIECE.bit_length() - 1) + 1)
    return F.substring(F.array_join(held, ""), inside + 1, n)


#: Characters that few texts hold: needles with one are looked for only where it is.
MARKS = ("_", "-", ":", "/")


def held_of(lower: Column, needles: Iterable[str]) -> Column:
    """The needles in the text (others: null), as an expression without lambdas, which would not be compiled."""
    groups: dict[str | None, list[str]] = {}
    for n in sorted(set(needles)):
        groups.setdefault(next((m for m in MARKS if m in n), None), []).append(n)
    empty = F.array().cast("array<string>")
    out = [empty]
    for mark, words in groups.items():
        found = F.array(*(F.when(F.contains(lower, F.lit(w)), F.lit(w)) for w in words))
        out.append(found if mark is None else F.when(F.contains(lower, F.lit(mark)), found).otherwise(empty))
    return F.concat(*out)


@dataclass(frozen=True)
class Doc:
    """Columns of a text that detectors share."""

    text: Column
    lower: Column
    pieces: Column
    needles: Column  # of what detectors ask for by `needles()`, what the lower-cased text holds, and nulls

    def cut(self, start: Column, size: Column | int) -> Column:
        return cut(self.pieces, start, size)


@dataclass(frozen=True)
class Span:
    """Columns that a check sees of a candidate, all evaluated only for candidates."""

    match: Column
    start: Column  # code points before it
    doc: Doc

    @property
    def text(self) -> Column:
        return self.doc.text

    @property
    def end(self) -> Column:
        return self.start + F.length(self.match)

    def before(self, size: int) -> Column:
        """The size code points before it, fewer at the text's beginning."""
        return self.doc.cut(F.greatest(self.start - size, F.lit(0)), F.least(self.start, F.lit(size)))

    def after(self, size: int) -> Column:
        return self.doc.cut(self.end, size)


def raw_finding(rule_id: str | Column, category: str, severity: str | Column, confidence: float | Column, span: Span, description: str | Column | None, tag: str | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        lit(rule_id).alias("ruleId"),
        F.lit(category).alias("category"),
        lit(severity).alias("severity"),
        lit(confidence).cast("double").alias("confidence"),
        span.start.cast("int").alias("start"),
        span.end.cast("int").alias("end"),
        F.lit(None).cast("string").alias("preview"),
        lit(description).cast("string").alias("description"),
        F.lit(tag).cast("string").alias("tag"),
        span.match.alias("match"),
    )


def no_findings() -> Column:
    return F.from_json(F.lit("[]"), RAW_TYPE)
