"""Matches of a pattern with their offsets, inside Catalyst: what splitting by the pattern leaves between matches, and
the matches themselves, add up to the offsets. Nothing here takes more than n log n steps or so in the matches."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake.types import Doc, Span, no_findings


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also inside lambdas, where common subexpressions are not shared."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """join of all values (0 or more) up to each one: sums, or with F.greatest maxima. In blocks of about the root of
    their number, as appending to an array copies it."""

    def simple(a: Column) -> Column:
        grown = F.aggregate(a, F.array(F.lit(0)), lambda s, x: F.array_append(s, join(F.element_at(s, -1), x)))
        return F.slice(grown, 2, F.size(a))

    def blocks(a: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(8))
        return let(F.transform(F.sequence(F.lit(0), F.size(a) - 1, size), lambda i: simple(F.slice(a, i + 1, size))), joined)

    def joined(b: Column) -> Column:
        before = simple(F.transform(b, lambda x: F.element_at(x, -1)))
        shift = lambda t: F.flatten(F.transform(b, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: join(F.get(t, i - 1), v)))))
        return let(before, shift)

    return let(values, lambda a: F.when(F.size(a) > 0, blocks(a)).otherwise(a))


def led(pattern: str, group: int) -> str:
    """The pattern with all that precedes the group as a group of its own, the first one, which tells where the group
    begins. The group must stand outside of other groups and of alternatives, and must not be repeated."""
    problem = ValueError(f"group {group} of {pattern!r} must stand once, outside of other groups and alternatives")
    flags = re.match(r"\(\?[a-zA-Z]+\)", pattern)
    head = flags.end() if flags else 0
    i, depth, count, found, close = head, 0, 0, None, None
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2].isdigit():
                raise problem  # the numbers of groups change
            if pattern[i + 1 : i + 2] == "Q":
                end = pattern.find("\\E", i)
                i = len(pattern) if end < 0 else end + 2
                continue
            i += 2
            continue
        if c == "[":
            inner, i = 1, i + 1
            if pattern[i : i + 1] == "^":
                i += 1
            if pattern[i : i + 1] == "]":
                i += 1
            while i < len(pattern) and inner:
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    inner += 1
                elif pattern[i] == "]":
                    inner -= 1
                i += 1
            continue
        if c == "(":
            named = re.match(r"\(\?<[A-Za-z]", pattern[i:])
            if pattern[i + 1 : i + 2] != "?" or named:
                count += 1
                if count == group:
                    if depth:
                        raise problem
                    found = i
            elif re.match(r"\(\?[a-zA-Z-]+\)", pattern[i:]):
                raise problem  # would end with the new group
            depth += 1
        elif c == ")":
            depth -= 1
            if found is not None and close is None and not depth:
                close = i
        elif c == "|" and not depth:
            raise problem
        i += 1
    if found is None or pattern[close + 1 : close + 2] in ("*", "+", "?", "{"):
        raise problem
    return f"{pattern[:head]}({pattern[head:found]}){pattern[found:]}"


def found(doc: Doc, pattern: str | Column, emit: Callable[[Span], Column], group: Column | None = None, when: Column | None = None) -> Column:
    """array of emit(span) for all matches from left to right, nulls left out. A match that emit turns down still takes
    its text; matches of the empty string are stepped over. group: the span is that group of a pattern made by `led`,
    or the whole match where it is 0. when: false skips the pattern."""
    none, text = no_findings(), doc.text
    p = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(whole: Column) -> Column:
        def ends(gaps: Column) -> Column:
            # An empty match at the very beginning leaves no gap before it.
            sizes = F.transform(gaps, F.length)
            sizes = F.when(F.size(gaps) > F.size(whole), sizes).otherwise(F.concat(F.array(F.lit(0)), sizes))
            return running(F.zip_with(F.slice(sizes, 1, F.size(whole)), whole, lambda g, m: g + F.length(m)))

        end = let(F.split(text, p, -1), ends)
        if group is None:
            spans = F.zip_with(whole, end, lambda m, e: F.when(F.length(m) > 0, emit(Span(m, e - F.length(m), doc))))
        else:
            lead, part = (F.regexp_extract_all(text, p, F.when(group > 0, g).otherwise(0)) for g in (F.lit(1), group))
            rows = F.arrays_zip(whole.alias("m"), lead.alias("l"), part.alias("p"), end.alias("e"))
            start = lambda r: r["e"] - F.length(r["m"]) + F.when(group > 0, F.length(r["l"])).otherwise(0)
            spans = F.transform(rows, lambda r: F.when(F.length(r["p"]) > 0, let(start(r), lambda s: emit(Span(r["p"], s, doc)))))
        return F.filter(spans, lambda f: f.isNotNull())

    matched = let(F.regexp_extract_all(text, p, F.lit(0)), lambda w: F.when(F.size(w) > 0, placed(w)).otherwise(none))
    return matched if when is None else F.when(when, matched).otherwise(none)
