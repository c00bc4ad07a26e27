"""Keyword lists matched over normalised text, in an Arrow UDF whose automaton is built once per worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake.operators.ahocorasick import AhoCorasick
from redactlake.operators.normalize import DEFAULT_IGNORE, Normalizer
from redactlake.types import RAW_TYPE, SEVERITY_RANK, Doc, no_findings

_ASCII_WORD = re.compile(r"[a-z0-9]+\Z")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class KeywordList:
    label: str
    words: tuple[str, ...]
    severity: str | None = None


class Matcher:
    """Lists and exceptions compiled."""

    def __init__(self, lists: list[tuple[str, tuple[str, ...], str]], exceptions: tuple[str, ...], word_boundary: bool, normalizer: Normalizer):
        self.normalizer, self.word_boundary = normalizer, word_boundary
        meta: dict[tuple[str, str], str] = {}
        for label, words, severity in lists:
            for w in words:
                if n := normalizer.text(w):
                    meta.setdefault((label, n), severity)
        self.labels, self.severities = [label for label, _ in meta], list(meta.values())
        self.bounded = np.array([bool(_ASCII_WORD.match(n)) for _, n in meta], bool)
        self.words = AhoCorasick([n for _, n in meta])
        self.exceptions = AhoCorasick([n for n in map(normalizer.text, exceptions) if n])

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(word, start, end) of each hit, by end."""
        folded, origin = self.normalizer.folded(text)
        hits = self.words.spans(folded)
        if not hits:
            return []
        # An exception covers a hit if, of those that begin no later, one ends no earlier.
        begins, reach = self._covers(folded)
        out = []
        for p, s, e in hits:
            if len(begins) and (k := int(np.searchsorted(begins, s, "right"))) and reach[k - 1] >= e:
                continue
            start, end = int(origin[s]), int(origin[e - 1]) + 1
            if self.word_boundary and self.bounded[p] and (text[max(start - 1, 0) : start] in _ALNUM or text[end : end + 1] in _ALNUM):
                continue
            out.append((p, start, end))
        return out

    def _covers(self, folded: str) -> tuple[np.ndarray, np.ndarray]:
        found = sorted((s, e) for _, s, e in self.exceptions.spans(folded))
        both = np.array(found, "i8").reshape(-1, 2)
        return both[:, 0], np.maximum.accumulate(both[:, 1])

    def array(self, texts: list[str | None]) -> pa.Array:
        """The findings of each text as an Arrow array of RAW_TYPE."""
        found = [self.find(t) if t else [] for t in texts]
        flat = np.array([h for hits in found for h in hits], "i8").reshape(-1, 3)
        of = pa.array(flat[:, 0])
        n = len(flat)
        each = lambda v: pa.array(v, pa.string()).take(of)
        columns = {
            "ruleId": each([f"keyword.{x}" for x in self.labels]),
            "category": pa.array(["keyword"] * n, pa.string()),
            "severity": each(self.severities),
            "confidence": pa.array(np.full(n, 0.9)),
            "start": pa.array(flat[:, 1].astype("i4")),
            "end": pa.array(flat[:, 2].astype("i4")),
            "preview": pa.nulls(n, pa.string()),
            "description": each([f'Matched keyword list "{x}"' for x in self.labels]),
            "tag": each(self.labels),
            "match": pa.array([t[s:e] for t, hits in zip(texts, found, strict=True) for _, s, e in hits], pa.string()),
        }
        ends = np.cumsum([0, *map(len, found)]).astype("i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


@dataclass(frozen=True)
class Keywords:
    lists: tuple[KeywordList, ...] = ()
    severity: str = "medium"
    exceptions: tuple[str, ...] = ()
    ascii_word_boundary: bool = True
    normalizer: Normalizer = field(default_factory=Normalizer)
    id: str = "keywords"
    is_async: bool = False

    def rule_ids(self) -> list[str]:
        return list(dict.fromkeys(f"keyword.{x.label}" for x in self.lists))

    def best(self, rule_id: str) -> tuple[str, float]:
        return max((x.severity or self.severity for x in self.lists if f"keyword.{x.label}" == rule_id), key=SEVERITY_RANK.get), 0.9

    def matcher(self, only: Iterable[str] | None = None) -> Matcher:
        chosen = [(x.label, tuple(x.words), x.severity or self.severity) for x in self.lists if only is None or f"keyword.{x.label}" in only]
        return Matcher(chosen, self.exceptions, self.ascii_word_boundary, self.normalizer)

    def detect(self, doc: Doc, only: Iterable[str] | None = None) -> Column:
        if not any(x.words for x in self.lists):
            return no_findings()
        keep, make = None if only is None else frozenset(only), self.matcher

        @F.arrow_udf(RAW_TYPE)
        def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            m = make(keep)
            for texts in batches:
                yield m.array(texts.to_pylist())

        return scan(doc.text)


def keywords(words: Iterable[str] = (), lists: Iterable[KeywordList] = (), id: str = "keywords", severity: str | None = None, exceptions: Iterable[str] = (), ascii_word_boundary: bool = True, nfkc: bool = True, lowercase: bool = True, ignore: frozenset[str] | re.Pattern | Callable[[str], bool] | None = DEFAULT_IGNORE, char_map: dict[str, str] | None = None) -> Keywords:
    """lists come first; flat words are a list labelled with the detector's id."""
    own, flat = list(lists), tuple(words)
    if flat:
        own.append(KeywordList(id, flat, severity))
    return Keywords(tuple(own), severity or "medium", tuple(exceptions), ascii_word_boundary, Normalizer(nfkc, lowercase, ignore, char_map or {}), id)
