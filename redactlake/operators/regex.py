"""Detector of user-supplied patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake.operators.spans import found
from redactlake.types import SEVERITY_RANK, Doc, Span, no_findings, raw_finding


@dataclass(frozen=True)
class RegexRule:
    """pattern: in Java's dialect. id is reported as it is. validate: a span to a boolean Column; false drops it."""

    id: str
    pattern: str
    category: str = "custom"
    severity: str = "medium"
    confidence: float = 0.8
    description: str | None = None
    validate: Callable[[Span], Column] | None = None

    def __post_init__(self):
        if self.severity not in SEVERITY_RANK:
            raise ValueError(f"unknown severity: {self.severity}")


@dataclass(frozen=True)
class RegexDetector:
    id: str
    rules: tuple[RegexRule, ...]
    is_async: bool = False

    def rule_ids(self) -> list[str]:
        return [r.id for r in self.rules]

    def best(self, rule_id: str) -> tuple[str, float]:
        own = [r for r in self.rules if r.id == rule_id]
        return max((r.severity for r in own), key=SEVERITY_RANK.get), max(r.confidence for r in own)

    def detect(self, doc: Doc, only: Iterable[str] | None = None) -> Column:
        out = []
        for rule in self.rules:
            if not rule.pattern or (only is not None and rule.id not in only):
                continue

            def emit(s: Span, rule=rule) -> Column:
                finding = raw_finding(rule.id, rule.category, rule.severity, rule.confidence, s, rule.description)
                return F.when(rule.validate(s), finding) if rule.validate else finding

            out.append(found(doc, rule.pattern, emit))
        return F.concat(*out) if out else no_findings()


def regex_detector(id: str, rules: Iterable[RegexRule]) -> RegexDetector:
    """Matches of the empty string are stepped over, as they hold nothing."""
    return RegexDetector(id, tuple(rules))
