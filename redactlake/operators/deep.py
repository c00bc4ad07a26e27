"""Detectors that run Python: the hook for callables, and a second, deeper pass of a few rules of its own.

The rule corpus of third-party scanners is not reproduced; `deep()` has the interface, the rule ids and spans that end
before text of other scripts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake.types import RAW_TYPE, Doc

_FIELDS = {"ruleId": None, "category": "custom", "severity": "medium", "confidence": 0.8, "start": None, "end": None, "preview": None, "description": None, "tag": None, "match": None}


@dataclass(frozen=True)
class CallableDetector:
    """function: a text to findings as dicts (ruleId, start, end in code points; the rest has defaults).

    is_async: slow or remote; left out of scan_sync, redact_sync and has_sensitive_sync.
    """

    id: str
    function: Callable[[str], Iterable[dict]]
    is_async: bool = False

    def rule_ids(self) -> None:
        return None  # known when it runs

    def best(self, rule_id: str) -> tuple[str, float]:
        return "critical", 1.0

    def detect(self, doc: Doc, only: Iterable[str] | None = None) -> Column:
        function = self.function

        @F.pandas_udf(RAW_TYPE)
        def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series([[{k: f.get(k, v) for k, v in _FIELDS.items()} | {"confidence": float(f.get("confidence", 0.8))} for f in function(t)] if t else [] for t in s], dtype=object)

        return scan(doc.text)


#: Message id and pattern; whole connection strings, and tokens, in ASCII only.
DEEP_RULES = (
    ("GITHUB_TOKEN", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{82})(?![A-Za-z0-9_])"),
    ("DATABASE_CONNECTION", r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?)://[!-~]{1,100}?:[!-?A-~]{1,200}@[!-~]{1,300}"),
)


def _deep(text: str) -> list[dict]:
    out = []
    for name, pattern in DEEP_RULES:
        for m in re.finditer(pattern, text, re.ASCII):
            end = m.end() - len(m[0]) + len(m[0].rstrip(".,;:!?)]}'\""))
            out.append({"ruleId": f"deep.{name}", "category": "secret", "severity": "high", "confidence": 0.85, "start": m.start(), "end": end, "description": name})
    return out


def deep() -> CallableDetector:
    """Asynchronous second pass; weaker than the built-in rules, which win where they overlap."""
    return CallableDetector("deep", _deep, True)
