"""From options to one plan: which rules run, and the Columns that a scan adds. No operation shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.functions.text import mask_preview
from redactlake.operators.pii import pii
from redactlake.operators.resolve import Masker, Units, astral, by_start, dedupe, masks, redacted, to_utf16, utf16_units
from redactlake.operators.secrets import secrets
from redactlake.operators.spans import let, running
from redactlake.types import FINDING_FIELDS, SEVERITY_RANK, Doc, held_of, in_pieces, no_findings, severity_rank


@dataclass(frozen=True)
class Pattern:
    """An allowlist entry that is searched for in the matched text."""

    regex: str


def disabled(rule_id: str, entries: Iterable[str]) -> bool:
    return any(rule_id.startswith(e[:-1]) if e.endswith("*") else rule_id == e for e in entries)


def _is_disabled(rule_id: Column, entries: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in entries:
        out |= F.startswith(rule_id, F.lit(e[:-1])) if e.endswith("*") else rule_id == e
    return out


def _tagged(found: Column, detector: str) -> Column:
    return F.transform(found, lambda f: F.struct(f["ruleId"].alias("ruleId"), F.lit(detector).alias("detector"), *[f[k].alias(k) for k in [*FINDING_FIELDS[2:], "match"]]))


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names of columns that a plan adds and drops again, none of them the DataFrame's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        made = f"_{name}"
        while made in taken:
            made = f"_{made}"
        taken.add(made)
        out.append(made)
    return out


class Scanner:
    """Compiled options. Every method takes a DataFrame and its text column; null texts have no findings."""

    def __init__(self, detectors: Iterable | None = None, min_severity: str = "low", min_confidence: float = 0.0, allowlist: Iterable[str | Pattern] = (), disable_rules: Iterable[str] = (), dedupe: bool = True, include_match: bool = False):
        self.detectors = [secrets(), pii()] if detectors is None else list(detectors)
        if min_severity not in SEVERITY_RANK:
            raise ValueError(f"unknown severity: {min_severity}")
        self.min_severity, self.min_confidence = min_severity, min_confidence
        allow = list(allowlist)
        self.allow_texts = [a for a in allow if isinstance(a, str)]
        self.allow_patterns = [a.regex for a in allow if isinstance(a, Pattern)]
        self.disable_rules, self.dedupe, self.include_match = tuple(disable_rules), dedupe, include_match

    def _runs(self, detector, severity: str) -> list[str] | None:
        """The detector's rules that can still report something; None: not known before it runs."""
        ids = detector.rule_ids()
        if ids is None:
            return None
        least = SEVERITY_RANK[severity]
        best = {i: detector.best(i) for i in ids if not disabled(i, self.disable_rules)}
        return [i for i, (s, c) in best.items() if SEVERITY_RANK[s] >= least and c >= self.min_confidence]

    def _raw(self, doc: Doc, everything: bool, severity: str) -> list[Column]:
        """One array per detector, each finding with the detector's id."""
        out = []
        for d in self.detectors:
            if d.is_async and not everything:
                continue
            rules = self._runs(d, severity)
            if rules is not None and not rules:
                continue
            out.append(_tagged(d.detect(doc, rules), d.id))
        return out

    def _kept(self, doc: Doc, raw: Column, severity: str) -> Column:
        """Range guard, thresholds, switches and allowlist, on offsets in code points; adds the matched text."""

        def keep(f: Column, n: Column) -> Column:
            ok = (f["start"] >= 0) & (f["end"] <= n) & (f["end"] > f["start"])
            ok &= (severity_rank(f["severity"]) >= SEVERITY_RANK[severity]) & (f["confidence"] >= self.min_confidence)
            return ok & ~_is_disabled(f["ruleId"], self.disable_rules) if self.disable_rules else ok

        within = let(F.length(doc.text), lambda n: F.filter(raw, lambda f: keep(f, n)))
        matched = F.transform(within, lambda f: F.struct(*[f[k].alias(k) for k in FINDING_FIELDS], F.coalesce(f["match"], doc.cut(f["start"], f["end"] - f["start"])).alias("match")))
        if self.allow_texts or self.allow_patterns:

            def wanted(f: Column) -> Column:
                ok = ~f["match"].isin(*self.allow_texts) if self.allow_texts else F.lit(True)
                for p in self.allow_patterns:
                    ok &= ~f["match"].rlike(p)
                return ok

            matched = F.filter(matched, wanted)
        return matched

    def _done(self, doc: Doc, kept: Column) -> Column:
        """Findings as they are reported: offsets in UTF-16 units, previews."""

        def done(at: Callable[[Column], Column]) -> Column:
            def one(f: Column) -> Column:
                fields = {k: f[k] for k in FINDING_FIELDS} | {"start": at(f["start"]), "end": at(f["end"]), "preview": F.coalesce(f["preview"], mask_preview(f["match"]))}
                if self.include_match:
                    fields["match"] = f["match"]
                return F.struct(*[v.alias(k) for k, v in fields.items()])

            return F.transform(kept, one)

        units, convert = running(F.transform(doc.pieces, utf16_units)), to_utf16(doc.pieces)
        return F.when((F.size(kept) > 0) & astral(doc.text), let(units, lambda u: done(lambda o: convert(u, o)))).otherwise(done(lambda o: o))

    def _with_doc(self, df: DataFrame, text: str) -> tuple[DataFrame, Doc, list[str]]:
        names = own_names(df, "text", "lower", "pieces", "needles")
        source, lower, parts, needles = names
        wanted = [n for d in self.detectors if hasattr(d, "needles") for n in d.needles()]
        out = df.withColumn(source, F.coalesce(F.col(text), F.lit("")))
        out = out.withColumns({lower: F.lower(F.col(source)), parts: in_pieces(F.col(source))})
        out = out.withColumn(needles, held_of(F.col(lower), wanted))
        return out, Doc(*map(F.col, names)), names

    def _scan(self, df: DataFrame, text: str, to: str, everything: bool) -> DataFrame:
        out, doc, names = self._with_doc(df, text)
        raw, kept, done = own_names(out, "raw", "kept", "done")
        parts = self._raw(doc, everything, self.min_severity)
        out = out.withColumn(raw, F.concat(*parts) if parts else _tagged(no_findings(), ""))
        out = out.withColumn(kept, self._kept(doc, F.col(raw), self.min_severity))
        out = out.withColumn(done, self._done(doc, F.col(kept)))
        chosen = F.when(F.size(done) > 1, dedupe(F.col(done)) if self.dedupe else by_start(F.col(done))).otherwise(F.col(done))
        return out.withColumn(to, chosen).drop(*names, raw, kept, done)

    def scan_sync(self, df: DataFrame, text: str = "text", to: str = "findings") -> DataFrame:
        """Adds the array of findings of all but asynchronous detectors."""
        return self._scan(df, text, to, False)

    def scan(self, df: DataFrame, text: str = "text", to: str = "findings") -> DataFrame:
        """Adds the array of findings of all detectors."""
        return self._scan(df, text, to, True)

    def findings(self, df: DataFrame, *keys: str, text: str = "text", everything: bool = False) -> DataFrame:
        """A row per finding with the key columns, whose names must not be those of a finding's fields."""
        if clash := {k.lower() for k in keys} & {k.lower() for k in [*FINDING_FIELDS, "match"]}:
            raise ValueError(f"key columns have names of findings' fields: {sorted(clash)}")
        source = df.select(*keys, text) if text not in keys else df.select(*keys)
        found, one = own_names(source, "found", "one")
        # A plain explode makes the optimizer ask for size > 0 below it, with the scan written out a second time.
        rows = self._scan(source, text, found, everything).select(*keys, F.explode_outer(found).alias(one))
        return rows.where(F.col(one).isNotNull()).select(*keys, f"{one}.*")

    def _redact(self, df: DataFrame, text: str, to: str, findings: str, mask: Masker, everything: bool) -> DataFrame:
        return self._scan(df, text, findings, everything).withColumn(to, redacted(F.col(text), F.col(findings), mask, resolved=self.dedupe))

    def redact_sync(self, df: DataFrame, text: str = "text", to: str = "text_redacted", findings: str = "findings", mask: Masker = masks.label) -> DataFrame:
        """Adds the findings and the text with these masked (null: null)."""
        return self._redact(df, text, to, findings, mask, False)

    def redact(self, df: DataFrame, text: str = "text", to: str = "text_redacted", findings: str = "findings", mask: Masker = masks.label) -> DataFrame:
        return self._redact(df, text, to, findings, mask, True)

    def has_sensitive_sync(self, df: DataFrame, text: str = "text", min_severity: str | None = None, to: str = "sensitive") -> DataFrame:
        """Adds whether any finding of at least min_severity, which replaces the scanner's own, is there. Detectors
        are asked one after the other, and none once one has found something."""
        severity = min_severity or self.min_severity
        if severity not in SEVERITY_RANK:
            raise ValueError(f"unknown severity: {severity}")
        out, doc, names = self._with_doc(df, text)
        any_of = F.lit(False)
        for part in reversed(self._raw(doc, False, severity)):
            any_of = F.when(F.size(self._kept(doc, part, severity)) > 0, True).otherwise(any_of)
        return out.withColumn(to, any_of).drop(*names)


def create_scanner(**options) -> Scanner:
    return Scanner(**options)


def apply_redaction(df: DataFrame, text: str = "text", findings: str = "findings", to: str = "text_redacted", mask: Masker = masks.label) -> DataFrame:
    """Masks the spans of a findings column (UTF-16 offsets), overlaps resolved first."""
    return df.withColumn(to, redacted(F.col(text), F.col(findings), mask))


def dedupe_findings(df: DataFrame, findings: str = "findings", to: str | None = None) -> DataFrame:
    return df.withColumn(to or findings, dedupe(F.col(findings)))


def python_masker(function: Callable[[str, str], str]) -> Callable[[DataFrame, str, str, str], DataFrame]:
    """A masker (rule id, original) -> replacement in Python, as a function of (df, text, findings, to)."""

    @F.pandas_udf("array<string>")
    def replacements(rules: pd.Series, originals: pd.Series) -> pd.Series:
        return pd.Series([[function(r, o) for r, o in zip(a, b, strict=True)] for a, b in zip(rules, originals, strict=True)], dtype=object)

    def apply(df: DataFrame, text: str, findings: str, to: str) -> DataFrame:
        spans, units, new = own_names(df, "spans", "units", "new")
        out = df.withColumns({spans: dedupe(F.col(findings)), units: Units.of(F.col(text))})
        u = Units(F.col(units)["pieces"], F.col(units)["wide"])
        out = out.withColumn(new, replacements(F.transform(spans, lambda f: f["ruleId"]), F.transform(spans, lambda f: u.cut(f["start"], f["end"]))))
        zipped = F.zip_with(spans, new, lambda f, n: F.struct(f["start"].alias("start"), f["end"].alias("end"), n.alias("new")))
        return out.withColumn(to, redacted(F.col(text), zipped, lambda f, o: f["new"], resolved=True)).drop(spans, units, new)

    return apply
