"""Personal data: candidates by pattern, then a structural check. Runs inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake.functions.checks import has_known_bin, is_valid_cn_id, is_valid_uscc, luhn
from redactlake.operators.spans import found, let
from redactlake.types import Doc, Span, no_findings, raw_finding

# Results follow from them.
#: Type, default severity, description.
TYPES = {
    "cn-id-card": ("high", "Chinese resident ID card number (居民身份证号)"),
    "bank-card": ("high", "Bank / payment card number (银行卡号)"),
    "cn-mobile": ("medium", "Chinese mobile phone number (手机号)"),
    "cn-uscc": ("low", "Unified social credit code (统一社会信用代码)"),
    "email": ("low", "Email address"),
    "ipv4": ("low", "IPv4 address"),
}
DEFAULT_INCLUDE = ("cn-id-card", "cn-mobile", "bank-card", "cn-uscc", "email")
#: Words that make a card number likelier, and how many UTF-16 units before it they count.
CARD_CONTEXT = r"(?i)(?:卡号|银行卡|信用卡|借记卡|储蓄卡|card|visa|mastercard|unionpay|银联|账号|帐号)"
CONTEXT_UNITS = 24

#: Candidates. A domain has 128 labels at most (names in DNS have 127), as the regex engine recurses on them.
PATTERNS = {
    "cn-id-card": r"(?<![0-9A-Za-z])[1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx](?![0-9A-Za-z])",
    "bank-card": r"(?<![0-9])(?:[0-9][ -]?){14,18}[0-9](?![0-9])",
    "cn-mobile": r"(?<![0-9])(?:(?:\+|00)?86[ -]?)?1[3-9][0-9](?:[ -]?[0-9]{4}){2}(?![0-9])",
    "cn-uscc": r"(?<![0-9A-Z])[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}(?![0-9A-Z])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9.])",
}
#: Addresses that are never reported, lower-cased.
EMAIL_EXAMPLES = r"^(?:example\.(?:com|org|net)|test\.com|localhost)\z"
IPV4_SPECIAL = r"^(?:0|127|255)\."
CARD_DIGITS = (15, 19)
#: Confidence of a card number near such a word, grouped, bare (which is always medium).
CARD_NEAR, CARD_GROUPED, CARD_BARE = 0.9, 0.75, 0.5
CONFIDENCE = {"cn-id-card": 0.95, "cn-mobile": 0.85, "cn-uscc": 0.9, "email": 0.95, "ipv4": 0.7}

#: struct (confidence, severity or null: the type's own) of a candidate; null turns it down.
Verdict = Column


def _if(ok: Column, confidence: float) -> Verdict:
    return F.when(ok, F.struct(F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("severity")))


def _id_card(s: Span, as_of: Column | None) -> Verdict:
    return _if(is_valid_cn_id(s.match, as_of), CONFIDENCE["cn-id-card"])


def _bank_card(s: Span, as_of: Column | None) -> Verdict:
    def checked(d: Column) -> Column:
        n = F.length(d)
        identity = F.when(n == 18, is_valid_cn_id(d, as_of)).otherwise(False)
        return F.when(n.between(*CARD_DIGITS) & ~d.rlike(r"^([0-9])\1+\z") & has_known_bin(d), luhn(d) & ~identity).otherwise(False)

    def context(before: Column) -> Column:
        # The window is counted in UTF-16 units: of as many code points, the last CONTEXT_UNITS units.
        units = F.encode(before, "UTF-16BE")
        cut = F.regexp_replace(F.decode(F.right(units, F.lit(2 * CONTEXT_UNITS)), "UTF-16BE"), "^\ufffd", "")
        return F.when(F.octet_length(units) <= 2 * CONTEXT_UNITS, before).otherwise(cut).rlike(CARD_CONTEXT)

    def strength(near: Column) -> Column:
        bare = ~s.match.rlike("[ -]")
        return F.struct(F.when(near, CARD_NEAR).when(bare, CARD_BARE).otherwise(CARD_GROUPED).alias("confidence"), F.when(~near & bare, F.lit("medium")).alias("severity"))

    return F.when(let(F.regexp_replace(s.match, "[ -]", ""), checked), let(let(s.before(CONTEXT_UNITS), context), strength))


def _email(s: Span, as_of: Column | None) -> Verdict:
    domain = F.lower(F.substring_index(s.match, "@", -1))
    return _if(~domain.rlike(EMAIL_EXAMPLES), CONFIDENCE["email"])


CHECKS: dict[str, Callable[[Span, Column | None], Verdict]] = {
    "cn-id-card": _id_card,
    "bank-card": _bank_card,
    "cn-mobile": lambda s, _: _if(F.lit(True), CONFIDENCE["cn-mobile"]),
    "cn-uscc": lambda s, _: _if(is_valid_uscc(s.match), CONFIDENCE["cn-uscc"]),
    "email": _email,
    "ipv4": lambda s, _: _if(~s.match.rlike(IPV4_SPECIAL), CONFIDENCE["ipv4"]),
}
#: What a text must hold for the pattern to be worth a try: the least of it without looking around, as that is what
#: costs most at each character.
NEEDS = {"cn-id-card": "[0-9]{17}[0-9Xx]", "bank-card": "[0-9](?:[ -]?[0-9]){14}", "cn-mobile": "1[3-9][0-9](?:[ -]?[0-9]{4}){2}", "cn-uscc": "[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}", "email": "@", "ipv4": r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"}


@dataclass(frozen=True)
class Pii:
    """Detector of personal data. severity overrides the default of a type, but for bare card numbers, always medium.
    as_of: the time up to which birth dates count, the query's own by default."""

    include: tuple[str, ...] = DEFAULT_INCLUDE
    severity: tuple[tuple[str, str], ...] = ()
    as_of: str | None = None
    id: str = "pii"
    is_async: bool = False

    def types(self) -> list[str]:
        return [t for t in TYPES if t in self.include]

    def rule_ids(self) -> list[str]:
        return [f"pii.{t}" for t in self.types()]

    def best(self, rule_id: str) -> tuple[str, float]:
        """The greatest severity and confidence that the rule can report."""
        kind = rule_id.removeprefix("pii.")
        top = CONFIDENCE.get(kind, CARD_NEAR)
        severity = dict(self.severity).get(kind, TYPES[kind][0])
        return ("medium" if kind == "bank-card" and severity == "low" else severity), top

    def detect(self, doc: Doc, only: Iterable[str] | None = None) -> Column:
        """The types whose candidates the text may hold, as an array, go through one expression."""
        as_of = F.lit(self.as_of).cast("timestamp") if self.as_of else None
        chosen, rows, checks = dict(self.severity), [], []
        for kind in self.types():
            if only is not None and f"pii.{kind}" not in only:
                continue
            need = F.contains(doc.text, F.lit("@")) if kind == "email" else doc.text.rlike(NEEDS[kind])
            fields = {"id": f"pii.{kind}", "regex": PATTERNS[kind], "severity": chosen.get(kind, TYPES[kind][0]), "description": TYPES[kind][1]}
            rows.append(F.when(need, F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])))
            checks.append((fields["id"], CHECKS[kind]))
        if not rows:
            return no_findings()

        def emit(own: Column) -> Callable[[Span], Column]:
            def verdict(s: Span) -> Column:
                out = F.lit(None)
                for rule_id, check in checks:
                    out = F.when(own["id"] == rule_id, check(s, as_of)).otherwise(out)
                return out

            def finding(s: Span, v: Column) -> Column:
                return F.when(v.isNotNull(), raw_finding(own["id"], "pii", F.coalesce(v["severity"], own["severity"]), v["confidence"], s, own["description"]))

            return lambda s: let(verdict(s), lambda v: finding(s, v))

        worth = F.filter(F.array(*rows), lambda r: r.isNotNull())
        return F.flatten(F.transform(worth, lambda r: found(doc, r["regex"], emit(r))))


def pii(include: Iterable[str] | None = None, severity: dict[str, str] | None = None, as_of: str | None = None) -> Pii:
    unknown = set(include or ()) | set(severity or ())
    if unknown - set(TYPES):
        raise ValueError(f"unknown types: {sorted(unknown - set(TYPES))}")
    return Pii(DEFAULT_INCLUDE if include is None else tuple(include), tuple((severity or {}).items()), as_of)
