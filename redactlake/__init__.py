"""redactlake: sensitive-content detection and redaction as DataFrame transformations."""

from redactlake.functions import is_valid_cn_id, is_valid_uscc, luhn, mask_preview, shannon_entropy
from redactlake.operators.ahocorasick import AhoCorasick
from redactlake.operators.deep import CallableDetector, deep
from redactlake.operators.keywords import KeywordList, keywords
from redactlake.operators.normalize import DEFAULT_IGNORE, Normalizer
from redactlake.operators.pii import pii
from redactlake.operators.regex import RegexRule, regex_detector
from redactlake.operators.resolve import masks
from redactlake.operators.secrets import RULES, SecretRule, is_placeholder, secrets
from redactlake.plans.scanner import Pattern, Scanner, apply_redaction, create_scanner, dedupe_findings, python_masker
from redactlake.types import SEVERITY_RANK

__version__ = "0.1.0"
__all__ = ["DEFAULT_IGNORE", "RULES", "SEVERITY_RANK", "AhoCorasick", "CallableDetector", "KeywordList", "Normalizer", "Pattern", "RegexRule", "Scanner", "SecretRule", "apply_redaction", "create_scanner", "dedupe_findings", "deep", "is_placeholder", "is_valid_cn_id", "is_valid_uscc", "keywords", "luhn", "mask_preview", "masks", "pii", "python_masker", "regex_detector", "secrets", "shannon_entropy"]
