"""Scalar functions as Column expressions."""

from redactlake.functions.checks import has_known_bin, is_valid_cn_id, is_valid_uscc, luhn
from redactlake.functions.text import char_class_count, clamp01, decode_base64, has_letter_and_digit, looks_like_code, looks_like_path_or_url, looks_like_version, mask_preview, shannon_entropy, utf16_length

__all__ = ["char_class_count", "clamp01", "decode_base64", "has_known_bin", "has_letter_and_digit", "is_valid_cn_id", "is_valid_uscc", "looks_like_code", "looks_like_path_or_url", "looks_like_version", "luhn", "mask_preview", "shannon_entropy", "utf16_length"]
