"""Scalar column functions (all native Spark expressions)."""

from .misc import current_time, exp_back, money_text, ordinal_by_keywords
from .text import (attribute_name, extract_group, fold_accents, html_unescape,
                   paragraphs_to_text, pre_clean, seller_id_from_profile, split_lines,
                   squash_whitespace, strip_dots)
from .units import (area_number, drop_suffix, length_number, price_per_m2_to_millions,
                    price_to_millions, try_double, try_float, try_int)
from .urls import is_valid_url, page_numbers, page_url, url_id

__all__ = [
    "area_number", "attribute_name", "current_time", "drop_suffix", "exp_back", "extract_group",
    "fold_accents", "html_unescape", "is_valid_url", "length_number", "money_text",
    "ordinal_by_keywords", "page_numbers", "page_url", "paragraphs_to_text", "pre_clean",
    "price_per_m2_to_millions", "price_to_millions", "seller_id_from_profile", "split_lines",
    "squash_whitespace", "strip_dots", "try_double", "try_float", "try_int", "url_id",
]
