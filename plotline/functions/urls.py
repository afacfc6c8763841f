"""URL predicates and URL-derived columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# --- fixed values: URL validity pattern (scheme, host / localhost / IPv4,
# optional port, optional path), matched case-insensitively ---------------
URL_PATTERN = (
    r"^(?:http|ftp)s?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|"
    r"localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?"
    r"(?:/?|[/?]\S+)$"
)
# the listing id is the last 10 characters of its URL
URL_ID_CHARS = 10
# ---------------------------------------------------------------------------


def is_valid_url(c) -> Column:
    """True when the text is an http(s)/ftp(s) URL; null input → false."""
    return F.coalesce(as_col(c).rlike("(?i)" + URL_PATTERN), F.lit(False))


def url_id(c, n_chars: int = URL_ID_CHARS) -> Column:
    """listing id = last ``n_chars`` characters of the URL."""
    return F.right(as_col(c), F.lit(n_chars))


def page_numbers(first, last) -> Column:
    """F13 helper: array of page numbers ``first..last`` (empty when last < first)."""
    first, last = as_col(first), as_col(last)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def page_url(base, page) -> Column:
    """``base?page=n``."""
    return F.concat(as_col(base), F.lit("?page="), as_col(page).cast("string"))
