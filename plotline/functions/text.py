"""Text normalisation as native column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col
from .transliterate import one_to_one, spell_out

# --- fixed values ----------------------------------------------------------
NBSP = "\u00a0"
# letters that transliterate to more than one ASCII letter (applied first)
MULTI_CHAR_FOLDS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
# letters with no canonical decomposition, folded one-to-one
SINGLE_CHAR_FOLDS = {"đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D"}
# ---------------------------------------------------------------------------

# Code point blocks whose accented letters are folded by decomposition:
# Latin-1 Supplement, Latin Extended-A/B, Latin Extended Additional (which
# holds the Vietnamese letters with two marks).
_FOLD_BLOCKS = ((0x00A0, 0x024F), (0x1E00, 0x1EFF))


@lru_cache(maxsize=1)
def accent_fold_map() -> tuple[str, str]:
    """(from, to) strings for ``translate``: every character whose
    compatibility decomposition is one ASCII letter or digit plus combining
    marks maps to that character (``é`` → ``e``, ``ſ`` → ``s``, ``²`` → ``2``)."""
    src, dst = [], []
    for lo, hi in _FOLD_BLOCKS:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            base = "".join(x for x in unicodedata.normalize("NFKD", ch)
                           if not unicodedata.combining(x))
            if base != ch and len(base) == 1 and base.isascii() and base.isalnum():
                src.append(ch)
                dst.append(base)
    for k, v in SINGLE_CHAR_FOLDS.items():
        if k not in src:
            src.append(k)
            dst.append(v)
    return "".join(src), "".join(dst)


@lru_cache(maxsize=1)
def _ascii_map() -> tuple[str, str]:
    """The accent map, then the characters of other scripts that one ASCII character (or nothing) stands for."""
    src, dst = accent_fold_map()
    other, forms = one_to_one()
    pairs = [(ch, f) for ch, f in zip(other, forms) if ch not in src]
    gone = [ch for ch in other[len(forms):] if ch not in src]
    return src + "".join(ch for ch, _ in pairs) + "".join(gone), dst + "".join(f for _, f in pairs)


def fold_accents(c) -> Column:
    """Accented letters → ASCII base letters (multi-letter folds first);
    combining marks of decomposed input are removed, and what is still not
    ASCII (other scripts, dashes, quotes) is transliterated."""
    col = as_col(c)
    for k, v in MULTI_CHAR_FOLDS.items():
        col = F.replace(col, F.lit(k), F.lit(v))
    return spell_out(F.regexp_replace(F.translate(col, *_ascii_map()), r"\p{M}+", ""))


def squash_whitespace(c) -> Column:
    """any whitespace run (no-break spaces included, as in Python's
    ``str.split()``) → one space, trimmed."""
    return F.trim(F.regexp_replace(as_col(c), r"[\s\u00a0]+", " "))


def pre_clean(c) -> Column:
    """nbsp → space, ``"`` → ``'``, runs of spaces → one, and a ``.``
    appended after a trailing backslash."""
    col = F.replace(as_col(c), F.lit(NBSP), F.lit(" "))
    col = F.replace(col, F.lit('"'), F.lit("'"))
    col = F.regexp_replace(col, " +", " ")
    return F.when(col.endswith("\\"), F.concat(col, F.lit("."))).otherwise(col)


def attribute_name(c) -> Column:
    """``'diện tích đất'`` → ``'DienTichDat'``: accents folded, every word
    capitalised (rest lower-cased), blanks removed."""
    col = squash_whitespace(fold_accents(c))
    return F.regexp_replace(F.initcap(col), " ", "")


def strip_dots(c) -> Column:
    """F8: remove every ``.`` (category values like ``'Hồ bơi.'``)."""
    return F.regexp_replace(as_col(c), r"\.", "")


def extract_group(c, pattern: str, group: int = 1) -> Column:
    """regex group, ``''`` when the pattern does not match."""
    return F.regexp_extract(as_col(c), pattern, group)


def seller_id_from_profile(c, marker: str = "user/") -> Column:
    """text after ``user/`` (and optional blanks) in a profile link."""
    return F.regexp_extract(as_col(c), re.escape(marker) + r"\s*(.*)", 1)


def ensure_period(c) -> Column:
    col = as_col(c)
    return F.when(col.endswith("."), col).otherwise(F.concat(col, F.lit(".")))


def paragraphs_to_text(arr) -> Column:
    """array of paragraphs → one text, a ``.`` added where missing."""
    return F.array_join(F.transform(as_col(arr), ensure_period), " ")


def split_lines(c) -> Column:
    return F.split(as_col(c), "\n")


# Named character references: the HTML 5 table of Python's standard library (generated, not written
# out).  Names end in ";", but for the legacy ones that browsers also take without it.
_SEP, _IS = "\u0001", "\u0002"
_LEGACY_LENGTHS = sorted({len(k) for k in html5 if not k.endswith(";")}, reverse=True)
_LONGEST_NAME = max(map(len, html5))


@lru_cache(maxsize=1)
def _named_ref_map() -> Column:
    """One foldable expression instead of thousands of literals: planning time does not grow with the table."""
    return F.str_to_map(F.lit(_SEP.join(f"{k}{_IS}{v}" for k, v in sorted(html5.items()))), F.lit(_SEP), F.lit(_IS))


@lru_cache(maxsize=1)
def _c1_chars() -> str:
    """Numeric references 0x80–0x9F name Windows-1252 characters (HTML rule);
    the table is generated from Python's cp1252 codec."""
    def char(n: int) -> str:
        try:
            return bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(n)
    return "".join(map(char, range(0x80, 0xA0)))


# one token per possible character reference, or per run of text between them
_REF_TOKEN = r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[^\t\n\f <&#;]{1,32}+;?+)|[^&]++|&"


def _char_for(n: Column) -> Column:
    """Code point → character, with HTML's replacements for invalid ones."""
    hi = F.lit(0xD800) + F.shiftright(n - F.lit(0x10000), 10)
    lo = F.lit(0xDC00) + F.bitwise_not(F.bitwise_not(n - F.lit(0x10000)).bitwiseOR(F.lit(-1024)))
    bmp = F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
    astral = F.decode(F.unhex(F.concat(F.hex(hi), F.hex(lo))), "UTF-16BE")
    control = n.between(1, 8) | n.between(0x0E, 0x1F) | n.between(0x7F, 0x9F) | (n == 0x0B)
    no_character = n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    return (F.when(n.isNull(), F.lit(None).cast("string"))
            .when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
            .when(n.between(0x80, 0x9F), F.substr(F.lit(_c1_chars()), n.cast("int") - 0x7F, F.lit(1)))
            .when(control | no_character, F.lit(""))
            .when(n <= 0xFFFF, bmp)
            .otherwise(astral))


def _number(digits: Column, base: int) -> Column:
    """Value of any number of digits; everything past the last code point is one value past it."""
    short = F.regexp_replace(digits, "^0+", "")
    value = F.when(F.length(short) > 7, F.lit(0x110000).cast("long")).otherwise(F.conv(short, base, 10).cast("long"))
    return F.when(short == "", F.lit(0).cast("long")).otherwise(value)


def _decode_token(t: Column, names: Column) -> Column:
    """One token: a numeric reference, a name of the table, a legacy name at its beginning (the longest), or plain text."""
    hexa = F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+)", 1)
    number = F.when(hexa != "", _number(hexa, 16)).otherwise(_number(F.regexp_extract(t, "^&#([0-9]+)", 1), 10))
    name = F.substring(t, 2, _LONGEST_NAME + 1)
    # a name of the table with its ";", else the longest legacy name it begins with
    legacy = F.coalesce(*[F.when(F.length(name) >= n, F.concat(F.try_element_at(names, F.left(name, F.lit(n))),
                                                               F.substr(t, F.lit(n + 2)))) for n in _LEGACY_LENGTHS])
    named = F.coalesce(F.when(name.endswith(";"), F.try_element_at(names, name)), legacy, t)
    return (F.when(~t.startswith("&") | (F.length(t) < 2), t)
            .when(t.rlike("^&#[0-9xX]"), _char_for(number))
            .otherwise(named))


def html_unescape(c) -> Column:
    """Decode HTML character references in ONE pass: the text is cut into
    reference tokens and the runs between them, each reference is decoded
    exactly once, and the pieces are joined again — decoded output is never
    decoded a second time.  Numeric references follow HTML's rules (any number
    of digits, ``;`` optional; NUL, surrogates and values past U+10FFFF become
    U+FFFD, 0x80–0x9F are Windows-1252 characters, other controls and
    non-characters vanish); named ones come from the HTML 5 table, legacy names
    also without ``;`` and as the longest beginning of a longer word; unknown
    names are kept.  Text without ``&`` passes through untouched."""
    col = as_col(c)
    tokens = F.regexp_extract_all(col, F.lit(_REF_TOKEN), 0)
    # the table enters the expression once, as a lambda variable
    decoded = F.transform(F.array(_named_ref_map()), lambda names: F.array_join(
        F.transform(tokens, lambda t: _decode_token(t, names)), ""))[0]
    return F.when(col.contains("&"), decoded).otherwise(col)
