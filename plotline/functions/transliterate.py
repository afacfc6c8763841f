"""Letters of other scripts and typographic signs → ASCII, as one native expression.

The table is generated from the Unicode names and decompositions of Python's
standard library, not written out.  A character is decomposed first; what is
left of it becomes

* a letter of an alphabet (Greek, Cyrillic, Armenian, Georgian, Hebrew,
  Arabic): the beginning of its Unicode name up to the first vowel (``THETA`` →
  ``th``), the consonants of a name that begins with a vowel for Cyrillic
  (``EL`` → ``l``), or the fixed value below;
* a kana: its name (``KA`` → ``ka``);
* a decimal digit of any script: its value;
* a Hangul syllable: its name;
* a combining mark or a control of the writing direction: nothing;
* a dash, quotation mark or other sign of the fixed values: what they say.

Characters without a rule (ideographs, scripts not named) stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
# signs whose ASCII form no decomposition gives
SIGN_FOLDS = {
    "¡": "!", "¢": "c", "£": "GBP", "¥": "JPY", "§": "S", "©": "(c)", "«": "<<", "®": "(r)", "°": "deg", "¶": "P",
    "·": "*", "»": ">>", "¿": "?", "×": "x", "÷": "/",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "--", "―": "--", "−": "-",
    "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": ",,", "‟": '"',
    "†": "+", "‡": "++", "•": "*", "‹": "<", "›": ">", "′": "'", "″": '"', "⁄": "/", "€": "EUR", "₫": "VND",
    "←": "<-", "→": "->", "、": ",", "。": ".", "「": "'", "」": "'", "؟": "?", "،": ",", "؛": ";",
}
# Cyrillic letters whose names do not spell their sound
CYRILLIC_SOUNDS = {"GHE": "g", "HA": "kh", "HARD SIGN": '"', "SOFT SIGN": "'", "YERU": "y", "YU": "yu", "YA": "ya",
                   "YI": "yi", "IE": "e", "IO": "io"}
GREEK_SOUNDS = {"RHO": "r"}
# ---------------------------------------------------------------------------

_ALPHABETS = ("GREEK", "CYRILLIC", "ARMENIAN", "GEORGIAN", "HEBREW", "ARABIC")
_LETTER = re.compile(rf"({'|'.join(_ALPHABETS)}) (?:(SMALL|CAPITAL) )?LETTER (?:FINAL |BYELORUSSIAN-UKRAINIAN )?([A-Z ]+?)(?: WITH .*)?$")
_KANA = re.compile(r"(?:HIRAGANA|KATAKANA) LETTER (?:SMALL )?([A-Z]{1,3})$")
#: code points of the table: everything past ASCII up to the kana, Hangul syllables, presentation and full-width forms
TABLE_RANGES = ((0x80, 0x30FF), (0xAC00, 0xD7A3), (0xFB00, 0xFFEF))
_NONE, _SEP = "\u0001", "\u0002"          # "stays as it is" and the separator in the table's text
_TOKEN = r"[\x00-\x7f]++|(?s:.)"


def _letter(script: str, name: str) -> str:
    if script == "CYRILLIC" and name in CYRILLIC_SOUNDS:
        return CYRILLIC_SOUNDS[name]
    if script == "GREEK" and name in GREEK_SOUNDS:
        return GREEK_SOUNDS[name]
    word = name.split()[0]
    if script == "CYRILLIC":
        consonants = word.strip("AEIOU")
        return (consonants or word[0]).lower()
    return re.match("[AEIOU]|[^AEIOU]+", word)[0].lower()


def _undecomposed(ch: str) -> str | None:
    if ch.isascii():
        return ch
    if ch in SIGN_FOLDS:
        return SIGN_FOLDS[ch]
    if unicodedata.category(ch) in ("Mn", "Me", "Mc", "Cf"):
        return ""
    if unicodedata.category(ch) == "Nd":
        return str(unicodedata.decimal(ch))
    name = unicodedata.name(ch, "")
    if m := _LETTER.match(name):
        out = _letter(m[1], m[3])
        return out.capitalize() if m[2] == "CAPITAL" else out
    if m := _KANA.match(name):
        return m[1].lower()
    return None


def ascii_form(ch: str) -> str | None:
    """ASCII form of one character, None where no rule gives one."""
    if ch in SIGN_FOLDS:
        return SIGN_FOLDS[ch]
    if "가" <= ch <= "힣":
        return unicodedata.name(ch).rsplit(" ", 1)[1].lower()
    parts = [_undecomposed(x) for x in unicodedata.normalize("NFKD", ch)]
    return None if None in parts else "".join(parts)


@lru_cache(maxsize=None)
def _table(lo: int, hi: int) -> str:
    forms = (ascii_form(chr(cp)) for cp in range(lo, hi + 1))
    return _SEP.join(_NONE if f is None else f for f in forms)


@lru_cache(maxsize=1)
def one_to_one() -> tuple[str, str]:
    """(from, to) strings for ``translate``: characters whose form is one character, then those whose form is empty."""
    forms = [(chr(cp), ascii_form(chr(cp))) for lo, hi in TABLE_RANGES for cp in range(lo, hi + 1)]
    single = [(ch, f) for ch, f in forms if f is not None and len(f) == 1]
    return ("".join(ch for ch, _ in single) + "".join(ch for ch, f in forms if f == ""), "".join(f for _, f in single))


def transliterate(c: Column) -> Column:
    """Every character of the table → its ASCII form; text in ASCII passes through untouched."""
    return spell_out(F.translate(c, *one_to_one()))


def spell_out(c: Column) -> Column:
    """The characters of the table that ``translate`` cannot replace, those with longer forms.

    Each range is one foldable array that a character's code point indexes, so
    a look-up costs the same for any script.
    """
    tokens = F.regexp_extract_all(c, F.lit(_TOKEN), 0)

    def form(t: Column, tables: Column) -> Column:
        cp = F.ascii(t)
        out = t
        for i, (lo, hi) in enumerate(TABLE_RANGES):
            found = F.element_at(tables[i], (cp - lo + 1).cast("int"))
            out = F.when(cp.between(lo, hi), F.when(found == _NONE, t).otherwise(found)).otherwise(out)
        return out

    tables = F.array(*[F.split(F.lit(_table(lo, hi)), _SEP, -1) for lo, hi in TABLE_RANGES])
    done = F.transform(F.array(tables), lambda x: F.array_join(F.transform(tokens, lambda t: form(t, x)), ""))[0]
    return F.when(c.rlike(r"[^\x00-\x7f]"), done).otherwise(c)
