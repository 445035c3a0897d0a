"""Text normalization as column expressions: no Python runs on the executors.

Whole texts are normalized by regular expressions over the string, not by a
lambda over its tokens, so the expressions stay inside code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normalization gives the expected results only with exactly these.
QUOTES = "'\"״׳`´“”‘’"
DASHES = "-־–—_/"
PREFIX_LETTERS = "בלמהוכש"
CONSTRUCT = {"לשכת": "לשכה", "יחידת": "יחידה", "חטיבת": "חטיבה", "מחלקת": "מחלקה", "מפקדת": "מפקדה"}
BASES = [
    "לשכת", "לשכה", "יחידת", "יחידה", "חטיבת", "חטיבה", "מחלקת", "מחלקה", "מפקדת", "מפקדה",
    "מודיעין", "מבצעים", "לוחמה", "בסיס", "אלוף", "מבצע", "מבצעי", "חמל", "סייבר", "קריפטוגרפיה",
    "הצפנה", "צופן", "שייטת", "סיירת", "מטכל", "שלדג", "דובדבן", "מגלן", "אגוז", "יהלם",
    "לוטם", "מצוב", "הקריה", "נבטים", "חצרים", "פלמחים", "מרפאה", "בדיקת", "דם", "תור",
    "מספרה", "ספרייה", "משרד", "קבלה", "אפסנאות",
]
HEBREW_LETTERS = "אבגדהוזחטיכלמנסעפצקרשת"
OTHER = "אחר"
# End of fixed values.

MIN_STRIPPED = 3
STRIPPABLE = [b for b in BASES if len(b) >= MIN_STRIPPED]
OUTSIDE = "[^\u0590-\u05bd\u05bf-\u05ff0-9a-zA-Z]+"
RAW = "[\\u0590-\\u05ffA-Za-z0-9]+"
WORD_CLASS = r"֐-׿0-9a-zA-Z"


def chained(bases: list[str] = STRIPPABLE, letters: str = PREFIX_LETTERS) -> list[tuple[str, str]]:
    """Bases that lose 1 to 3 prefix letters to another base: the one-step expression needs this to be empty."""
    return [(a, b) for a in bases for b in bases for k in (1, 2, 3) if a[k:] == b and set(a[:k]) <= set(letters)]


def strip_marks(c: Column) -> Column:
    """Drop combining marks; nothing is decomposed first."""
    return F.regexp_replace(c, r"\p{Mn}", "")


def _replace_words(c: Column, strip: bool) -> Column:
    """Prefix stripping and construct forms on a text of single-blank-separated words."""
    if strip:
        c = F.regexp_replace(c, f"(?<![^ ])[{PREFIX_LETTERS}]{{1,3}}({'|'.join(STRIPPABLE)})(?![^ ])", "$1")
    for form, plain in CONSTRUCT.items():
        c = F.regexp_replace(c, f"(?<![^ ]){form}(?![^ ])", plain)
    return c


def normalize_token(c: Column, strip: bool = True) -> Column:
    """One token: marks, blanks around, case, quotes and foreign characters go; then prefixes and construct forms."""
    c = F.translate(F.lower(F.trim(strip_marks(c))), QUOTES, "")
    return _replace_words(F.regexp_replace(c, f"[^{WORD_CLASS}]+", ""), strip)


def normalize_text(c: Column) -> Column:
    """A whole text; null stays null, a text without content becomes empty.

    Two replacements do it: marks and quotes go, then every run of other
    characters outside the word class becomes a blank. The dashes are such
    characters but for the maqaf, which lies inside the Hebrew range.
    """
    c = F.regexp_replace(c, f"[\\p{{Mn}}{QUOTES}]+", "")
    c = F.lower(F.trim(F.regexp_replace(c, OUTSIDE, " ")))
    # only Hebrew words have prefixes or construct forms
    return F.when(c.rlike("[א-ת]"), _replace_words(c, True)).otherwise(c)


_MARKS = re.compile(f"[\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7{QUOTES}]+")
_PREFIXED = re.compile(f"(?<![^ ])[{PREFIX_LETTERS}]{{1,3}}({'|'.join(STRIPPABLE)})(?![^ ])")


def normalized_raw(token: str) -> str:
    """``normalize_text`` of a raw token, outside Spark: it holds only word characters, and the maqaf alone becomes a blank."""
    c = re.sub("\u05be+", " ", _MARKS.sub("", token)).strip(" ").lower()
    if not re.search("[א-ת]", c):
        return c
    return " ".join([CONSTRUCT.get(w, w) for w in _PREFIXED.sub(r"\1", c).split(" ")])


def normalize_pattern(c: Column) -> Column:
    """A rule pattern: each word normalized, prefixes kept."""
    return F.array_join(F.filter(F.transform(F.split(c, r"\s+"), lambda w: normalize_token(w, False)), lambda w: w != ""), " ")


def tokens(normalized: Column) -> Column:
    """Words of a normalized text; an empty array for an empty or null one."""
    return F.when(F.coalesce(normalized, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def raw_tokens(c: Column) -> Column:
    """Maximal runs of word characters of the raw text; marks and geresh stay inside."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(RAW), F.lit(0))


def letter_bucket(c: Column) -> Column:
    """First letter's bucket: a Hebrew base letter, a Latin capital, a digit, else OTHER."""
    first = F.substring(F.coalesce(c, F.lit("")), 1, 1)
    return F.when(first.rlike(f"^[{HEBREW_LETTERS}]$"), first).when(first.rlike("^[a-zA-Z]$"), F.upper(first)).when(first.rlike("^[0-9]$"), first).otherwise(F.lit(OTHER))


def buckets() -> list[str]:
    return [*HEBREW_LETTERS, *"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *"0123456789", OTHER]


def contains_any(c: Column, parts: list[str]) -> Column:
    """Any of the parts is a substring."""
    found = F.lit(False)
    for p in parts:
        found = found | F.coalesce(c, F.lit("")).contains(p)
    return found
