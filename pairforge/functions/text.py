"""Column helpers for cleaning text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to more than one ASCII character.
WIDE_FOLDS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "…": "...", "€": "EUR",
    "ﬁ": "fi", "ﬂ": "fl", "™": "(tm)", "«": "<<", "»": ">>",
}
# Letters and signs without a canonical decomposition that fold to one ASCII character.
NARROW_FOLDS = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H",
    "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "‐": "-", "−": "-", "×": "x",
    " ": " ", " ": " ", " ": " ", " ": "\n", " ": "\n", "\u0085": "\n",
}


def _accent_folds() -> dict[str, str]:
    """Accented Latin letters (up to U+024F and U+1E00..U+1EFF) with their base letter, by decomposition."""
    folds = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            folds[chr(code)] = base
    return folds


_NARROW = {**_accent_folds(), **NARROW_FOLDS}


# What ``str.strip`` cuts.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_all(text: Column) -> Column:
    """Strip every kind of white space at both ends; ``btrim`` looks at the ends only, a pattern at all of it."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def ascii_fold(text: Column) -> Column:
    """Write accented letters and typographic signs in ASCII; drop what has no ASCII form.

    Text that is ASCII already is passed on after one scan.
    """
    narrow = F.translate(text, "".join(_NARROW), "".join(_NARROW.values()))
    wide = narrow
    for sign, plain in WIDE_FOLDS.items():
        wide = F.replace(wide, F.lit(sign), F.lit(plain))
    folded = F.when(text.rlike(f"[{''.join(WIDE_FOLDS)}]"), wide).otherwise(narrow)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]+", "")).otherwise(text)


def normalise_space(text: Column) -> Column:
    """White space around and between line breaks becomes one break, other runs one blank."""
    breaks = F.regexp_replace(text, r"\s*[\n\r\x0B\f]\s*", "\n")
    # Single blanks stay as they are, so only longer runs and other signs are rewritten.
    return strip_all(F.regexp_replace(breaks, r"[^\S\n]{2,}|[^\S\n ]", " "))


def normalise_text(text: Column) -> Column:
    """ASCII fold plus white-space normalisation; case, urls, digits and punctuation stay."""
    return normalise_space(ascii_fold(text))


def strip_preamble(query: Column) -> Column:
    """Cut what precedes the first SELECT; a query without SELECT stays as it is."""
    cut = F.regexp_replace(query, r"(?is)\A.+?(?=SELECT)", "")
    return F.when(F.lower(query).startswith("select"), query).otherwise(cut)


def strip_comments(query: Column) -> Column:
    """Delete comment lines before the first SELECT, which is written in upper case afterwards."""
    parts = F.split(query, "(?i)SELECT", 2)
    head = F.regexp_replace(F.get(parts, F.lit(0)), r"(?m)^\s*#.*\n", "")
    return F.when(F.size(parts) == 2, F.concat(head, F.lit("SELECT"), F.get(parts, F.lit(1)))).otherwise(head)


def remove_markup(text: Column) -> Column:
    return F.regexp_replace(text, r"""(?d)</?[a-zA-z?;="' ]*>|<.+[\W]>""", " ")


def remove_style_attributes(text: Column) -> Column:
    return F.regexp_replace(text, r'(?d)(?:class|colspan|style|rowspan)=".+"', " ")


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https:[a-zA-Z%:./#_0-9]+", " ")


def post_trim(text: Column) -> Column:
    """Strip, then halve each run of line breaks once."""
    return F.replace(strip_all(text), F.lit("\n\n"), F.lit("\n"))


def clean_description(text: Column) -> Column:
    return post_trim(remove_urls(text))


def clean_context(text: Column) -> Column:
    return post_trim(remove_markup(remove_style_attributes(text)))


def label_slug(label: Column) -> Column:
    """Letters, digits and blanks only, blanks as underscores."""
    return F.replace(F.regexp_replace(label, "[^a-zA-Z0-9 ]", ""), F.lit(" "), F.lit("_"))


def word_count(text: Column) -> Column:
    """Pieces between single blanks, empty pieces included."""
    return F.size(F.split(text, " ", -1))


def round_significant(x: Column, digits: int = 2) -> Column:
    """Round to ``digits`` places after the leading digit; zero, NaN and null stay."""
    places = F.lit(digits) - F.floor(F.log10(F.abs(x)))
    # Dividing by the power for whole-number scales keeps the usual decimal result (0.12, not 0.12000000000000001).
    up, down = F.pow(F.lit(10.0), F.abs(places)), places >= 0
    scaled = F.when(down, F.rint(x * up) / up).otherwise(F.rint(x / up) * up)
    return F.when((x == 0) | F.isnan(x) | x.isNull(), x).otherwise(scaled)
