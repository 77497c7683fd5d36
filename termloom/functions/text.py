"""Column functions for keyword text and numbers."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable
from string import ascii_letters

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import JUNK_STRINGS

# Unicode white space plus the four ASCII separators that text tools also strip.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NOT_ASCII = r"[^\x00-\x7F]"
# ASCII that normalized text keeps, where ``&`` stands for a word, and all other ASCII.
_KEPT = r"[A-Za-z0-9/&\-]"
_APART = "".join(c for c in map(chr, range(0x80)) if not re.fullmatch(r"[a-z0-9/\-]", c))


@functools.cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding per character, derived from the Unicode data.

    Gives the characters that fold to one ASCII character, their images, and those that fold to
    several with their images. Every other non-ASCII character folds to nothing. Combining marks
    all vanish, so folding one character at a time is exact. Planes above the second only hold
    ideographs.
    """
    source, image, several = [], [], {}
    for char in map(chr, range(0x80, 0x20000)):
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(folded) == 1:
            source.append(char)
            image.append(folded)
        elif folded:
            several[char] = folded
    return "".join(source), "".join(image), several


def fold_ascii(col: Column) -> Column:
    """Compatibility-decompose and drop what is not ASCII, without leaving the JVM.

    ASCII text, the usual case, is passed on as it is, and so is text that is ASCII once characters
    that fold to one are translated; of the rest, only text with a character that folds to several
    (ligatures, fractions) is taken apart.
    """
    source, image, several = _fold_tables()
    # One literal per row that needs it; no character in it is a control code.
    pairs = F.lit("\x02".join(f"{c}\x01{folded}" for c, folded in several.items()))
    unfold = F.array(F.str_to_map(pairs, F.lit("\x02"), F.lit("\x01")))

    def spell(table: Column) -> Column:
        letters = F.split(lettered, "")
        return F.array_join(
            F.transform(letters, lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
        )

    lettered = F.translate(col, source, image)
    needs_spelling = F.translate(lettered, "".join(several), "") != lettered
    spelled = F.when(needs_spelling, F.element_at(F.transform(unfold, spell), 1)).otherwise(lettered)
    ascii_only = F.regexp_replace(spelled, _NOT_ASCII + "+", "")
    return (
        F.when(~col.rlike(_NOT_ASCII), col)
        .when(~lettered.rlike(_NOT_ASCII), lettered)
        .otherwise(ascii_only)
    )


def normalize_ascii(col: Column) -> Column:
    """The part of ``normalize_text`` after folding."""
    text = F.replace(F.lower(col), F.lit("&"), F.lit(" and "))
    text = F.trim(F.translate(text, _APART, " " * len(_APART)))
    return F.regexp_replace(text, "  +", " ")


def normalize_text(col: Column) -> Column:
    """Lower-case ASCII words, digits, ``-`` and ``/`` separated by single spaces."""
    return normalize_ascii(fold_ascii(col))


def has_normalized(col: Column) -> Column:
    """True where ``normalize_text`` leaves something; most text shows it without being folded."""
    return col.rlike(_KEPT) | fold_ascii(col).rlike(_KEPT)


def strip_text(col: Column) -> Column:
    """Trim every kind of white space (``trim`` only knows the plain space)."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def is_junk(col: Column) -> Column:
    """True for stripped text that stands for a missing value."""
    return F.lower(col).isin(JUNK_STRINGS)


def slug_of_ascii(col: Column) -> Column:
    """``stable_slug`` of text that is already normalized."""
    slug = F.btrim(F.regexp_replace(col, r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(slug, 1, 80), F.lit("")), F.lit("cluster"))


def stable_slug(col: Column) -> Column:
    """URL-safe form of at most 80 characters, ``cluster`` when nothing is left."""
    return slug_of_ascii(normalize_text(col))


def clean_numeric(col: Column, dtype: T.DataType | None = None) -> Column:
    """Number from text such as ``1,900``, ``34%`` or ``n/a``; what is no finite number is null."""
    if isinstance(dtype, T.NumericType):
        return finite(col.cast("double"))
    bare = F.regexp_replace(col.cast("string"), r"(?U)[,\s\x1c-\x1f\x{a0}£$€%]", "")
    return finite(F.when(bare.rlike(_NUMBER), bare.try_cast("double")))


def clean_url(col: Column) -> Column:
    """Trimmed url; missing and junk values become the empty string."""
    url = F.coalesce(strip_text(col.cast("string")), F.lit(""))
    return F.when(is_junk(url), "").otherwise(url)


def finite(col: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.abs(col) < F.lit(float("inf")), col)


def json_safe(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by null in every floating point column."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *(
            finite(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, floats)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def round_or_null(col: Column, digits: int = 4) -> Column:
    """Rounded number; null when the value is no finite number."""
    return F.round(finite(col.try_cast("double")), digits)


def title_case(col: Column) -> Column:
    """Capital letter at the start of each run of letters, lower case elsewhere."""
    runs = F.split(F.lower(col), r"(?<!\p{L})(?=\p{L})")
    by_run = F.array_join(
        F.transform(
            runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.substr(run, F.lit(2)))
        ),
        "",
    )
    # In text of ASCII letters and spaces only, the runs are the words.
    return F.when(F.translate(col, ascii_letters + " ", "") == "", F.initcap(col)).otherwise(by_run)


def word_list(words: Iterable[str]) -> Column:
    """Constant array of words, given to the optimizer as one literal."""
    words = list(words)
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def formula_guard(col: Column) -> Column:
    """Prefix cells a spreadsheet would run as a formula."""
    return F.when(col.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)
