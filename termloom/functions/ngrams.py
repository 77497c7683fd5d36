"""N-gram lists as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(col: Column) -> Column:
    """Words of two or more word characters."""
    return F.regexp_extract_all(col, F.lit(r"\b\w\w+\b"), F.lit(0))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once per row, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def token_ngrams(tokens: Column, low: int, high: int) -> Column:
    """Runs of ``low`` to ``high`` neighbouring tokens joined by spaces."""

    def of_tokens(words: Column) -> Column:
        def runs_of(n: int) -> Column:
            starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1))
            grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
            return F.coalesce(grams, F.array().cast("array<string>"))

        return F.concat(*(words if n == 1 else runs_of(n) for n in range(low, high + 1)))

    return _let(tokens, of_tokens)


def word_ngrams(col: Column, low: int = 1, high: int = 2) -> Column:
    return token_ngrams(word_tokens(col), low, high)


def char_wb_ngrams(col: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside each word, the word padded with a space on both sides.

    A padded word shorter than ``n`` is given once, whole.
    """

    def of_word(padded: Column, length: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(low), F.least(F.lit(high), F.greatest(F.lit(low), length))),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.lit(1), length - n + 1)),
                    lambda i: F.substr(padded, i, n),
                ),
            )
        )

    words = F.filter(F.split(col, r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: of_word(p, F.length(p))))
