"""Rule tags on normalized keywords, all as JVM expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, MODIFIER_WORDS, TOPIC_STOP_WORDS, Settings
from .text import normalize_text, word_list


def has_word(col: Column, words: Iterable[str]) -> Column:
    """True where any of the words (regular expressions) occurs as a whole word."""
    words = list(words)
    if not words:
        return F.lit(False)
    return col.rlike(r"\b(?:" + "|".join(words) + r")\b")


def tag_intent(col: Column, settings: Settings = DEFAULTS) -> Column:
    """Strongest intent: transactional, commercial, navigational, else informational."""
    return (
        F.when(has_word(col, settings.transactional_words), "transactional")
        .when(has_word(col, settings.commercial_words), "commercial")
        .when(has_word(col, settings.navigational_words), "navigational")
        .otherwise("informational")
    )


def tag_modifiers(col: Column) -> Column:
    """Names of all modifier groups present joined with ``+``, or ``core``."""
    present = [F.when(has_word(col, words), name) for name, words in MODIFIER_WORDS.items()]
    return F.coalesce(F.nullif(F.concat_ws("+", *present), F.lit("")), F.lit("core"))


def tag_page_type(col: Column, intent: Column) -> Column:
    """Kind of page that answers the keyword."""
    return (
        F.when(intent == "transactional", "money-page")
        .when(intent == "commercial", "comparison")
        .when(has_word(col, MODIFIER_WORDS["learn"]), "guide")
        .otherwise("article")
    )


def tag_brand(col: Column, terms: Iterable[str]) -> Column:
    """True where a (normalized) branded term occurs anywhere, also inside a word."""
    found = F.lit(False)
    for term in terms:
        plain = normalize_text(F.lit(term))
        found = found | ((plain != "") & F.contains(col, plain))
    return found


def topic_root(col: Column) -> Column:
    """First four words that are no stop words; the whole keyword when none is left."""
    stop = word_list(TOPIC_STOP_WORDS)
    words = F.filter(F.split(col, " "), lambda w: ~F.array_contains(stop, w))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 4), " ")).otherwise(col)


def add_tags(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add intent, modifier_group, page_type, is_brand and topic_root."""
    kw = F.col("normalized_keyword")
    return (
        df.withColumn("intent", tag_intent(kw, settings))
        .withColumn("modifier_group", tag_modifiers(kw))
        .withColumn("page_type", tag_page_type(kw, F.col("intent")))
        .withColumn("is_brand", tag_brand(kw, settings.branded_terms))
        .withColumn("topic_root", topic_root(kw))
    )
