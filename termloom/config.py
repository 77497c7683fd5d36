"""Run settings and the fixed word lists and patterns the results depend on."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

# --------------------------------------------------------------------------
# Results are only right if these stay exactly as they are.
# --------------------------------------------------------------------------

# Cell texts that mean "no value".
JUNK_STRINGS = ["", "nan", "none", "null", "n/a", "na", "-", "--"]

# Role -> accepted header spellings, first match wins.
COLUMN_ALIASES = {
    "keyword": [
        "keyword", "keywords", "query", "queries", "top queries", "search term",
        "search query", "search terms", "term", "kw",
    ],
    "volume": [
        "volume", "search volume", "sv", "monthly volume", "monthly searches",
        "avg. monthly searches", "avg monthly searches", "impressions",
    ],
    "difficulty": [
        "difficulty", "kd", "kd%", "keyword difficulty", "seo difficulty",
        "difficulty%", "competition",
    ],
    "position": [
        "position", "current position", "rank", "ranking", "pos",
        "avg position", "avg. position", "average position", "serp position",
    ],
    "url": [
        "url", "current url", "page", "landing page", "top page", "ranking url",
        "page url", "final url",
    ],
}

# Intent -> words that signal it (regular expressions, matched as whole words).
COMMERCIAL_WORDS = ["best", "top", "compare", "comparison", "review", "alternatives?", "vs"]
TRANSACTIONAL_WORDS = [
    "buy", "price", "cost", "pricing", "quote", "demo", "trial", "deal", "discount",
]
NAVIGATIONAL_WORDS = ["login", "sign in", "official", "docs", "homepage"]

# Modifier group -> words, in the order the groups are joined.
MODIFIER_WORDS = {
    "best": ["best", "top"],
    "compare": ["vs", "versus", "compare", "comparison"],
    "review": ["review", "reviews"],
    "alternatives": ["alternatives?"],
    "pricing": ["pricing", "price", "cost"],
    "learn": ["how", "guide", "tutorial"],
}

# Words that never belong to a topic root.
TOPIC_STOP_WORDS = [
    "best", "top", "free", "review", "reviews", "vs", "versus", "compare", "comparison",
    "pricing", "price", "cost", "how", "guide", "tutorial", "what", "is", "to", "for",
    "the", "a", "an", "and", "of", "in", "on", "use", "choose",
]

# English stop words that labels leave out: those of Spark ML without an apostrophe.
LABEL_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "cannot", "could", "ought", "would",
]

# Column order of the two exports.
ROW_COLUMNS = [
    "keyword", "normalized_keyword", "cluster_id", "canonical_keyword", "topic_label",
    "intent", "page_type", "is_clustered", "cluster_quality", "opportunity_score",
    "volume", "difficulty", "position", "url",
]
CLUSTER_COLUMNS = [
    "cluster_id", "cluster_slug", "canonical_keyword", "topic_label", "intent", "page_type",
    "is_clustered", "keyword_count", "total_volume", "avg_difficulty", "avg_rank",
    "cluster_quality", "opportunity_score", "keywords", "urls",
]

# The cluster table itself; its member lists are a table of their own, in parts.
CLUSTER_FACTS = CLUSTER_COLUMNS[:-2]

# First bytes of workbook files.
XLSX_MAGIC = "504B0304"
XLS_MAGIC = "D0CF11E0A1B11AE1"

# The defaults of Settings are fixed values too: sizes of features, graph weights and thresholds.
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Everything a run depends on besides its input. Plain data, so it can be hashed."""

    # Requested column per role; None or an absent name falls back to the aliases.
    keyword_column: str | None = "keyword"
    volume_column: str | None = "volume"
    difficulty_column: str | None = "difficulty"
    position_column: str | None = "position"
    url_column: str | None = "url"

    # Features.
    word_ngrams: tuple[int, int] = (1, 2)
    char_ngrams: tuple[int, int] = (3, 5)
    max_word_features: int = 20_000
    max_char_features: int = 30_000
    min_df: int = 1  # terms in fewer rows are left out
    precision: str = "double"  # of embeddings: float or double
    svd_components: int = 128
    svd_oversampling: int = 10
    svd_power_passes: int = 5  # at most
    svd_tolerance: float = 1e-8  # residual of a direction, as part of the largest squared value
    seed: int = 42

    # Graph.
    neighbor_k: int = 15
    semantic_weight: float = 0.6
    lexical_weight: float = 0.4
    similarity_threshold: float = 0.30

    # Clusters.
    min_cluster_size: int = 2
    split_on_intent: bool = True
    split_on_modifiers: bool = False
    rank_ceiling: int = 20

    # Rules.
    branded_terms: tuple[str, ...] = ()
    commercial_words: tuple[str, ...] = tuple(COMMERCIAL_WORDS)
    transactional_words: tuple[str, ...] = tuple(TRANSACTIONAL_WORDS)
    navigational_words: tuple[str, ...] = tuple(NAVIGATIONAL_WORDS)
    label_stop_words: tuple[str, ...] = tuple(LABEL_STOP_WORDS)

    def requested_columns(self) -> dict[str, str | None]:
        return {
            "keyword": self.keyword_column,
            "volume": self.volume_column,
            "difficulty": self.difficulty_column,
            "position": self.position_column,
            "url": self.url_column,
        }

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)


DEFAULTS = Settings()
