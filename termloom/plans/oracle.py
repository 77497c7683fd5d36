"""The registered queries in plain SQL, for checking them on another engine.

``CTES`` are named steps; a query lists the steps it needs by naming them, and ``build`` puts the
needed ones in front in the right order.
"""

from __future__ import annotations

import json
import re

from ..config import Settings

# The rules' word lists, which results are only right with, written out here so that
# the SQL does not follow the library's.
JUNK_STRINGS = [
    "", "nan", "none", "null", "n/a", "na", "-", "--",
]
COMMERCIAL_WORDS = [
    "best", "top", "compare", "comparison", "review", "alternatives?", "vs",
]
TRANSACTIONAL_WORDS = [
    "buy", "price", "cost", "pricing", "quote", "demo", "trial", "deal", "discount",
]
NAVIGATIONAL_WORDS = [
    "login", "sign in", "official", "docs", "homepage",
]
TOPIC_STOP_WORDS = [
    "best", "top", "free", "review", "reviews", "vs", "versus", "compare", "comparison",
    "pricing", "price", "cost", "how", "guide", "tutorial", "what", "is", "to", "for", "the",
    "a", "an", "and", "of", "in", "on", "use", "choose",
]
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
MODIFIER_WORDS = {
    "best": [
        "best", "top",
    ],
    "compare": [
        "vs", "versus", "compare", "comparison",
    ],
    "review": [
        "review", "reviews",
    ],
    "alternatives": [
        "alternatives?",
    ],
    "pricing": [
        "pricing", "price", "cost",
    ],
    "learn": [
        "how", "guide", "tutorial",
    ],
}


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def word(col: str, words) -> str:
    return rf"regexp_matches({col}, '\b(?:{'|'.join(words)})\b')"


def fold(col: str) -> str:
    return rf"regexp_replace(strip_accents({col}), '[^\x00-\x7F]', '', 'g')"


def normal(col: str) -> str:
    spaced = f"replace(lower({fold(col)}), '&', ' and ')"
    return rf"trim(regexp_replace({spaced}, '[^a-z0-9/\-]+', ' ', 'g'))"


SPACE = r"\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def number(col: str) -> str:
    bare = f"regexp_replace({col}, '[,{SPACE}£$€%]', '', 'g')"
    shape = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return (
        f"CASE WHEN regexp_full_match({bare}, '{shape}') THEN try_cast({bare} AS DOUBLE) END"
    )


def title(col: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, length({col}) + 1), lambda i: CASE "
        f"WHEN i > 1 AND regexp_matches(substr({col}, i - 1, 1), '[a-z]') "
        f"THEN substr({col}, i, 1) ELSE upper(substr({col}, i, 1)) END), '')"
    )


def slug(col: str) -> str:
    dashed = f"trim(regexp_replace({col}, '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif(substr({dashed}, 1, 80), ''), 'cluster')"


def intent(kw: str) -> str:
    return (
        f"CASE WHEN {word(kw, TRANSACTIONAL_WORDS)} THEN 'transactional' "
        f"WHEN {word(kw, COMMERCIAL_WORDS)} THEN 'commercial' "
        f"WHEN {word(kw, NAVIGATIONAL_WORDS)} THEN 'navigational' ELSE 'informational' END"
    )


def modifiers(kw: str) -> str:
    flags = ", ".join(
        f"CASE WHEN {word(kw, words)} THEN '{name}' END" for name, words in MODIFIER_WORDS.items()
    )
    return f"coalesce(nullif(concat_ws('+', {flags}), ''), 'core')"


def page_type(kw: str, intent_col: str) -> str:
    return (
        f"CASE WHEN {intent_col} = 'transactional' THEN 'money-page' "
        f"WHEN {intent_col} = 'commercial' THEN 'comparison' "
        f"WHEN {word(kw, MODIFIER_WORDS['learn'])} THEN 'guide' ELSE 'article' END"
    )


def topic_root(kw: str) -> str:
    words = (
        f"list_filter(string_split({kw}, ' '), lambda w: NOT list_contains([{listed(TOPIC_STOP_WORDS)}], w))"
    )
    return (
        f"CASE WHEN len({words}) > 0 THEN array_to_string(({words})[1:4], ' ') ELSE {kw} END"
    )


def affixed(text: str, key: str = "p_partkey") -> str:
    return (
        f"CASE {key} % 9 WHEN 0 THEN 'best ' || {text} WHEN 1 THEN 'How to use ' || {text} "
        f"WHEN 2 THEN 'buy ' || {text} WHEN 3 THEN 'cheap ' || {text} "
        f"WHEN 4 THEN {text} || ' price' WHEN 5 THEN {text} || ' review' "
        f"WHEN 6 THEN {text} || ' vs old' WHEN 7 THEN {text} || ' login' ELSE {text} END"
    )


def part_keywords(text: str) -> str:
    return f"""
      SELECT p_partkey AS row_ord, {affixed(text)} AS keyword, volume,
             CAST(p_size AS DOUBLE) AS difficulty, line * 5 AS position,
             'https://shop.example/' || replace(lower(p_brand), '#', '-') AS url
      FROM part LEFT JOIN (
        SELECT l_partkey, sum(l_quantity) AS volume, avg(l_linenumber) AS line
        FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey"""


def grams(tokens: str) -> str:
    pairs = f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"
    return f"list_concat({tokens}, {pairs})"


TOKENS = r"regexp_extract_all({kw}, '\b\w\w+\b')"
CHAR_GRAMS = """
  list_filter(flatten(list_transform(
    list_filter(string_split({kw}, ' '), lambda w: w <> ''), lambda w:
      flatten(list_transform([3, 4, 5], lambda n:
        CASE WHEN n > length(w) + 2 THEN CAST([] AS VARCHAR[]) ELSE
          list_transform(range(1, length(w) + 4 - n), lambda i: substr(' ' || w || ' ', i, n))
        END)))), lambda g: g IS NOT NULL)"""


def tfidf(cap_word: int, cap_char: int) -> dict[str, str]:
    """Steps from ``prep`` to unit-length blocks and rows."""
    return {
        "t_all": f"""
        SELECT row_ord, 'word' AS block, unnest({grams('tok')}) AS term FROM
          (SELECT row_ord, {TOKENS.format(kw='normalized_keyword')} AS tok FROM prep)
        UNION ALL
        SELECT row_ord, 'char', unnest({CHAR_GRAMS.format(kw='normalized_keyword')}) FROM prep""",
        "t_n": "SELECT row_ord, block, term, count(*) AS tf FROM t_all GROUP BY ALL",
        "t_vocab": f"""
        SELECT block, term, sum(tf) AS tf, count(*) AS df FROM t_n GROUP BY block, term
        QUALIFY row_number() OVER (PARTITION BY block ORDER BY sum(tf) DESC, term)
          <= CASE block WHEN 'word' THEN {cap_word} ELSE {cap_char} END""",
        "t_w": """
        SELECT row_ord, block, term,
          t_n.tf * (ln((1 + (SELECT count(*) FROM prep)) / (1 + df)) + 1) AS w
        FROM t_n JOIN t_vocab USING (block, term)""",
        "t_unit": """
        SELECT row_ord, block, term,
          w / sqrt(sum(w * w) OVER (PARTITION BY row_ord, block)) AS weight FROM t_w""",
        "t_row": """
        SELECT row_ord, block, term,
          weight / sqrt(sum(weight * weight) OVER (PARTITION BY row_ord)) AS weight FROM t_unit""",
    }


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


CTES: dict[str, str] = {
    "kw_parts": part_keywords("(p_name || ' ' || lower(p_type))"),
    "kw_catalog": part_keywords("(p_name || ' ' || lower(p_type) || ' ' || p_brand)"),
    "kw_phrases": r"""
      SELECT doc_id * 1000000 + place AS row_ord, pieces[place + 1] AS keyword, source AS url
      FROM (SELECT doc_id, source, pieces, unnest(range(len(pieces))) AS place
            FROM (SELECT doc_id, source, string_split_regex(text, '[.!?\n]') AS pieces
                  FROM documents))""",
    "kw_pages": """
      SELECT page_id AS row_ord, regexp_extract(html, '<title>([^<]*)</title>', 1) AS keyword, url
      FROM pages""",
    "kw_messy": r"""
      SELECT l_orderkey, l_linenumber,
        CASE l_orderkey % 5 WHEN 0 THEN grouped WHEN 1 THEN '$' || grouped
          WHEN 2 THEN ' £ ' || replace(grouped, ',', ' ') WHEN 3 THEN price || ' €'
          ELSE l_returnflag || price END AS volume,
        CASE l_linenumber % 5 WHEN 0 THEN discount || '%' WHEN 1 THEN 'n/a' WHEN 2 THEN '-'
          WHEN 3 THEN ' ' ELSE discount || 'd' END AS difficulty
      FROM (SELECT l_orderkey, l_linenumber, l_returnflag,
              printf('%.2f', l_extendedprice) AS price, format('{:,.2f}', l_extendedprice) AS grouped,
              printf('%.2f', l_discount) AS discount FROM lineitem)""",
    "clean": f"""
      SELECT row_ord, keyword, {normal('keyword')} AS normalized_keyword, volume, difficulty,
        position, url FROM kw_parts""",
}
CTES["dedup_urls"] = """
  SELECT normalized_keyword, string_agg(url, ' | ' ORDER BY o) AS url
  FROM (SELECT normalized_keyword, url, min(row_ord) AS o FROM clean WHERE url <> ''
        GROUP BY normalized_keyword, url) GROUP BY normalized_keyword"""
CTES["dedup"] = """
  SELECT row_ord, keyword, normalized_keyword, volume, difficulty, position, url FROM (
    SELECT normalized_keyword, min(row_ord) AS row_ord, arg_min(keyword, row_ord) AS keyword,
      max(volume) AS volume, avg(difficulty) AS difficulty, avg(position) AS position
    FROM clean GROUP BY normalized_keyword) JOIN dedup_urls USING (normalized_keyword)"""
CTES["prep"] = f"""
  SELECT *, {page_type('normalized_keyword', 'intent')} AS page_type FROM (
    SELECT *, {intent('normalized_keyword')} AS intent,
      {modifiers('normalized_keyword')} AS modifier_group,
      {topic_root('normalized_keyword')} AS topic_root FROM dedup)"""
CTES["topics"] = """
  SELECT *, dense_rank() OVER (ORDER BY first_ord) - 1 AS cluster_id,
    count(*) OVER (PARTITION BY intent, topic_root) AS n
  FROM (SELECT *, min(row_ord) OVER (PARTITION BY intent, topic_root) AS first_ord FROM prep)"""
CTES["numbers"] = """
  SELECT cluster_id, count(*) AS keyword_count, coalesce(sum(volume), 0.0) AS total_volume,
    avg(difficulty) AS d, avg(position) AS p,
    first(keyword ORDER BY score DESC NULLS LAST, coalesce(volume, 0) DESC, row_ord)
      AS canonical_keyword,
    first(normalized_keyword ORDER BY score DESC NULLS LAST, coalesce(volume, 0) DESC, row_ord)
      AS canonical_normalized
  FROM (SELECT *, (ln(1 + coalesce(volume, 0)) + 21
          - greatest(least(coalesce(position, 100), 100), 1)) / (1 + coalesce(difficulty, 50))
          AS score FROM topics) GROUP BY cluster_id"""
CTES["opp"] = """
  SELECT cluster_id, round(ln(1 + total_volume) * (1 + greatest(0, 20 - coalesce(p, 50)))
    / (1 + greatest(coalesce(d, 50), 0)), 4) AS opportunity_score FROM numbers"""


def mode(source: str, col: str) -> str:
    return f"""
      SELECT cluster_id, first(v ORDER BY c DESC, v) AS value, max(c) / sum(c) AS share
      FROM (SELECT cluster_id, {col} AS v, count(*) AS c FROM {source} GROUP BY cluster_id, {col})
      GROUP BY cluster_id"""


for _source in ("topics", "words", "vtags"):
    for _col in ("intent", "page_type", "modifier_group"):
        CTES[f"{_source}_{_col}"] = mode(_source, _col)
CTES["words"] = """
  SELECT *, component AS cluster_id FROM (
    SELECT *, min(row_ord) OVER (PARTITION BY string_split(topic_root, ' ')[1]) AS component
    FROM prep)"""
def without_stops(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: NOT list_contains([{listed(LABEL_STOP_WORDS)}], w))"


def label_steps() -> dict[str, str]:
    tokens = without_stops(TOKENS.format(kw="normalized_keyword"))
    return {
        "l_n": f"""
        SELECT cluster_id, n, row_ord, term, count(*) AS tf FROM (
          SELECT cluster_id, n, row_ord, unnest({grams('tok')}) AS term FROM (
            SELECT cluster_id, n, row_ord, {tokens} AS tok FROM topics WHERE n > 1))
        GROUP BY ALL""",
        "l_w": """
        SELECT cluster_id, row_ord, term, tf * (ln((1 + n) /
          (1 + count(*) OVER (PARTITION BY cluster_id, term))) + 1) AS w FROM l_n""",
        "l_top": """
        SELECT cluster_id, term, round(sum(w), 9) AS weight FROM (
          SELECT cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_ord)) AS w FROM l_w)
        GROUP BY cluster_id, term""",
        "l_rank": """
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term DESC)
          AS rank FROM l_top QUALIFY rank <= 3""",
        "labelled": f"""
        SELECT cluster_id, string_agg({title('term')}, ' / ' ORDER BY rank) AS label
        FROM l_rank GROUP BY cluster_id""",
    }


def single_label(col: str) -> str:
    words = without_stops(f"string_split({col}, ' ')")
    joined = f"array_to_string(({words})[1:4], ' ')"
    return f"CASE WHEN len({words}) > 0 THEN {title(joined)} END"


CTES["lists"] = """
  SELECT cluster_id, string_agg(keyword, '|' ORDER BY row_ord) AS keywords,
    (SELECT coalesce(string_agg(url, '|' ORDER BY o), '') FROM (
       SELECT url, min(row_ord) AS o FROM topics AS u
       WHERE u.cluster_id = topics.cluster_id AND url <> '' GROUP BY url)) AS urls
  FROM topics GROUP BY cluster_id"""
CTES["vec"] = "SELECT vec_id AS row_ord, embedding FROM embeddings"
CTES["sims"] = f"""
  SELECT a.row_ord AS src, b.row_ord AS dst, round({cosine('a.embedding', 'b.embedding')}, 9) AS sim
  FROM vec AS a JOIN vec AS b ON a.row_ord <> b.row_ord"""
CTES["near"] = """
  SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank
  FROM sims QUALIFY rank <= 15"""
CTES["pairs"] = """
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst,
    max(greatest(least(sim, 1.0), 0.0)) AS sem FROM near GROUP BY 1, 2"""
CTES["vedges"] = "SELECT src, dst, sem AS sim FROM pairs WHERE round(sem, 9) >= 0.35"


def build(body: str, *steps: dict[str, str]) -> str:
    """``body`` preceded by the steps it needs, dependencies first. Later steps replace earlier."""
    known = dict(CTES)
    for more in steps:
        known |= more
    done: dict[str, str] = {}

    def need(sql: str) -> None:
        for name in known:
            if name not in done and re.search(rf"\b{name}\b", sql):
                done[name] = ""  # a recursive step names itself
                need(known[name])
                del done[name]  # so that it comes after what it needs
                done[name] = f"{name} AS ({known[name]})"

    need(body)
    recursive = "RECURSIVE " if "reach" in done else ""
    return f"WITH {recursive}{', '.join(done.values())} {body}" if done else body


CTES["links"] = "SELECT src AS a, dst AS b FROM vedges UNION ALL SELECT dst, src FROM vedges"
CTES["reach"] = """
  SELECT row_ord AS node, row_ord AS root FROM vec
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
  WHERE reach.root < links.b"""
CTES["comp"] = "SELECT node AS row_ord, min(root) AS component FROM reach GROUP BY node"
CTES["inside"] = """
  SELECT c.component AS cluster_id, sum(sim) AS linked FROM vedges
  JOIN comp AS c ON c.row_ord = src JOIN comp AS d ON d.row_ord = dst
  WHERE c.component = d.component GROUP BY c.component"""
CTES["sized"] = "SELECT component AS cluster_id, count(*) AS n FROM comp GROUP BY component"
# Sum of edge weights inside each topic cluster; there is no graph there.
CTES["linked"] = "SELECT 0 AS cluster_id, 0.0 AS linked WHERE false"
CTES["dots"] = """
  SELECT src, dst, least(greatest(sum(a.weight * b.weight), 0), 1) AS lex FROM to_score
  JOIN t_row AS a ON a.row_ord = src
  JOIN t_row AS b ON b.row_ord = dst AND b.block = a.block AND b.term = a.term
  GROUP BY src, dst"""
CTES["split_groups"] = """
  SELECT component, intent, topic_root, min(row_ord) AS first_ord,
    min(row_ord) = min(min(row_ord)) OVER (PARTITION BY component) AS keeper
  FROM words GROUP BY component, intent, topic_root"""


def post_split(source: str, groups: str, keys: str) -> str:
    return f"""
      SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM (
        SELECT {source}.*, CAST(CASE WHEN keeper THEN c
          ELSE (SELECT count(DISTINCT component) FROM {groups}) + later END AS BIGINT) AS cluster_id
        FROM {source} JOIN (
          SELECT *, dense_rank() OVER (ORDER BY component) - 1 AS c,
            sum(CASE WHEN keeper THEN 0 ELSE 1 END) OVER (ORDER BY component, first_ord) - 1
            AS later FROM {groups}) USING (component, {keys}))"""


# The whole run on all catalog keywords, with embeddings that come round in turn.
EXTERNAL = {
    "kw_parts": part_keywords("(p_name || ' ' || lower(p_type) || ' ' || p_brand)"),
    "vec": """
      SELECT row_ord, embedding FROM prep
      JOIN embeddings ON vec_id = row_ord % (SELECT count(*) FROM embeddings)""",
    **tfidf(20_000, 30_000),
    "to_score": "SELECT src, dst FROM pairs",
    "vedges": """
      SELECT src, dst, 0.6 * sem + 0.4 * coalesce(lex, 0) AS sim
      FROM pairs LEFT JOIN dots USING (src, dst)
      WHERE round(0.6 * sem + 0.4 * coalesce(lex, 0), 9) >= 0.3""",
    "in_comp": "SELECT prep.*, component FROM prep JOIN comp USING (row_ord)",
    "comp_groups": """
      SELECT component, intent, topic_root, min(row_ord) AS first_ord,
        min(row_ord) = min(min(row_ord)) OVER (PARTITION BY component) AS keeper
      FROM in_comp GROUP BY component, intent, topic_root""",
    "topics": post_split("in_comp", "comp_groups", "intent, topic_root"),
    "linked": """
      SELECT a.cluster_id, sum(sim) AS linked FROM vedges
      JOIN topics AS a ON a.row_ord = src JOIN topics AS b ON b.row_ord = dst
      WHERE a.cluster_id = b.cluster_id GROUP BY a.cluster_id""",
}
COHESION = "coalesce(linked / nullif({n} * ({n} - 1) / 2, 0), 0)"


def six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def oracle_queries() -> dict[str, str]:
    clusters = f"""
      SELECT cluster_id, {slug('canonical_normalized')} AS cluster_slug, canonical_keyword,
        coalesce(CASE WHEN keyword_count = 1 THEN {single_label('canonical_normalized')}
          ELSE label END, canonical_keyword) AS topic_label,
        topics_intent.value AS intent, topics_page_type.value AS page_type,
        keyword_count >= 2 AS is_clustered, keyword_count, total_volume,
        round(d, 4) AS avg_difficulty, round(p, 4) AS avg_rank,
        CASE WHEN keyword_count = 1 THEN 0.55 ELSE
          round(0.5 * {COHESION.format(n='keyword_count')} + 0.3 * topics_intent.share
            + 0.2 * topics_modifier_group.share, 4) END
          AS cluster_quality,
        opportunity_score
      FROM numbers JOIN opp USING (cluster_id) JOIN topics_intent USING (cluster_id)
      JOIN topics_page_type USING (cluster_id) JOIN topics_modifier_group USING (cluster_id)
      LEFT JOIN labelled USING (cluster_id) LEFT JOIN linked USING (cluster_id)"""
    steps = (label_steps(), {"clusters": clusters})
    summary = """
      SELECT CAST(sum(keyword_count) AS BIGINT) AS keywords, count(*) AS clusters,
        CAST(coalesce(sum(keyword_count) FILTER (is_clustered), 0) AS BIGINT) AS clustered_keywords,
        CAST(coalesce(sum(keyword_count) FILTER (NOT is_clustered), 0) AS BIGINT)
          AS unclustered_keywords,
        round(avg(cluster_quality), 4) AS avg_cluster_quality,
        first(cluster_id ORDER BY opportunity_score DESC, total_volume DESC, cluster_quality DESC,
          cluster_id) AS top_cluster_id,
        first(canonical_keyword ORDER BY opportunity_score DESC, total_volume DESC,
          cluster_quality DESC, cluster_id) AS top_keyword
      FROM clusters"""
    attached = """
      SELECT t.row_ord, t.keyword, t.normalized_keyword, t.volume, t.difficulty, t.position, t.url,
        c.* FROM topics AS t JOIN clusters AS c USING (cluster_id)"""
    char_stats = f"""
      SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM (
        SELECT row_ord, term, count(*) AS tf FROM (
          SELECT row_ord, unnest({CHAR_GRAMS.format(kw='normalized_keyword')}) AS term FROM prep)
        GROUP BY ALL) GROUP BY term"""
    word_stats = f"""
      SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM (
        SELECT row_ord, term, count(*) AS tf FROM (
          SELECT row_ord, unnest({grams('tok')}) AS term FROM (
            SELECT row_ord, {TOKENS.format(kw='normalized_keyword')} AS tok FROM prep))
        GROUP BY ALL) GROUP BY term"""
    full = tfidf(20_000, 30_000)
    q: dict[str, str] = {}
    q["s01_profile_files"] = """
      SELECT 'text' AS kind, d AS delimiter, CAST(NULL AS VARCHAR) AS error_code,
        (SELECT count(*) > 0 FROM part) AS found FROM (VALUES (','), (chr(9))) AS t(d)"""
    q["s02_detect_encoding"] = """
      SELECT * FROM (VALUES ('utf-8', false), ('utf-16', true)) AS t(encoding, multiline)"""
    q["s03_sniff_delimiter"] = """
      SELECT CAST(5 AS BIGINT) AS columns, d AS delimiter FROM (VALUES (','), (chr(9))) AS t(d)"""
    q["s04_read_keyword_exports"] = build("""
      SELECT row_ord AS id, keyword, CAST(CAST(volume AS BIGINT) AS VARCHAR) AS volume,
        CAST(CAST(difficulty AS BIGINT) AS VARCHAR) AS kd, url FROM kw_parts""")
    q["s05_clean_headers"] = build('SELECT row_ord, keyword AS "Keyword" FROM kw_parts')
    q["s06_resolve_columns"] = build(
        f"SELECT row_ord, keyword, {six('volume', 'difficulty', 'position')}, url FROM kw_parts"
    )
    q["s07_preview"] = build("""
      SELECT row_ord, keyword, (SELECT count(*) FROM kw_parts) AS row_count
      FROM kw_parts ORDER BY row_ord LIMIT 20""")
    usable = (
        f"lower({strip('keyword')}) NOT IN ({listed(JUNK_STRINGS)}) "
        f"AND {normal(strip('keyword'))} <> ''"
    )
    q["s08_input_checks"] = build(f"""
      SELECT 'has_rows' AS "check", 'NO_ROWS' AS code, CAST(0 AS BIGINT) AS failed_rows,
        count(*) > 0 AS passed FROM kw_phrases
      UNION ALL
      SELECT 'has_keywords', 'NO_KEYWORDS', count(*) - count(*) FILTER ({usable}),
        count(*) FILTER ({usable}) > 0 FROM kw_phrases
      UNION ALL SELECT 'has_keyword_column', 'KEYWORD_COLUMN_NOT_FOUND', 0, true
      UNION ALL SELECT 'files_parse', 'UNPARSEABLE_FILE', 0, true""")

    q["p01_normalize_text"] = build(
        f"SELECT row_ord, {normal('keyword')} AS normalized_keyword FROM kw_phrases"
    )
    q["p02_stable_slug"] = build(
        f"SELECT row_ord, {slug(normal('keyword'))} AS slug FROM kw_phrases"
    )
    q["p03_drop_missing_keywords"] = build(
        "SELECT row_ord, keyword FROM kw_phrases WHERE nullif(keyword, '') IS NOT NULL"
    )
    q["p04_drop_junk_keywords"] = build(f"""
      SELECT row_ord, {strip('keyword')} AS keyword FROM kw_phrases
      WHERE lower({strip('keyword')}) NOT IN ({listed(JUNK_STRINGS)})""")
    q["p05_drop_empty_keywords"] = build(f"""
      SELECT row_ord, {normal('keyword')} AS normalized_keyword FROM kw_phrases
      WHERE {normal('keyword')} <> ''""")
    q["p06_clean_numeric"] = build(f"""
      SELECT l_orderkey, l_linenumber, volume, round({number('volume')}, 6) AS volume_number,
        round({number('difficulty')}, 6) AS difficulty_number FROM kw_messy""")
    q["p07_clean_url"] = build(
        "SELECT row_ord, CASE WHEN row_ord % 4 < 2 THEN '' ELSE trim(url) END AS url FROM kw_pages"
    )
    kw = "normalized_keyword"
    q["p08_tag_intent"] = build(f"SELECT row_ord, {intent(kw)} AS intent FROM clean")
    q["p09_tag_modifiers"] = build(f"SELECT row_ord, {modifiers(kw)} AS modifier_group FROM clean")
    q["p10_tag_page_type"] = build(f"""
      SELECT row_ord, {page_type(kw, 'intent')} AS page_type
      FROM (SELECT *, {intent(kw)} AS intent FROM clean)""")
    q["p11_tag_brand"] = build(f"""
      SELECT row_ord, contains(k, 'gear') OR contains(k, 'bolt') OR contains(k, 'brand 1')
        AS is_brand FROM (SELECT row_ord, {normal('keyword')} AS k FROM kw_catalog)""")
    q["p12_topic_root"] = build(f"""
      SELECT row_ord, {topic_root('k')} AS topic_root FROM (
        SELECT row_ord, {normal(strip('keyword'))} AS k FROM kw_phrases WHERE {usable})""")
    q["p13_json_safe"] = """
      SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2
        THEN round(l_quantity / nullif(l_discount, 0), 6) END AS ratio FROM lineitem"""
    q["p14_round_or_null"] = build("""
      SELECT l_orderkey, l_linenumber, volume, round(try_cast(volume AS DOUBLE), 1) AS rounded
      FROM kw_messy""")
    q["p15_export_rows"] = build(
        f"""SELECT keyword, normalized_keyword, cluster_id, canonical_keyword, topic_label, intent,
          page_type, is_clustered, cluster_quality, opportunity_score,
          {six('volume', 'difficulty', 'position')}, url FROM ({attached})""", *steps)
    q["p16_export_clusters"] = build(
        "SELECT clusters.*, keywords, urls FROM clusters JOIN lists USING (cluster_id)", *steps
    )
    q["p17_title_case"] = build(f"""
      SELECT row_ord, {title('k')} AS title FROM (
        SELECT row_ord, {normal('keyword')} AS k FROM kw_phrases) WHERE k <> ''""")
    q["p18_cluster_records"] = build(
        """SELECT 'upload-1' AS upload_id, 'project-1' AS project_id,
          CAST(NULL AS VARCHAR) AS job_id, cluster_id AS cluster_index, cluster_slug, topic_label,
          canonical_keyword, intent, page_type, is_clustered, keyword_count, total_volume,
          avg_difficulty, avg_rank AS avg_position, opportunity_score,
          cluster_quality AS quality_score, 'Fair' AS quality_label, keywords, urls
        FROM clusters JOIN lists USING (cluster_id)""", *steps)

    tok = TOKENS.format(kw=kw)
    q["v01_word_ngrams"] = build(f"""
      SELECT row_ord, array_to_string({grams('tok')}, '|') AS grams
      FROM (SELECT row_ord, {tok} AS tok FROM clean)""")
    q["v02_char_wb_ngrams"] = build(f"""
      SELECT row_ord, array_to_string({CHAR_GRAMS.format(kw=kw)}, '|') AS grams FROM clean""")
    q["v03_cap_vocabulary"] = build(
        f"SELECT term, tf FROM ({char_stats}) ORDER BY tf DESC, term LIMIT 300"
    )
    q["v04_min_df"] = build(
        f"SELECT term, df FROM ({char_stats}) WHERE df >= 20 ORDER BY tf DESC, term LIMIT 30000"
    )
    q["v05_tfidf"] = build(
        "SELECT row_ord, block, term, round(weight, 6) AS weight FROM t_unit", full
    )
    q["v06_stack_blocks"] = build(
        """SELECT row_ord, block, count(*) AS terms, round(sum(weight), 6) AS weight
        FROM t_unit GROUP BY row_ord, block""", full)
    q["v07_unit_rows"] = build(
        """SELECT row_ord, block, term, round(weight / sqrt(sum(weight * weight)
          OVER (PARTITION BY row_ord)), 6) AS weight FROM t_unit""", full)
    # Checks the number of components and the unit length; tests compare the values.
    q["v08_svd_embed"] = build(
        """SELECT row_ord, least(128, (SELECT count(*) FROM prep) - 1,
          (SELECT count(*) FROM t_vocab) - 1) AS size, CAST(1.0 AS DOUBLE) AS length
        FROM prep""", full)
    q["v11_svd_cosines"] = build("""
      SELECT row_ord, round(coalesce(sum(t_row.weight * s.weight), 0), 5) AS cosines
      FROM prep LEFT JOIN t_row USING (row_ord) LEFT JOIN (
        SELECT block, term, sum(weight) AS weight FROM t_row GROUP BY block, term
      ) AS s USING (block, term) GROUP BY row_ord""", tfidf(60, 120))
    q["v09_embed_external"] = build(
        """SELECT row_ord, i AS place, round(CAST(embedding[i] AS DOUBLE), 5) + 0.0::DOUBLE AS value
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM vec)"""
    )
    q["v10_precision"] = build("""
      SELECT row_ord, 'array<float>' AS type, i AS place,
        round(CAST(embedding[i] AS DOUBLE), 5) + 0.0::DOUBLE AS value
      FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM vec)""")

    q["j01_knn_join"] = build("SELECT src, dst, rank, round(sim, 6) AS sim FROM near")
    whole = cosine("a.embedding", "b.embedding")
    q["j02_semantic_similarity"] = build(f"""
      SELECT src, dst, round(greatest(least({whole}, 1.0), 0.0), 6) AS sem FROM near
      JOIN vec AS a ON a.row_ord = src JOIN vec AS b ON b.row_ord = dst""")
    topic_pairs = """
      SELECT row_ord AS src, unnest([lead(row_ord, 1) OVER w, lead(row_ord, 2) OVER w]) AS dst
      FROM prep WINDOW w AS (PARTITION BY topic_root ORDER BY row_ord)"""
    q["j03_lexical_similarity"] = build(
        """SELECT src, dst, round(coalesce(lex, 0), 6) AS lex
        FROM to_score LEFT JOIN dots USING (src, dst) WHERE dst IS NOT NULL""",
        full, {"to_score": topic_pairs})
    q["j04_hybrid_edges"] = build("""
      SELECT src, dst, round(0.6 * sem + 0.4 * 0.25, 6) AS sim FROM pairs
      WHERE round(0.6 * sem + 0.4 * 0.25, 9) >= 0.3""")
    q["j05_symmetric_edges"] = build("SELECT src, dst, round(sem, 6) AS sim FROM pairs")
    q["j06_connected_components"] = build("SELECT row_ord, component FROM comp")
    q["j07_attach_clusters"] = build(
        f"""SELECT row_ord, cluster_id, canonical_keyword, intent, page_type, is_clustered,
          opportunity_score FROM ({attached})""", *steps)
    q["j08_surrogate_key_join"] = build(
        f"""SELECT sha256('upload-1/' || cluster_id) AS cluster_id, keyword,
          canonical_keyword = keyword AS is_canonical, is_clustered
        FROM ({attached})""", *steps)
    q["j09_vocabulary_join"] = build(
        "SELECT block, term, count(*) AS rows FROM t_unit GROUP BY block, term", full)

    q["a01_dedupe_keywords"] = build(f"""
      SELECT row_ord, keyword, normalized_keyword, {six('volume', 'difficulty', 'position')}, url
      FROM dedup""")
    q["a02_flag_clustered"] = build(
        "SELECT row_ord, cluster_id, n >= 3 AS is_clustered FROM topics"
    )
    finer = """
      SELECT component, intent, topic_root, modifier_group, min(row_ord) AS first_ord,
        min(row_ord) = min(min(row_ord)) OVER (PARTITION BY component) AS keeper
      FROM words GROUP BY component, intent, topic_root, modifier_group"""
    q["a03_post_split"] = build(
        "SELECT row_ord, cluster_id, n AS cluster_rows FROM divided",
        {
            "plain": "SELECT * EXCLUDE (cluster_id) FROM words",
            "finer": finer,
            "divided": post_split("plain", "finer", "intent, topic_root, modifier_group"),
        })
    q["a04_canonical_keyword"] = build("SELECT cluster_id, canonical_keyword FROM numbers")
    q["a05_topic_labels"] = build("SELECT cluster_id, label FROM labelled", label_steps())
    q["a06_single_labels"] = build(
        f"SELECT row_ord, coalesce({single_label(kw)}, keyword) AS topic_label FROM prep"
    )
    q["a07_cohesion"] = build(f"""
      SELECT cluster_id, n, round({COHESION.format(n='n')}, 6) AS cohesion
      FROM sized LEFT JOIN inside USING (cluster_id)""")
    q["a08_mode_shares"] = build("""
      SELECT cluster_id, round(topics_intent.share, 6) AS intent_share,
        round(topics_modifier_group.share, 6) AS modifier_share
      FROM topics_intent JOIN topics_modifier_group USING (cluster_id)""")
    fill = ", ".join(f"coalesce({c}, 'core') AS {c}" for c in ("intent", "page_type", "modifier_group"))
    q["a09_quality_score"] = build(
        f"""SELECT cluster_id, CASE WHEN n = 1 THEN 0.55 ELSE round(least(greatest(
            0.5 * {COHESION.format(n='n')} + 0.3 * i.share + 0.2 * m.share, 0), 1), 4) END
            AS cluster_quality
        FROM sized LEFT JOIN inside USING (cluster_id)
        JOIN ({mode('vt', 'intent')}) AS i USING (cluster_id)
        JOIN ({mode('vt', 'modifier_group')}) AS m USING (cluster_id)""",
        {"vt": f"""
          SELECT component AS cluster_id, {fill} FROM comp LEFT JOIN (
            SELECT row_ord, {intent(kw)} AS intent, '' AS page_type,
              {modifiers(kw)} AS modifier_group FROM clean) USING (row_ord)"""})
    q["a10_opportunity_score"] = build("SELECT cluster_id, opportunity_score FROM opp")
    q["a11_mode"] = build("""
      SELECT cluster_id, words_intent.value AS intent, words_page_type.value AS page_type
      FROM words_intent JOIN words_page_type USING (cluster_id)""")
    q["a12_totals_and_means"] = build("""
      SELECT cluster_id, keyword_count, round(total_volume, 6) AS total_volume,
        round(d, 4) AS avg_difficulty, round(p, 4) AS avg_rank FROM numbers""")
    q["a13_cluster_summary"] = build("SELECT * FROM clusters", *steps)
    q["a14_member_lists"] = build("SELECT cluster_id, keywords, urls FROM lists")
    q["a15_summary"] = build(summary, *steps)
    q["a16_term_statistics"] = build(char_stats)

    q["w01_input_ordinal"] = build("""
      SELECT row_ord, row_number() OVER (ORDER BY keyword, row_ord) - 1 AS place FROM kw_phrases""")
    q["w02_cluster_rows"] = build("""
      SELECT row_ord, count(*) OVER (PARTITION BY cluster_id) AS cluster_rows FROM words""")
    q["w03_first_seen_groups"] = build("SELECT * FROM split_groups")
    q["w04_top_neighbors"] = build("SELECT src, dst, rank FROM near WHERE rank <= 3")
    q["w05_top_terms"] = build(
        "SELECT cluster_id, term, rank, round(weight, 6) AS weight FROM l_rank", label_steps()
    )
    q["o01_first_appearance_order"] = build(
        "SELECT row_ord, normalized_keyword FROM dedup ORDER BY row_ord"
    )
    q["o02_row_order"] = build("""
      SELECT cluster_id, round(volume, 6) AS volume, row_ord FROM topics
      ORDER BY cluster_id, volume DESC NULLS LAST, row_ord""")
    ranked = "ORDER BY opportunity_score DESC, total_volume DESC, cluster_quality DESC, cluster_id"
    q["o03_cluster_order"] = build(
        f"""SELECT cluster_id, opportunity_score, round(total_volume, 6) AS total_volume,
          cluster_quality FROM clusters {ranked}""", *steps)
    q["o04_top_cluster"] = build(
        f"""SELECT cluster_id, canonical_keyword, opportunity_score FROM clusters {ranked}
        LIMIT 1""", *steps)
    q["o05_preview_head"] = build("SELECT row_ord, url FROM kw_pages ORDER BY row_ord LIMIT 20")
    q["o06_vocabulary_top_n"] = build(
        f"SELECT * FROM ({word_stats}) ORDER BY tf DESC, term LIMIT 100"
    )

    q["k01_write_export"] = build("""
      SELECT upload_id, count(*) AS rows, round(sum(volume), 6) AS volume
      FROM prep, (VALUES ('u1'), ('u2')) AS u(upload_id) GROUP BY upload_id""")
    q["k02_write_json"] = build(
        """SELECT cluster_id, canonical_keyword, round(total_volume, 6) AS total_volume,
          round(p, 4) AS avg_rank, CAST(13 AS BIGINT) AS keys FROM numbers""")
    q["k03_persist_results"] = build("""
      SELECT cluster_id AS cluster_index, keyword_count, keyword_count AS stored,
        (SELECT count(*) FROM topics WHERE topics.cluster_id = numbers.cluster_id
           AND keyword = canonical_keyword) AS canonical, 'Fair' AS quality_label,
        keyword_count AS listed, 'complete' AS status FROM numbers""")
    q["k04_pending_runs"] = """
      SELECT DISTINCT sha256(text) AS run_key FROM documents WHERE sha256(text) NOT IN (
        SELECT sha256(text) FROM documents JOIN labels USING (doc_id))"""
    config = json.dumps(["termloom-2", {"keyword": "value"}, Settings(neighbor_k=9).to_json()], sort_keys=True)
    q["k07_run_fingerprint"] = build("""
      SELECT sha256(concat_ws('/', count(*), bit_xor(low), bit_xor(high), sum(low), '{config}')) AS run_key
      FROM (
        SELECT CAST('0x' || substr(digest, 1, 15) AS BIGINT) AS low,
               CAST('0x' || substr(digest, 16, 15) AS BIGINT) AS high
        FROM (
          SELECT sha256(size || '/' || CASE
            WHEN max_n >= 1024 THEN sha256(string_agg(digest, '' ORDER BY run)) ELSE any_value(digest) END) AS digest
          FROM (
            SELECT file, n // 1024 AS run, sha256(string_agg(digest, '' ORDER BY n)) AS digest,
              any_value(size) AS size, any_value(max_n) AS max_n
            FROM (
              SELECT file, sha256(line) AS digest, n, max(n) OVER () AS max_n,
                sum(strlen(line) + 1) OVER (PARTITION BY file) AS size
              FROM (
                SELECT row_ord % 4 AS file, coalesce(keyword, '') AS line,
                  row_number() OVER (PARTITION BY row_ord % 4 ORDER BY row_ord) - 1 AS n
                FROM kw_parts))
            GROUP BY file, n // 1024)
          GROUP BY file, size, max_n))""".replace("{config}", config.replace("'", "''")))
    q["k05_run_record"] = build("""
      SELECT 'key' AS run_key, true AS success, true AS persisted,
        count(DISTINCT cluster_id) AS cluster_count, count(*) AS row_count, false AS cached,
        count(*) FILTER (n > 1) AS clustered_keywords FROM topics""")
    q["k06_formula_guard"] = build(r"""
      SELECT row_ord, CASE WHEN regexp_matches(keyword, '^[=+\-@]') THEN '''' || keyword
        ELSE keyword END AS cell FROM kw_phrases""")
    q["r04_external_embedding_clusters"] = build(
        "SELECT clusters.*, keywords, urls FROM clusters JOIN lists USING (cluster_id)",
        *steps, EXTERNAL)
    q["r01_topic_opportunities"] = build(f"SELECT * FROM clusters {ranked}", *steps)
    return q
