"""URL filter by empirical-Bayes host reputation, under explicit rules.

Labelled outcomes of pages (good or bad) give each host a rate. Hosts with few labels say little,
so rates are shrunk from the top down: the suffix to the overall rate, the registered domain (one
label more) to its suffix, the host to its domain. A suffix is the last label, or the longest of the
given ``suffixes`` of several labels (``co.uk``) that the host ends with. How strongly is learnt per level:
the strength of the beta prior comes from the variance between siblings beyond binomial noise
(analysis-of-variance estimate of the beta-binomial correlation). A host is blocked when the upper
bound of its posterior (mean plus ``Z`` deviations) stays below ``LEAST_GOOD`` of the overall rate.

Rules decide first: a rule ``host/path`` fits its host and all subdomains if the url's path starts
with the rule's; the longest wins. A null url or one without ``://`` has empty host and path and is
a host of its own. Repeated pages are judged each; a page without a label only takes the prior.
A page that is there n times with a label counts n outcomes; ids may be null, and a null id has no
label. Other columns stay as they are, whatever their names. Empty tables give an empty result. All
aggregates combine map-side into one written row per host, which the levels above are made of; the
overall rate and the three strengths, one row each, go through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
Z = 1.645
LEAST_GOOD = 0.75
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def url_host(url: str) -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: str, path: str, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    found = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = (F.col(host) == name) | F.col(host).endswith("." + name)
        found.append(F.when(fits & F.col(path).startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def rule_verdict(rule: str, rules: Sequence[tuple[str, str]]) -> Column:
    said = F.lit(None).cast("string")
    for name, verdict in rules:
        said = F.when(F.col(rule) == name, F.lit(verdict)).otherwise(said)
    return said


def _prior_strength(groups: DataFrame, parent_rate: str) -> float:
    """Pseudo-observations of the prior, from how far rates of labelled siblings lie apart."""
    n, rate = F.col("n"), F.col("good") / F.col("n")
    got = groups.where("n > 0").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.sum(n * n).alias("squares"),
        F.sum(n * (rate - F.col(parent_rate)) ** 2).alias("between"),
        F.sum(n * rate * (1 - rate)).alias("within"),
    ).first()
    k, total = got["k"], got["total"] or 0
    if k < 2 or total <= k:
        return MOST_STRENGTH
    between, within = got["between"] / (k - 1), got["within"] / (total - k)
    size = (total - got["squares"] / total) / (k - 1)
    if between <= within:
        return MOST_STRENGTH
    rho = (between - within) / (between + (size - 1) * within)
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, (1 - rho) / rho))


def _shrunk(groups: DataFrame, prior: str, strength: float) -> Column:
    return (F.col("good") + strength * F.col(prior)) / (F.col("n") + strength)


def _levels(host: str, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Suffix and registered domain of a host."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    by_size: dict[int, list[str]] = {}
    for suffix in suffixes:
        by_size.setdefault(suffix.count(".") + 1, []).append(suffix)
    n = F.lit(1)
    for size in sorted(by_size):
        n = F.when((F.size(labels) >= size) & last(F.lit(size)).isin(by_size[size]), F.lit(size)).otherwise(n)
    return last(n), last(n + 1)


def host_reputation(
    outcomes: DataFrame, z: float = Z, least_good: float = LEAST_GOOD, suffixes: Sequence[str] = ()
) -> DataFrame:
    """host, n, good, reputation, upper and blocked, from host and good (true, false or null)."""
    hosts = outcomes.groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good")
    )
    suffix, domain = _levels("host", suffixes)
    hosts = materialize(hosts.select("host", "n", "good", suffix.alias("suffix"), domain.alias("domain")), "hosts")
    totals = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = ((totals["good"] or 0) + 1.0) / ((totals["n"] or 0) + 2.0)

    counted = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    suffixes = hosts.groupBy("suffix").agg(*counted).withColumn("prior", F.lit(overall))
    suffixes = suffixes.withColumn("rate_s", _shrunk(suffixes, "prior", _prior_strength(suffixes, "prior")))
    domains = hosts.groupBy("suffix", "domain").agg(*counted)
    domains = domains.join(suffixes.select("suffix", "rate_s"), "suffix")
    domains = domains.withColumn("rate_d", _shrunk(domains, "rate_s", _prior_strength(domains, "rate_s")))
    hosts = hosts.join(domains.select("domain", "rate_d"), "domain")
    strength = _prior_strength(hosts, "rate_d")
    a = F.col("good") + strength * F.col("rate_d")
    b = F.col("n") - F.col("good") + strength * (1 - F.col("rate_d"))
    upper = a / (a + b) + z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select(
        "host", "n", "good", (a / (a + b)).alias("reputation"), upper.alias("upper"),
        (upper < least_good * overall).alias("blocked"),
    )


def judge_urls(
    pages: DataFrame, labels: DataFrame, id_column: str = "page_id", url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES, z: float = Z, least_good: float = LEAST_GOOD,
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """The pages with host, path, rule, verdict and the host's reputation.

    ``labels`` has an id column of the same name and ``good``; an id with several labels is good
    only if all of them are. Columns of ``pages`` with those names are replaced.
    """
    key, good, h = fresh(pages, "label_id", "label_good", "rated_host")
    pages = pages.drop("host", "path", "rule", "verdict", "reputation").withColumns(
        {"host": url_host(url), "path": url_path(url)}
    )
    labels = labels.groupBy(F.col(id_column).alias(key)).agg(F.min("good").alias(good))
    outcomes = pages.join(labels, F.col(id_column) == F.col(key), "left").select(
        "host", F.col(good).alias("good")
    )
    rated = host_reputation(outcomes, z, least_good, suffixes).select(
        F.col("host").alias(h), "reputation", "blocked"
    )
    judged = pages.join(rated, F.col("host") == F.col(h), "left").withColumn(
        "rule", fitting_rule("host", "path", rules)
    )
    method = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("verdict", F.coalesce(rule_verdict("rule", rules), method)).drop(h, "blocked")


def _level_sql(name: str, source: str, keys: str, prior: str, rate: str) -> str:
    """Rates of one level, shrunk to their parents', like ``_prior_strength`` and ``_shrunk``."""
    return f"""
{name}_m AS (
  SELECT count(*) AS k, sum(n) AS total, sum(n * n) AS squares,
         sum(n * ((good / n) - {prior}) ** 2) AS between_sum,
         sum(n * (good / n) * (1 - good / n)) AS within_sum
  FROM {source} WHERE n > 0
), {name}_r AS (
  SELECT CASE WHEN k < 2 OR total <= k THEN NULL ELSE between_sum / (k - 1) END AS b,
         CASE WHEN k < 2 OR total <= k THEN NULL ELSE within_sum / (total - k) END AS w,
         CASE WHEN k < 2 OR total <= k THEN NULL ELSE (total - squares / total) / (k - 1) END AS size
  FROM {name}_m
), {name}_s AS (
  SELECT CASE WHEN b IS NULL OR b <= w THEN {MOST_STRENGTH}::DOUBLE ELSE
    least({MOST_STRENGTH}::DOUBLE, greatest({LEAST_STRENGTH}::DOUBLE,
      (1 - (b - w) / (b + (size - 1) * w)) / ((b - w) / (b + (size - 1) * w)))) END AS strength
  FROM {name}_r
), {name} AS (
  SELECT x.*, strength, (good + strength * {prior}) / (n + strength) AS {rate}
  FROM {source} x, {name}_s
)"""


HOSTS_SQL = f"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), l AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), h0 AS (
  SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good,
         regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain
  FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good,
         ((SELECT sum(good) FROM h0) + 1.0::DOUBLE) / ((SELECT sum(n) FROM h0) + 2) AS prior
  FROM h0 GROUP BY suffix
), {_level_sql('s', 's0', 'suffix', 'prior', 'rate_s')}, d0 AS (
  SELECT suffix, domain, sum(h0.n) AS n, sum(h0.good) AS good, any_value(rate_s) AS rate_s
  FROM h0 JOIN s USING (suffix) GROUP BY suffix, domain
), {_level_sql('d', 'd0', 'domain', 'rate_s', 'rate_d')}, h1 AS (
  SELECT h0.host, h0.n, h0.good, rate_d FROM h0 JOIN d USING (domain)
), {_level_sql('h', 'h1', 'host', 'rate_d', 'rate_h')}, u AS (
  SELECT host, good + strength * rate_d AS a, n - good + strength * (1 - rate_d) AS b FROM h
), v AS (
  SELECT host, a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
         < {LEAST_GOOD}::DOUBLE * (SELECT any_value(prior) FROM s0) AS blocked
  FROM u
), j AS (
  SELECT page_id, p.host, path, blocked, CASE
    WHEN (p.host = 'example.org' OR p.host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (p.host = 'example.org' OR p.host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p JOIN v ON p.host = v.host
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block'
  WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
