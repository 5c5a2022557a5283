"""URL filters: listed rules first, then an empirical-Bayes reputation of the host.

Labelled pages are counted by host, registered domain and suffix. At each level a beta prior is centred on the
estimate of the level above, and its strength is fitted by moments from how far the groups scatter beyond binomial
noise; the suffixes' prior is centred on all labelled pages and one bad page of ten besides. A host is blocked when the
lower bound of its posterior rate of bad pages exceeds ``lift`` times the rate of all labelled pages: it is then worse
than the corpus, and by more than its own few pages could show by chance.
Everything is a DataFrame expression. Pages are counted by host once; the levels above are tables of a row for each host,
domain and suffix, and what is fitted at a level is one number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.hot import spread_join
from tallyloom.llm.scratch import materialize

#: (verdict, rule): host and path of a rule meet at its first slash. The longest rule that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Labels that form a public suffix together with a country's two letters; other suffixes are the last label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Standard deviations below the posterior mean, how many times the corpus's bad rate is accepted there, limits of a prior's strength in pages, and blocked hosts that are broadcast.
Z, LIFT, STRENGTH, BROADCAST_HOSTS = 1.645, 1.0, (2.0, 1000.0), 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix; a host of digits and dots, or of one label, is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    double = two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    plain = name.rlike(r"^[0-9.]*$")
    return F.when(plain, name).when(double, three).otherwise(two), F.when(plain, name).when(double, two).otherwise(F.substring_index(name, ".", -1))


def _strength(groups: DataFrame, mean: Column) -> float:
    """The strength of the beta prior around ``mean`` that explains the scatter of the rates k / n of groups: one aggregated number."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), mean))
    scatter = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2) / (p * (1 - p)))
    total, squares, count = F.sum("n").cast("double"), F.sum(F.col("n").cast("double") * F.col("n")), F.count(F.lit(1)).cast("double")
    spare = total - squares / total - (count - 1)
    rho = F.when(spare > 0, (scatter - (count - 1)) / spare)
    low, high = STRENGTH
    strength = F.greatest(F.lit(low), F.least(F.lit(high), F.when(rho > 0, 1 / rho - 1).otherwise(high)))
    return groups.where("n > 0").agg(F.coalesce(strength, F.lit(high)).alias("strength")).first()["strength"]


def reputations(labelled: DataFrame, z: float = Z) -> DataFrame:
    """Columns host, n_labelled, n_bad, bad_rate, bad_bound and corpus_rate from rows of (host, n labelled pages, k of them bad).

    One row for each host, with or without labelled pages; corpus_rate, that of all of them, is null without any. Null hosts
    are no hosts; an empty table gives an empty table.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    both = F.sum("n").alias("n"), F.sum("k").alias("k")
    hosts = materialize(labelled.where("host IS NOT NULL").groupBy("host").agg(*both).withColumns({"domain": domain, "suffix": suffix}), "reputation-hosts")
    domains = materialize(hosts.groupBy("suffix", "domain").agg(*both), "reputation-domains")
    suffixes = materialize(domains.groupBy("suffix").agg(*both), "reputation-suffixes")
    n, k = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()

    def shrunk(df: DataFrame, mean: Column, to: str) -> DataFrame:
        strength = F.lit(_strength(df, mean))
        return df.withColumns({to: (F.col("k") + strength * mean) / (F.col("n") + strength), "strength": strength})

    suffixes = shrunk(suffixes, F.lit((k + 1) / (n + 10.0)), "suffix_rate").select("suffix", "suffix_rate")
    domains = materialize(shrunk(domains.join(suffixes, "suffix"), F.col("suffix_rate"), "domain_rate").select("suffix", "domain", "domain_rate"), "reputation-rates")
    hosts = shrunk(hosts.join(domains, ["suffix", "domain"]), F.col("domain_rate"), "bad_rate")
    spread = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + F.col("strength") + 1))
    return hosts.select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), "bad_rate", (F.col("bad_rate") - z * spread).alias("bad_bound"), F.lit(k / n if n else None).cast("double").alias("corpus_rate"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, lift: float = LIFT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Columns ``id_col``, host, path, rule and verdict, for each row of ``pages``.

    A page is labelled through the document whose number its path holds; it is bad if that document is toxic or of
    quality 0. Null labels count as good, repeated labels of a document as bad if one is. Null urls have an empty host
    and path. Repeated and null ids are kept as they are; extra columns of either table do not matter. Without labels only
    rules block. An empty table gives an empty table.

    Pages are counted by host and number before labels are joined. The few hosts that are blocked are broadcast while there are
    BROADCAST_HOSTS of them at most, so that pages are not shuffled; beyond that they are joined by host, large hosts split.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) AS bigint)")
    bad = F.when((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0), 1).otherwise(0)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    seen = rows.groupBy("host", number.alias("doc_id")).agg(F.count(F.lit(1)).alias("pages"))
    # Numbers without a label, and pages without a number, count for no host; the latter meet no join.
    counted = seen.where("doc_id IS NOT NULL").join(known, "doc_id").select("host", F.col("pages").alias("n"), (F.col("pages") * F.col("bad")).alias("k"))
    unlabelled = seen.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k")).distinct()
    found = reputations(counted.unionByName(unlabelled))
    blocked = materialize(found.where(F.col("bad_bound") > lift * F.col("corpus_rate")).select("host", F.lit(True).alias("bad_host")), "reputation-blocked")

    rule, verdict = F.lit(None).cast("string"), F.when(F.coalesce(F.col("bad_host"), F.lit(False)), "block").otherwise("allow")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        at, prefix = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == at) | F.col("host").endswith(f".{at}")) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    if blocked.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(blocked), "host", "left")
    else:
        joined = spread_join(rows, blocked, ["host"], ["id", "path"], how="left")
    return joined.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def allowed(pages: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The hosts' and rules' verdicts as a filter: ids of the pages that stay."""
    return judge(pages, labels, **options).where("verdict = 'allow'")


#: The same verdicts in DuckDB's SQL.
ORACLE_SQL = r"""
WITH urls AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), known AS (
  SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), names AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name,
         count(bad) AS n, coalesce(sum(bad), 0) AS k
  FROM urls LEFT JOIN known ON try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) = doc_id
  GROUP BY host
), labelled AS (
  SELECT *, string_split(name, '.') AS p,
         regexp_matches(array_to_string(string_split(name, '.')[-2:], '.'), '^(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$') AS two
  FROM names
), hosts AS (
  SELECT host, n, k,
         CASE WHEN regexp_matches(name, '^[0-9.]*$') THEN name WHEN two THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
         CASE WHEN regexp_matches(name, '^[0-9.]*$') THEN name WHEN two THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix
  FROM labelled
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix, domain
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix
), suffix_prior AS (
  SELECT suffix, n, k, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 10.0) FROM suffixes) AS prior FROM suffixes
), suffix_scatter AS (
  SELECT sum(n * pow(k / n::DOUBLE - p, 2) / (p * (1 - p))) AS s, sum(n)::DOUBLE AS t, sum(n::DOUBLE * n) AS q, count(*)::DOUBLE AS g
  FROM (SELECT n, k, greatest(1e-6, least(1 - 1e-6, prior)) AS p FROM suffix_prior WHERE n > 0)
), suffix_strength AS (
  SELECT coalesce(greatest(2.0, least(1000.0, CASE WHEN (s - (g - 1)) / CASE WHEN t - q / t - (g - 1) > 0 THEN t - q / t - (g - 1) END > 0
                                     THEN 1 / ((s - (g - 1)) / (t - q / t - (g - 1))) - 1 ELSE 1000.0 END)), 1000.0) AS m FROM suffix_scatter
), suffix_rate AS (
  SELECT suffix, (k + m * prior) / (n + m) AS rate FROM suffix_prior, suffix_strength
), domain_prior AS (
  SELECT d.suffix, d.domain, d.n, d.k, r.rate AS prior FROM domains d JOIN suffix_rate r ON d.suffix = r.suffix
), domain_scatter AS (
  SELECT sum(n * pow(k / n::DOUBLE - p, 2) / (p * (1 - p))) AS s, sum(n)::DOUBLE AS t, sum(n::DOUBLE * n) AS q, count(*)::DOUBLE AS g
  FROM (SELECT n, k, greatest(1e-6, least(1 - 1e-6, prior)) AS p FROM domain_prior WHERE n > 0)
), domain_strength AS (
  SELECT coalesce(greatest(2.0, least(1000.0, CASE WHEN (s - (g - 1)) / CASE WHEN t - q / t - (g - 1) > 0 THEN t - q / t - (g - 1) END > 0
                                     THEN 1 / ((s - (g - 1)) / (t - q / t - (g - 1))) - 1 ELSE 1000.0 END)), 1000.0) AS m FROM domain_scatter
), domain_rate AS (
  SELECT suffix, domain, (k + m * prior) / (n + m) AS rate FROM domain_prior, domain_strength
), host_prior AS (
  SELECT h.host, h.n, h.k, r.rate AS prior FROM hosts h JOIN domain_rate r ON h.suffix = r.suffix AND h.domain = r.domain
), host_scatter AS (
  SELECT sum(n * pow(k / n::DOUBLE - p, 2) / (p * (1 - p))) AS s, sum(n)::DOUBLE AS t, sum(n::DOUBLE * n) AS q, count(*)::DOUBLE AS g
  FROM (SELECT n, k, greatest(1e-6, least(1 - 1e-6, prior)) AS p FROM host_prior WHERE n > 0)
), host_strength AS (
  SELECT coalesce(greatest(2.0, least(1000.0, CASE WHEN (s - (g - 1)) / CASE WHEN t - q / t - (g - 1) > 0 THEN t - q / t - (g - 1) END > 0
                                     THEN 1 / ((s - (g - 1)) / (t - q / t - (g - 1))) - 1 ELSE 1000.0 END)), 1000.0) AS m FROM host_scatter
), host_bound AS (
  SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (n + m + 1)) > 1.0 * (SELECT sum(k)::DOUBLE / sum(n) FROM suffixes) AS bad
  FROM (SELECT host, n, m, (k + m * prior) / (n + m) AS rate FROM host_prior, host_strength)
), fitting AS (
  SELECT u.page_id, u.host, u.path, b.bad,
         CASE WHEN (u.host = 'example.org' OR ends_with(u.host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (u.host = 'example.org' OR ends_with(u.host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (u.host = 'com' OR ends_with(u.host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (u.host = 'com' OR ends_with(u.host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (u.host = 'org' OR ends_with(u.host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM urls u LEFT JOIN host_bound b ON u.host = b.host
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad THEN 'block' ELSE 'allow' END AS verdict
FROM fitting
"""
