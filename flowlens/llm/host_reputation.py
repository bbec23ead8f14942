"""URL filter by empirical-Bayes host reputation (native DataFrame code).

Labelled page outcomes (1 good, 0 bad) are counted per host and shrunk along
suffix -> registered domain -> host: at each level a group's rate has a
beta-binomial prior whose mean is the parent's posterior mean and whose
strength is estimated from the data (moment estimate of the intra-group
correlation). A page is allowed if the lower bound of its host's posterior,
mean - z standard deviations, reaches ``min_good``; a host without labels has
its domain's prior, and so on up. Given rules (host suffix and path prefix)
override the method; the longest one that fits a URL wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z = 1.645
MIN_GOOD = 0.5
RHO_MIN, RHO_MAX = 0.0001, 0.9999     # bounds of the estimated correlation
PLACES = 6                            # reported figures

# Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "org.au", "net.au", "co.jp", "ne.jp",
                      "or.jp", "co.nz", "com.br", "com.cn", "com.tr", "co.in", "co.kr", "co.za", "com.mx")

# Fixed values: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_name(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def suffix_of(name: Column) -> Column:
    last, two = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9.]+$"), name).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(last)


def domain_of(name: Column) -> Column:
    """The registered domain: the suffix and one label more (addresses and bare suffixes as they are)."""
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9.]+$"), name) \
        .when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict (NULL without one)."""
    text = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _shrunk(groups: DataFrame) -> DataFrame:
    """``groups`` (g good of n, the parent's mean ``prior``) with the strength ``m`` and
    the posterior mean ``mean``; the strength comes from all groups (one row, broadcast)."""
    m = groups.agg(_strength().alias("m"))
    return groups.crossJoin(F.broadcast(m)) \
        .withColumn("mean", (F.col("g") + F.col("m") * F.col("prior")) / (F.col("n") + F.col("m")))


def _strength() -> Column:
    """Prior strength 1/rho - 1. E[(g - n p)^2] = n p (1 - p) (1 + (n - 1) rho)."""
    excess = F.sum((F.col("g") - F.col("n") * F.col("prior")) * (F.col("g") - F.col("n") * F.col("prior"))
                   / (F.col("prior") * (1 - F.col("prior")))) - F.sum("n")
    pairs = F.sum(F.col("n") * (F.col("n") - 1))
    rho = F.when(pairs > 0, excess / F.when(pairs > 0, pairs)).otherwise(F.lit(0.1))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.1)), F.lit(RHO_MIN)), F.lit(RHO_MAX))
    return (1 - rho) / rho


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """``pages(page_id, url)``, ``outcomes(page_id, good)`` -> one row per host:
    host, n_labelled, n_good, reputation (posterior mean), lower_bound.

    Of several outcomes of a page the smallest counts; NULL outcomes and ids
    are ignored. Every host of ``pages`` has a row, labelled or not."""
    known = outcomes.where("page_id is not null and good in (0, 1)") \
        .groupBy(F.col("page_id").alias("_page")).agg(F.min("good").cast("long").alias("good"))
    known = materialize(known, "reputation-outcomes")
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"))
    hosts = seen.join(known, seen["page_id"] == known["_page"], "left") \
        .groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("g"),
                             F.count("good").cast("double").alias("n"))
    name = host_name(F.col("host"))
    hosts = materialize(hosts.withColumn("domain", domain_of(name)).withColumn("suffix", suffix_of(name)),
                        "reputation-hosts")

    total = hosts.agg(((F.sum("g") + 1) / (F.sum("n") + 2)).alias("prior"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("g").alias("g"), F.sum("n").alias("n")) \
        .crossJoin(F.broadcast(total))
    suffixes = materialize(_shrunk(suffixes).select("suffix", "mean"),
                           "reputation-suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("g").alias("g"), F.sum("n").alias("n")) \
        .join(suffixes.withColumnRenamed("mean", "prior"), "suffix")
    domains = materialize(_shrunk(materialize(domains, "reputation-domain-counts"))
                          .select("domain", "suffix", "mean"), "reputation-domains")
    hosts = materialize(hosts.join(domains.withColumnRenamed("mean", "prior"), ["domain", "suffix"]),
                        "reputation-host-counts")
    post = _shrunk(hosts)
    size = F.col("n") + F.col("m")
    return post.select(
        "host", F.col("n").cast("long").alias("n_labelled"), F.col("g").cast("long").alias("n_good"),
        F.col("mean").alias("reputation"),
        (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))).alias("lower_bound"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z,
                 min_good: float = MIN_GOOD) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict and the
    host's reputation and lower_bound (rounded).

    A NULL url or one without ``://`` has an empty host and path; all such
    pages share the reputation of the empty host. Repeated rows come out as
    often; other columns are ignored; an empty table gives no rows."""
    reputation = materialize(host_reputation(pages, outcomes, z), "reputation")
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")) \
        .join(reputation.select("host", "reputation", "lower_bound"), "host", "left")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.round("lower_bound", PLACES) >= min_good, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"),
        F.round("reputation", PLACES).alias("reputation"), F.round("lower_bound", PLACES).alias("lower_bound"))


def _sql_two(name: str, k: int) -> str:
    return f"array_to_string(list_slice(string_split({name}, '.'), -{k}, -1), '.')"


def oracle_sql() -> str:
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    whens = "\n".join(
        f"    when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{{0}}'"
        .replace("{0}", f"{h}{p}|{v}")
        for v, h, p in sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), r[1:]), reverse=True))
    m = ("(select case when sum(n * (n - 1)) > 0 then (sum((g - n * prior) * (g - n * prior) / (prior * (1 - prior)))"
         " - sum(n)) / sum(n * (n - 1)) else 0.1 end as r from {t})")
    strength = "(select (1 - c) / c as m from (select least(greatest(coalesce(r, 0.1), " \
               f"{RHO_MIN}), {RHO_MAX}) as c from {m}))"
    def mean(t: str) -> str:
        return f"(select x.*, (g + m * prior) / (n + m) as mean, m from {t} x, {strength.replace('{t}', t)})"
    return rf"""
with p as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
o as (select doc_id, min(quality) as good from labels where doc_id is not null and quality in (0, 1) group by 1),
h0 as (
  select host, cast(coalesce(sum(good), 0) as double) as g, cast(count(good) as double) as n,
    regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') as name
  from p left join o on page_id = doc_id group by host),
h as (
  select host, g, n,
    case when regexp_matches(name, '^[0-9.]+$') then name
         when {_sql_two('name', 2)} in ({two}) then {_sql_two('name', 3)} else {_sql_two('name', 2)} end as domain,
    case when regexp_matches(name, '^[0-9.]+$') then name
         when {_sql_two('name', 2)} in ({two}) then {_sql_two('name', 2)} else {_sql_two('name', 1)} end as suffix
  from h0),
s as (select suffix, sum(g) as g, sum(n) as n, (select (sum(g) + 1) / (sum(n) + 2) from h) as prior from h group by 1),
sm as (select suffix, mean as prior from {mean('s')}),
d as (select domain, suffix, g, n, prior from
  (select domain, suffix, sum(g) as g, sum(n) as n from h group by 1, 2) join sm using (suffix)),
dm as (select domain, suffix, mean as prior from {mean('d')}),
hh as (select host, g, n, prior from h join dm using (domain, suffix)),
r as (select host, mean, mean - {Z} * sqrt(mean * (1 - mean) / (n + m + 1)) as low from {mean('hh')}),
j as (
  select page_id, host, path, case
{whens}
    end as found, mean, low
  from p left join r using (host))
select page_id, host, path, string_split(found, '|')[1] as rule,
  coalesce(string_split(found, '|')[2], case when round(low, {PLACES}) >= {MIN_GOOD} then 'allow' else 'block' end) as verdict,
  round(mean, {PLACES}) as reputation, round(low, {PLACES}) as lower_bound
from j
"""
