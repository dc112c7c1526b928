"""URL filters: path rules, then the reputation of the host.

A host's reputation is the share of bad outcomes among its labelled pages, shrunk level by level: suffixes to all
pages, registered domains to their suffix, hosts to their domain. At each level the strength of the prior comes
from how much the rates of that level spread. A host is blocked only if the lower posterior bound of its rate is
above a limit, so a host with few labels needs more than those.

The registered domain is taken to be the last two labels of the host and the suffix the last one. Outcomes are
rows (page_id, bad); the query takes `labels` of the same number as the page, quality 0 being bad.

Defined results: a null url, or one without ://, has empty host and path, and the empty host is judged like any
other; null outcomes do not count, repeated ones each do; pages without an id have no outcomes; repeated pages each
give a row; without any outcome everything that no rule blocks is allowed; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import beside, beta_prior, beta_prior_sql, saved

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
MAX_RATE = 0.5
BOUND_Z = 2.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Mapping[str, str]) -> Column:
    """The longest rule whose host is the url's or above it and whose path begins the url's, as (rule, verdict).

    Rules are written into the expression; they are a handful set by hand.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(rules[rule]).alias("verdict"))).otherwise(chosen)
    return chosen


def host_rates(hosts: DataFrame) -> DataFrame:
    """`hosts` (host, n, failed) with `low`, the lower posterior bound of the share of bad outcomes."""
    domain = F.regexp_extract("host", r"[^.]*(?:\.[^.]*)?$", 0)
    suffix = F.regexp_extract("domain", r"[^.]*$", 0)
    hosts = hosts.withColumn("domain", domain)
    sums = [F.sum("n").alias("n"), F.sum("failed").alias("failed")]
    domains = saved(hosts.groupBy("domain").agg(*sums).withColumn("suffix", suffix), "domains")
    suffixes = saved(domains.groupBy("suffix").agg(*sums), "suffixes")
    mean, k_suffix = beta_prior(suffixes)
    _, k_domain = beta_prior(domains)
    _, k_host = beta_prior(hosts)

    def shrunk(prior: Column, strength: Column) -> Column:
        return (F.col("failed") + prior * strength) / (F.col("n") + strength)

    top = suffixes.select("suffix", shrunk(mean, k_suffix).alias("above"))
    middle = domains.join(top, "suffix").select("domain", shrunk(F.col("above"), k_domain).alias("above"))
    a = F.col("failed") + F.col("above") * k_host
    b = F.col("n") - F.col("failed") + (1 - F.col("above")) * k_host
    low = a / (a + b) - BOUND_Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(middle, "domain").select("host", "n", "failed", low.alias("low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Mapping[str, str] = RULES, max_rate: float = MAX_RATE) -> DataFrame:
    """Per row of `pages` (page_id, url): page_id, host, path, rule, verdict, and the host's labelled and bad pages."""
    host, path = host_and_path(F.col("url"))
    parsed = saved(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL")
    known = known.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("failed"))
    labelled = parsed.join(known, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed")
    )
    rates = host_rates(saved(labelled, "hosts"))
    bad = rates.select("host", "n", "failed", F.coalesce(F.col("low") > max_rate, F.lit(False)).alias("bad_host"))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(beside(saved(bad, "rates")), "host").withColumn("_rule", rule)
    return judged.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"),
        F.col("n").alias("host_labelled"), F.col("failed").alias("host_bad"),
    )


def _rule_sql(what: Mapping[str, str]) -> str:
    tests = []
    for rule in sorted(RULES, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        tests.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '{slash + rest}') THEN '{what[rule]}'")
    return "CASE " + " ".join(tests) + " END"


ORACLE_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS failed
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(failed), 0)::BIGINT AS failed, regexp_extract(host, '[^.]*(?:\.[^.]*)?$') AS domain
  FROM p LEFT JOIN l USING (page_id) GROUP BY host),
d AS (SELECT domain, sum(n) AS n, sum(failed) AS failed, regexp_extract(domain, '[^.]*$') AS suffix FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(failed) AS failed FROM d GROUP BY suffix),
fs AS ({beta_prior_sql("s")}), fd AS ({beta_prior_sql("d")}), fh AS ({beta_prior_sql("h")}),
s2 AS (SELECT suffix, (failed + m * k) / (n + k) AS above FROM s, fs),
d2 AS (SELECT domain, (failed + above * k) / (n + k) AS above FROM d JOIN s2 USING (suffix), fd),
h2 AS (SELECT host, n, failed, failed + above * k AS a, n - failed + (1 - above) * k AS b FROM h JOIN d2 USING (domain), fh),
v AS (SELECT host, n, failed, coalesce(a / (a + b) - {BOUND_Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {MAX_RATE}, false) AS bad FROM h2)
SELECT page_id, host, path, {_rule_sql({r: r for r in RULES})} AS rule,
  coalesce({_rule_sql(RULES)}, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, n AS host_labelled, failed AS host_bad
FROM p JOIN v USING (host)
"""
