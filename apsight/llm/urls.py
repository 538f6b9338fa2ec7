"""Operator 2: URL filter by rules and by an empirical-Bayes reputation of hosts. DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host, registered domain (the
last two labels) and suffix (the last label). Rates shrink downwards through
beta-binomial priors: a suffix towards all pages, a domain towards its suffix, a
host towards its domain. The strength of each prior is estimated from the data:
with mean m and correlation r between a unit's pages, b bad of n pages satisfy
E (b - n m)^2 / (n m (1 - m)) = 1 + (n - 1) r, which gives r by moments, and the
prior weighs 1 / r - 1 pages. A host is blocked if the lower bound of its
posterior rate exceeds ``threshold``. Only counts by host leave the pages.

Defined cases: a url that is null or has no ``://`` has an empty host and path
and is judged as a host of its own; pages without a label, or labels without a
page, are no evidence; several labels of a page count once, bad if any is; rows
that share a ``page_id`` each get a row; an empty table gives none; without any
label nothing is blocked but by a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apsight.llm.common import written

#: (rule, verdict): host and path prefix; a rule fits its host and all subdomains.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Bounds of the estimated correlation, and the posterior bound: bad rate, normal quantile.
LEAST_R, MOST_R, THRESHOLD, QUANTILE = 0.01, 0.99, 0.5, 1.645
#: More rules than this belong in a table joined by host.
MOST_RULES = 500

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null; of two equal rules a block wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = verdict = F.lit(None).cast("string")
    for rule, action in sorted(rules, key=lambda r: (len(r[0]), r[1], r[0])):  # later, longer rules wrap the earlier
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(action)).otherwise(verdict)
    return found, verdict


def units(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, without user and port."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)


def _weight(units_of_level: DataFrame) -> float:
    """Pages that the prior of a level weighs, from (n, bad, prior) of its units; one row comes back."""
    m = F.col("prior")
    q = F.sum((F.col("bad") - F.col("n") * m) ** 2 / (F.col("n") * m * (1 - m)))
    row = units_of_level.where("n > 0").agg(q.alias("q"), F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("more")).first()
    r = (row.q - row.k) / row.more if row.k and row.more else LEAST_R
    return 1 / min(max(r, LEAST_R), MOST_R) - 1


def _shrunk(weight: float) -> Column:
    return (F.col("bad") + F.lit(weight) * F.col("prior")) / (F.col("n") + F.lit(weight))


def host_reputation(outcomes: DataFrame, threshold: float = THRESHOLD, quantile: float = QUANTILE) -> DataFrame:
    """host, n, bad, mean, lower, blocked of every host in ``outcomes`` (host, bad: 1, 0 or null)."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = units(F.col("host"))
    hosts = written(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = (total.bad + 1) / (total.n + 2)
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(overall))
    suffixes = suffixes.select("suffix", _shrunk(_weight(suffixes)).alias("prior"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", _shrunk(_weight(domains)).alias("prior"))
    judged = hosts.join(domains, ["domain", "suffix"])
    weight = _weight(judged)
    mean = _shrunk(weight)
    lower = mean - F.lit(quantile) * F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(weight) + 1))
    return judged.select("host", "n", "bad", mean.alias("mean"), lower.alias("lower"), (lower > F.lit(threshold)).alias("blocked"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; ``labels`` has page_id and bad (0 or 1).

    Reputations join the pages by host; a hot host is split by the adaptive
    skew join, and before that pages are counted by host with partial sums.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    once = labels.groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    reputation = host_reputation(parsed.select("page_id", "host").join(once, "page_id", "left"), threshold)
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    by_host = reputation.select(F.col("host").alias("known"), "blocked")
    joined = parsed.join(by_host, F.col("host") == F.col("known"), "left")
    method = F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"))


ORACLE = f"""
WITH parsed AS (
  SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path
  FROM (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw
        FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages))),
once AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
            FROM parsed LEFT JOIN once ON doc_id = page_id GROUP BY host),
hosts AS (SELECT host, n, bad, regexp_extract(bare, '[^.]*$', 0) AS suffix, regexp_extract(bare, '([^.]*[.])?[^.]*$', 0) AS domain FROM counted),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS prior FROM hosts GROUP BY suffix),
sw AS (SELECT 1 / least(greatest(coalesce((sum((bad - n * prior) ** 2 / (n * prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0), {LEAST_R}), {LEAST_R}), {MOST_R}) - 1 AS w FROM s0 WHERE n > 0),
s AS (SELECT suffix, (bad + w * prior) / (n + w) AS prior FROM s0, sw),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(s.prior) AS prior FROM hosts JOIN s USING (suffix) GROUP BY domain, suffix),
dw AS (SELECT 1 / least(greatest(coalesce((sum((bad - n * prior) ** 2 / (n * prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0), {LEAST_R}), {LEAST_R}), {MOST_R}) - 1 AS w FROM d0 WHERE n > 0),
d AS (SELECT domain, suffix, (bad + w * prior) / (n + w) AS prior FROM d0, dw),
h0 AS (SELECT host, n, bad, prior FROM hosts JOIN d USING (domain, suffix)),
hw AS (SELECT 1 / least(greatest(coalesce((sum((bad - n * prior) ** 2 / (n * prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0), {LEAST_R}), {LEAST_R}), {MOST_R}) - 1 AS w FROM h0 WHERE n > 0),
h AS (SELECT host, m - {QUANTILE} * sqrt(m * (1 - m) / (n + w + 1)) > {THRESHOLD} AS blocked
      FROM (SELECT host, n, w, (bad + w * prior) / (n + w) AS m FROM h0, hw)),
rules(rule, name, prefix, action) AS (VALUES {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{a}')" for r, a in RULES)}),
fits AS (SELECT page_id, host, path, first(rule ORDER BY length(rule) DESC) AS rule, first(action ORDER BY length(rule) DESC) AS action
         FROM (SELECT DISTINCT page_id, host, path FROM parsed) JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)
         GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, CASE WHEN h.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN h ON h.host = p.host LEFT JOIN fits f ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path
"""
