"""URL filters: explicit rules, and empirical-Bayes reputation of hosts where no rule fits.

Outcomes of labelled pages (bad or not) are counted by host, without user part and port. Each level's rates are shrunk towards the level above
through a beta prior: all pages, then public suffix, registered domain, host. A prior's mean is the parent's
posterior mean without the child's own outcomes, so that no outcome counts twice. How strongly is estimated from how
much more the level's rates vary than chance explains (method of moments of the beta-binomial). A host is blocked if the lower posterior bound of its bad rate is above ``threshold``, so it
takes evidence to block and hosts without labels go by their domain.

Only counts by host are shuffled besides the pages' own addresses, and a level's strength is two numbers for the
driver. Verdicts by host are written, so that they are broadcast if they are few and joined with skew handling if not.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and the verdict of the host
``""``; null ids are kept; of conflicting labels the worse one counts; null labels are ignored; repeated rows get
equal verdicts; without any label everything that no rule blocks is allowed. An IP address (four numbers, or in
brackets) is a domain of its own under the suffix ``address``; a host that is a public suffix is its own domain; the
public suffix is the longest of ``LONGER_SUFFIXES`` that fits, or else the last label. Other columns aren't read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.arrow import quoted
from docloom.session import materialise


@dataclass(frozen=True)
class Rule:
    """Block or allow a host with all its subdomains, as far as the path starts with ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Public suffixes of two labels; a caller with the whole public list passes that.
LONGER_SUFFIXES = (
    "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl",
    "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.ve", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in",
    "gov.uk", "govt.nz", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.cn", "net.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz",
    "org.uk", "org.za", "plc.uk", "sch.uk",
)
#: An address in place of a name.
ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[\s\S]*\])\z"
#: A bad rate that is above THRESHOLD with about 95 % certainty blocks.
THRESHOLD, Z = 0.5, 1.645
#: The weight of a level's prior, in pages, is kept within these.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reputation_key(host: Column) -> Column:
    """The name under which a host's outcomes are counted: without user part, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^[\s\S]*@", ""), r"\.?(?::[0-9]*)?\z", "")


def registered_domain(key: Column, suffix: Column) -> Column:
    """The suffix and one more label; a key that is a suffix itself, or an address, is its own domain."""
    labels = F.size(F.split(suffix, r"\."))
    named = F.array_join(F.reverse(F.slice(F.reverse(F.split(key, r"\.")), F.lit(1), labels + 1)), ".")
    return F.when(key.rlike(ADDRESS), key).otherwise(named)


def suffix_pattern(longer: tuple[str, ...]) -> str:
    """What finds one of the suffixes at the end of a name, the longest first."""
    known = sorted(longer, key=lambda x: (-len(x), x)) or [r"\A\z"]
    return r"(?:^|\.)(" + "|".join(x.replace(".", r"\.") for x in known) + r")\z"


def public_suffix(key: Column, longer: tuple[str, ...] = LONGER_SUFFIXES) -> Column:
    """The longest of the ``longer`` suffixes that fits, or else the last label."""
    found = F.regexp_extract(key, suffix_pattern(longer), 1)
    return F.when(key.rlike(ADDRESS), "address").when(found != "", found).otherwise(F.element_at(F.split(key, r"\."), -1))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def prior_weight(children: DataFrame) -> float:
    """How many pages the prior of a level counts for, from its members' n, bad and prior mean p."""
    n, bad, p = F.col("n"), F.col("bad"), F.col("p")
    off = F.sum(F.when(n > 0, (bad - n * p) ** 2 / (n * p * (1 - p))))
    s = children.agg(F.sum((n > 0).cast("long")).alias("k"), F.sum("n").alias("n"), off.alias("off")).first()
    k, pages, off_sum = s["k"] or 0, s["n"] or 0, s["off"] or 0.0
    correlation = (off_sum - (k - 1)) / (pages - k) if pages > k else 0.0
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, 1.0 / correlation - 1.0)) if correlation > 0 else MOST_WEIGHT


def _with_prior(children: DataFrame, parents: DataFrame, on: str, weight: float) -> DataFrame:
    """Children with ``p``: their parent's posterior mean, had it only its other children's outcomes."""
    up = parents.select(on, F.col("n").alias("n_up"), F.col("bad").alias("bad_up"), F.col("p").alias("p_up"))
    p = (weight * F.col("p_up") + F.col("bad_up") - F.col("bad")) / (weight + F.col("n_up") - F.col("n"))
    return children.join(up, on).withColumn("p", p).drop("n_up", "bad_up", "p_up")


def host_reputation(outcomes: DataFrame, hosts: DataFrame, longer_suffixes: tuple[str, ...] = LONGER_SUFFIXES) -> DataFrame:
    """``host``, ``mean`` and ``bound`` (the lower posterior bound of the bad rate) of every distinct host.

    ``outcomes`` has host and bad (0 or 1); ``hosts`` has host. Hosts are reputation keys.
    """
    counted = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    suffix = public_suffix(F.col("host"), longer_suffixes)
    every = hosts.select("host").distinct().join(counted, "host", "left").fillna(0, ["n", "bad"])
    every = every.withColumn("suffix", suffix).withColumn("domain", registered_domain(F.col("host"), F.col("suffix")))
    every = materialise(every, "host-outcomes")
    total = every.agg(F.sum("n"), F.sum("bad")).first()
    base = ((total[1] or 0) + 0.5) / ((total[0] or 0) + 1.0)

    summed = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = every.groupBy("suffix").agg(*summed).withColumn("p", F.lit(base))
    domains = materialise(_with_prior(every.groupBy("domain", "suffix").agg(*summed), suffixes, "suffix", prior_weight(suffixes)), "domain-rates")
    rated = materialise(_with_prior(every, domains, "domain", prior_weight(domains)), "host-rates")
    weight = prior_weight(rated)
    mean = (weight * F.col("p") + F.col("bad")) / (weight + F.col("n"))
    return rated.select("host", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (weight + F.col("n") + 1))).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", longer_suffixes: tuple[str, ...] = LONGER_SUFFIXES) -> DataFrame:
    """``id_col``, host, path, rule and verdict of every page; ``outcomes`` has url and bad (0 or 1, null: no label)."""
    url = quoted(url_col)
    parsed = pages.select(quoted(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.where(F.col("bad").isNotNull()).select(reputation_key(host_of(F.col("url"))).alias("host"), "bad")
    rated = host_reputation(known, parsed.select(reputation_key(F.col("host")).alias("host")), longer_suffixes)
    blocked = materialise(rated.where(F.col("bound") > threshold).select(F.col("host").alias("key"), F.lit(True).alias("poor")), "poor-hosts")
    judged = parsed.withColumn("key", reputation_key(F.col("host"))).join(blocked, "key", "left")
    own = F.when(F.col("poor"), "block").otherwise("allow")
    host, path = F.col("host"), F.col("path")
    return judged.select(F.col("id").alias(id_col), "host", "path", rule_for(host, path, rules, "name").alias("rule"), F.coalesce(rule_for(host, path, rules, "verdict"), own).alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url`` and ``bad``: the last number of a page's path names the labelled document that the page shows."""
    number = F.regexp_extract(path_of(F.col("url")), r"([0-9]+)[^0-9]*$", 1)
    shown = pages.select("url", number.alias("digits")).select("url", F.expr("try_cast(digits as bigint)").alias("doc_id"))
    known = labels.dropna(subset=["doc_id", "quality"]).groupBy("doc_id").agg((F.min("quality") <= 0).cast("long").alias("bad"))
    return shown.join(known, "doc_id").select("url", "bad")


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_urls(pages, labelled_pages(pages, labels))


_FITS = " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: -len(r.name)))
_SAYS = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in RULES)

OP2_SQL = rf"""
WITH parsed AS (
  SELECT page_id, url,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
keyed AS (SELECT *, regexp_replace(regexp_replace(host, '^[\s\S]*@', ''), '\.?(:[0-9]*)?\z', '') AS key FROM parsed),
known AS (SELECT doc_id, (min(quality) <= 0)::BIGINT AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
outcomes AS (
  SELECT key AS host, count(*) AS n, sum(bad) AS bad
  FROM keyed JOIN known ON doc_id = TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) GROUP BY key),
hosts0 AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, regexp_matches(host, '{ADDRESS}') AS address, string_split(host, '.') AS labels,
         regexp_extract(host, '{suffix_pattern(LONGER_SUFFIXES)}', 1) AS longer
  FROM (SELECT DISTINCT key AS host FROM keyed) LEFT JOIN outcomes USING (host)),
hosts AS (
  SELECT host, n, bad, CASE WHEN address THEN 'address' WHEN longer <> '' THEN longer ELSE labels[-1] END AS suffix,
         CASE WHEN address THEN host ELSE array_to_string(labels[greatest(1, len(labels) - CASE WHEN longer <> '' THEN len(string_split(longer, '.')) ELSE 1 END):], '.') END AS domain
  FROM hosts0),
base AS (SELECT (coalesce(sum(bad), 0) + 0.5e0) / (coalesce(sum(n), 0) + 1e0) AS p FROM hosts),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(p) AS p FROM hosts, base GROUP BY suffix),
s1 AS (SELECT count(*) FILTER (n > 0) AS k, sum(n) AS total, sum((bad - n * p) ** 2 / (n * p * (1 - p))) FILTER (n > 0) AS off FROM suffixes),
s2 AS (SELECT CASE WHEN total > k AND off > k - 1 THEN least(1e3, greatest(1e0, (total - k) / (off - (k - 1)) - 1)) ELSE 1e3 END AS m FROM s1),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
domains AS (SELECT d.domain, d.n, d.bad, (m * s.p + s.bad - d.bad) / (m + s.n - d.n) AS p FROM d0 d JOIN suffixes s USING (suffix), s2),
d1 AS (SELECT count(*) FILTER (n > 0) AS k, sum(n) AS total, sum((bad - n * p) ** 2 / (n * p * (1 - p))) FILTER (n > 0) AS off FROM domains),
d2 AS (SELECT CASE WHEN total > k AND off > k - 1 THEN least(1e3, greatest(1e0, (total - k) / (off - (k - 1)) - 1)) ELSE 1e3 END AS m FROM d1),
h0 AS (SELECT h.host, h.n, h.bad, (m * d.p + d.bad - h.bad) / (m + d.n - h.n) AS p FROM hosts h JOIN domains d USING (domain), d2),
h1 AS (SELECT count(*) FILTER (n > 0) AS k, sum(n) AS total, sum((bad - n * p) ** 2 / (n * p * (1 - p))) FILTER (n > 0) AS off FROM h0),
h2 AS (SELECT CASE WHEN total > k AND off > k - 1 THEN least(1e3, greatest(1e0, (total - k) / (off - (k - 1)) - 1)) ELSE 1e3 END AS m FROM h1),
rated AS (SELECT host, (m * p + bad) / (m + n) AS mean, m + n AS weight FROM h0, h2),
poor AS (SELECT host FROM rated WHERE mean - {Z}e0 * sqrt(mean * (1 - mean) / (weight + 1)) > {THRESHOLD}e0),
ruled AS (SELECT page_id, host, key, path, CASE {_FITS} END AS rule FROM keyed)
SELECT page_id, host, path, rule,
       CASE rule {_SAYS} ELSE CASE WHEN key IN (SELECT host FROM poor) THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled
"""
