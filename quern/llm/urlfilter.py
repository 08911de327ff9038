"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Outcomes of labelled pages are counted per host, registered domain and suffix. The prior of each
level is a beta distribution around the level above: its mean is the parent's posterior mean, its
weight is found from the data by moments. A host is blocked if the lower bound of its posterior rate
of bad pages lies above the threshold. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize

#: (host, path prefix, verdict); a rule fits its host and all subdomains.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Labels before a two-letter country suffix that belong to the suffix.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"(?s)^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def registered_domain(host: Column) -> Column:
    """The last two labels, or three where the last two are a country's second level."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    deep = (n >= 3) & (F.char_length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin(SECOND_LEVEL)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), n - F.when(deep, 2).otherwise(1)), 3), ".")


def suffix(host: Column) -> Column:
    """What follows the registered domain's first label."""
    return F.regexp_replace(registered_domain(host), r"^[^.]*\.", "")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; equally long ones: the first by name."""
    best = F.lit(None)
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, found).otherwise(best)
    return best


def _weight(level: DataFrame, mean: str) -> float:
    """The weight of a level's beta prior by moments of its groups around their means, from 1 to 1000."""
    m = F.col(mean)
    r = (
        level.where((F.col("n") > 1) & (m > 0) & (m < 1))
        .agg(
            F.sum(F.pow(F.col("bad") - F.col("n") * m, 2) / (m * (1 - m)) - F.col("n")).alias("excess"),
            F.sum(F.col("n") * (F.col("n") - 1.0)).alias("pairs"),
        )
        .first()
    )
    if not r["pairs"]:
        return 10.0
    rho = min(max(r["excess"] / r["pairs"], 0.001), 0.5)  # share of variance between groups
    return min(max(1 / rho - 1, 1.0), 1000.0)


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, bad_rate and bad_low (lower posterior bound) from outcomes (host, bad 0/1, null: not labelled).

    Hosts without labelled pages take their domain's posterior; empty outcomes give an empty table.
    """
    bad = F.col("bad").cast("double")
    hosts = materialize(
        outcomes.groupBy("host").agg(F.count(bad).cast("double").alias("n"), F.coalesce(F.sum(bad), F.lit(0.0)).alias("bad")),
        "hosts",
    ).withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    top = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((top["bad"] or 0.0) + 0.5) / ((top["n"] or 0.0) + 1.0)

    def posterior(level: DataFrame, prior: Column, out: str) -> DataFrame:
        level = level.withColumn("prior", prior)
        k = _weight(level, "prior")
        return level.withColumn(out, (F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).withColumn(
            f"{out}_weight", F.col("n") + k
        )

    suffixes = materialize(posterior(hosts.groupBy("suffix").agg(*sums), F.lit(overall), "suffix_rate"), "suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", "suffix_rate"), "suffix")
    domains = materialize(posterior(domains, F.col("suffix_rate"), "domain_rate"), "domains")
    hosts = hosts.join(domains.select("domain", "domain_rate"), "domain")
    hosts = posterior(hosts, F.col("domain_rate"), "bad_rate")
    spread = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("bad_rate_weight") + 1))
    return materialize(
        hosts.select("host", "bad_rate", (F.col("bad_rate") - z * spread).alias("bad_low")), "reputation"
    )


def judge(pages: DataFrame, labels: DataFrame, threshold: float = 0.5, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_low of every page.

    A labelled outcome is the label of the page's own id: bad if its quality is 0 or it is toxic.
    Pages without a host are allowed unless a rule fits. Repeated rows each get a row; two labels of
    one id: bad if one says so. Extra columns are ignored; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = ((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int")
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    known = materialize(known.groupBy("page_id").agg(F.max("bad").alias("bad")), "page-labels")
    rated = reputation(split.where("host != ''").join(known, "page_id", "left"))
    out = split.join(rated, "host", "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    mine = F.when(F.col("bad_low") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), mine).alias("verdict"),
        "bad_rate",
        "bad_low",
    )
