"""URL filter by rules and, beyond them, by the empirical-Bayes reputation of hosts.

Labelled pages are counted by host, registered domain and suffix. Each level's bad rates are a beta distribution: the suffix is
shrunk to the rate of all labelled pages, the domain to its suffix, the host to its domain. How many pages a prior is
worth is estimated from the level itself: the spread of its groups' rates beyond what their counts explain, by the method of
moments. A page is blocked when the lower bound of its host's posterior bad rate, mean minus ``z`` deviations, passes ``most_bad``.
A host without labels has its domain's posterior, and so on up; without any label nothing is blocked.

Nulls and edges: a url that is null or has no ``://`` has an empty host and path, fits no rule and is allowed; equal urls get
equal verdicts; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix): a rule fits its host and all subdomains of it.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Public suffixes of two names that a registered domain may stand under.
SUFFIXES = ["ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk"]


def host_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)?", 1)).otherwise("")


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as (text, verdict); null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        text, verdict = F.when(fits, of + start).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def _strength(level: DataFrame, least: float, most: float) -> DataFrame:
    """One row, ``worth``: how many pages the prior of this level is worth. level: n, bad, prior."""
    # Over groups: sum n (rate - prior)^2 = (groups - G/worth) * v roughly, with v the binomial variance of one page.
    v = F.col("prior") * (1 - F.col("prior"))
    seen = level.agg(F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2) / F.col("n")).alias("spread"), F.sum(v).alias("chance"),
                     F.sum((F.col("n") - 1) * v).alias("room"))
    # Beta-binomial: E[spread] = chance + room / (worth + 1).
    return seen.select(F.when(F.col("spread") <= F.col("chance"), most).otherwise(
        F.least(F.lit(most), F.greatest(F.lit(least), F.col("room") / (F.col("spread") - F.col("chance")) - 1))).alias("worth"))


def reputation(outcomes: DataFrame, least: float = 2.0, most: float = 1000.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior beta parameters (a, b) of everything, suffixes, domains and hosts. outcomes: host, bad (0 or 1)."""
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    everything = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior")).filter("prior IS NOT NULL")

    def shrunk(level: DataFrame) -> DataFrame:
        """level has its prior; the joined row of the level's strength is a single one."""
        return level.crossJoin(F.broadcast(_strength(level, least, most))).withColumns({
            "a": F.col("prior") * F.col("worth") + F.col("bad"), "b": (1 - F.col("prior")) * F.col("worth") + F.col("n") - F.col("bad")})

    def prior_of(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"))

    s = shrunk(suffixes.crossJoin(F.broadcast(everything)))
    d = shrunk(domains.join(prior_of(s, "suffix"), "suffix"))
    h = shrunk(hosts.join(prior_of(d, "domain"), "domain"))
    return everything, s.select("suffix", "a", "b"), d.select("domain", "a", "b"), h.select("host", "a", "b")


def lower_bound(a: Column, b: Column, z: float) -> Column:
    n = a + b
    return a / n - z * F.sqrt(a * b / (n * n * (n + 1)))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, bad_bound. outcomes: page_id, bad (0 or 1), for some pages."""
    url = F.coalesce(F.col("url"), F.lit(""))
    read = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = read.join(outcomes.select("page_id", "bad").filter("bad IS NOT NULL"), "page_id").filter("host <> ''")
    _, suffixes, domains, hosts = reputation(labelled)

    # The hosts that occur are far fewer than the pages: bounds are worked out once for each, at the lowest level that has labels.
    seen = read.filter("host <> ''").select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    for key, df, tag in (("host", hosts, "h"), ("domain", domains, "d"), ("suffix", suffixes, "s")):
        seen = seen.join(df.select(key, lower_bound(F.col("a"), F.col("b"), z).alias(tag)), key, "left")
    bounds = seen.select("host", F.coalesce("h", "d", "s").alias("bad_bound"))
    text, verdict = _rule(F.col("host"), F.col("path"), rules)
    judged = read.join(bounds, "host", "left")
    return judged.select("page_id", "host", "path", text.alias("rule"), F.coalesce(
        verdict, F.when(F.col("bad_bound") > most_bad, "block").otherwise("allow")).alias("verdict"), "bad_bound")
