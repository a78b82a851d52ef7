"""URL filter: rules first, else the host's reputation by empirical Bayes.

Labelled page outcomes (1: bad) are counted by host. Every level's rate is a
beta-binomial posterior whose prior is its parent's: all pages -> suffix ->
registered domain -> host. The prior's strength at each level is fitted by
moments over that level's own groups. A host is blocked where the lower
posterior bound of its rate of bad pages is over the threshold; hosts without
labels inherit their domain's posterior, or the suffix's, or the overall one.

DataFrame functions only. Pages are joined with one row a host, and the planner
turns that into a broadcast only where the measured size of the host table allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Two-label public suffixes under which names are registered (fixed values).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn", "co.za")

#: So many rules are tested in one expression; a longer list is joined as a table.
MAX_RULES = 1000


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "/", 1)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Verdict and text of the longest rule that fits, or nulls.

    A rule is "host/path": it fits the host and all its subdomains where the
    path starts with the rule's.
    """
    verdict, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):  # the longest is tested first
        at, _, under = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{under}"))
        verdict, text = F.when(fits, F.lit(kind)).otherwise(verdict), F.when(fits, F.lit(rule)).otherwise(text)
    return verdict, text


def matching_rule_table(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """host, path, rule, kind of the urls(host, path) that a rule fits, by joins: each host with the names above it, then the longest rule."""
    listed = urls.sparkSession.createDataFrame([(k, r, *r.partition("/")[::2]) for k, r in rules], "kind string, rule string, _at string, _under string")
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = pairs.withColumn("_at", F.explode(above)).join(listed, "_at").where(F.startswith("path", F.concat(F.lit("/"), "_under")))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "kind")).alias("best")
    return met.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.kind")


def registered_domain(host: Column) -> Column:
    """The name below the public suffix; numeric addresses and single labels stand for themselves."""
    name = F.regexp_replace(host, r"^[^@]*@|:\d*$", "")
    two, three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    return F.when(name.rlike(r"^\[|^[0-9.]+$"), name).when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def public_suffix(host: Column) -> Column:
    name = F.regexp_replace(host, r"^[^@]*@|:\d*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^\[|^[0-9.]+$"), F.lit("")).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def _strength(groups: DataFrame, least: float, most: float) -> DataFrame:
    """One row: the prior's strength by moments over groups (n, bad, prior mean).

    For a beta-binomial, E[(bad - n m)^2] = n m (1 - m) (1 + (n - 1) r) with
    r = 1 / (strength + 1); summed over groups this is solved for r. Groups that vary
    no more than chance give the greatest strength; no group with two outcomes, the least.
    """
    m, n = F.col("prior"), F.col("n")
    v = n * m * (1 - m)
    sums = groups.agg(F.sum((F.col("bad") - n * m) ** 2).alias("q"), F.sum(v).alias("v"), F.sum(v * (n - 1)).alias("w"))
    r = (F.col("q") - F.col("v")) / F.col("w")
    found = F.when(r > 0, F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), 1 / r - 1))).otherwise(F.lit(float(most)))
    return sums.select(F.when(F.col("w") > 0, found).otherwise(F.lit(float(least))).alias("strength"))


def host_reputation(outcomes: DataFrame, *, least: float = 2.0, most: float = 1000.0, z: float = 1.645) -> DataFrame:
    """host, domain, suffix, n, bad, mean, low, high for every host of `outcomes(host, bad)`.

    low and high are the posterior mean less and plus z posterior deviations.
    Rows with a null outcome count as no outcome but keep their host listed.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    # Stored once: each level's strength is a query of its own over what is below it.
    hosts = stored(hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host"))), "hosts")
    domains = stored(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # With a uniform prior on the overall rate nothing divides by zero.
    total = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))

    def shrunk(groups: DataFrame) -> DataFrame:
        s = F.col("strength")
        out = groups.withColumn("strength", _strength(groups, least, most).scalar())
        return out.withColumn("a", F.col("prior") * s + F.col("bad")).withColumn("b", (1 - F.col("prior")) * s + F.col("n") - F.col("bad")).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))

    s = stored(shrunk(suffixes.withColumn("prior", total.scalar())).select("suffix", F.col("mean").alias("prior")), "suffix-means")
    d = stored(shrunk(domains.join(s, "suffix")).select("suffix", "domain", F.col("mean").alias("prior")), "domain-means")
    h = shrunk(stored(hosts.join(d, ["suffix", "domain"]), "host-priors"))
    a, b = F.col("a"), F.col("b")
    wide = z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return h.select("host", "domain", "suffix", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - wide).alias("low"), F.least(F.lit(1.0), F.col("mean") + wide).alias("high"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", key: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """Judge every row of pages: key, host, path, rule, verdict.

    outcomes(key, bad): labelled outcomes of some pages, bad 0, 1 or null; of
    several outcomes of one page the worst counts. Null urls, urls without ://
    and empty hosts form a host of their own (""). Rows with equal keys are judged
    row by row; a url is read whole, however long. An empty table gives an empty
    result. Columns beyond key and url are not read, so their names cannot clash. Any
    number of rules is exact; of equal rules with two verdicts, block counts.
    """
    rows = pages.select(F.col(key).alias(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    labels = outcomes.groupBy(F.col(key).alias("_k")).agg(F.max("bad").cast("long").alias("_bad"))
    # Outcomes are summed by host before anything is joined on the host.
    known = rows.join(labels, rows[key] == labels["_k"], "left").select("host", F.col("_bad").alias("bad"))
    reputation = host_reputation(known).select(F.col("host").alias("_host"), F.col("low").alias("_low"))
    judged = rows.join(reputation, F.col("host") == F.col("_host"), "left")
    if len(rules) > MAX_RULES:
        table = matching_rule_table(rows, rules).select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("rule").alias("_rule"), F.col("kind").alias("_kind"))
        judged = judged.join(table, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
        verdict, rule = F.col("_kind"), F.col("_rule")
    else:
        verdict, rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("_low") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"))
