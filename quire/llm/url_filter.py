"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled pages are counted as good or bad per host. A host's rate is a beta-binomial
posterior whose prior is centred on its registered domain's posterior mean, which itself
is shrunk to its suffix, and that to the rate of all labelled pages. How strongly each
level pulls is estimated from how far its groups' rates spread beyond binomial noise.
A page passes if the lower bound of its host's posterior reaches the threshold.

DataFrame functions only. Counts are aggregated per host before anything is joined, so a
host with a third of all pages is one row there; pages meet hosts in an equi-join that
adaptive execution splits.

Defined results: a url that is null or has no `://` has an empty host and path, which is
a host like any other; a page without a label counts for nothing; a host without labelled
pages has its domain's rate; with no labels at all the rate is 0.5 and the strength 1.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
THRESHOLD, Z = 0.5, 1.645
#: Bounds of a level's strength, in pseudo-pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does. rules: (verdict, host/path)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        own, slash, below = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + below)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def levels(hosts: DataFrame) -> DataFrame:
    """Adds domain and suffix to rows with a host."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - (k - 1), F.lit(1)), F.least(n, F.lit(k))), ".")
    two = last(2).isin(*TWO_LABEL_SUFFIXES)
    return hosts.withColumns({"suffix": F.when(two, last(2)).otherwise(last(1)), "domain": F.when(two, last(3)).otherwise(last(2))})


def _strength(groups: DataFrame, n: int, good: int) -> float:
    """From the spread of the groups' rates (method of moments), as a few sums."""
    if not n:
        return WEAKEST
    sums = groups.where("n > 0").agg(F.count(F.lit(1)).alias("g"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("s"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    noise = good / n * (1 - good / n)
    own = noise * (n - sums["nn"] / n - (sums["g"] - 1))
    rho = (sums["s"] - good * good / n - noise * (sums["g"] - 1)) / own if own else 0.0
    return min(max(1 / rho - 1, WEAKEST), STRONGEST) if rho > 0 else STRONGEST


def reputation(pages: DataFrame) -> DataFrame:
    """pages: host, good (1, 0 or null). Per host: rows, domain, suffix, n, mean, bound."""
    counted = pages.groupBy("host").agg(F.count(F.lit(1)).alias("rows"), F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good"))
    hosts = levels(common.written(counted, "hosts"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = hosts.groupBy("domain").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    of_host, of_domain, of_suffix = (_strength(x, n, good) for x in (hosts, domains, suffixes))
    shrunk = lambda k, prior: (F.col("good") + F.lit(k) * prior) / (F.col("n") + F.lit(k))
    suffixes = suffixes.select("suffix", shrunk(of_suffix, F.lit(good / n if n else 0.5)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(of_domain, F.col("suffix_mean")).alias("domain_mean"))
    mean = shrunk(of_host, F.col("domain_mean"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(of_host) + 1))
    return hosts.join(domains, "domain").select("host", "rows", "domain", "suffix", "n", mean.alias("mean"), (mean - F.lit(Z) * sd).alias("bound"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """pages: page_id, url, good (1, 0 or null). Per page: page_id, host, path, rule, verdict, mean, bound."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "good")
    held = common.written(reputation(rows.select("host", "good")).select("host", "rows", "mean", "bound"), "reputation")
    hot = F.broadcast(held.orderBy(F.desc("rows"), "host").limit(common.HOT_KEYS))  # hosts of many rows, a bounded number
    asked = rows.drop("good")
    judged = asked.join(hot, "host").unionByName(asked.join(hot, "host", "left_anti").join(held, "host")).drop("rows")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return judged.withColumn("_rule", rule).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "mean", "bound")


def joined_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages (page_id, url) with good = the quality label of the document whose number ends
    the url's path; of labels that repeat an id the largest counts."""
    _, path = host_and_path(F.col("url"))
    number = F.expr("try_cast(_n as bigint)")
    numbered = pages.select("page_id", "url", F.regexp_extract(path, r"(\d+)(?:\.html)?/?$", 1).alias("_n")).withColumn("_doc", number).drop("_n")
    quality = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("quality").alias("good"))
    return common.join_unique(numbered, quality, "_doc", "left").select("page_id", "url", "good")

