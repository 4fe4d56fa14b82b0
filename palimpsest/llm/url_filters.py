"""Operator 6, URL filters: rules first, then empirical-Bayes host reputation.

A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest that fits decides.
Else the reputation of the page's host does: labelled page outcomes (good or not) are counted by host, registered domain and
suffix; each level's beta-binomial concentration is estimated from how much its groups differ; counts are shrunk from suffix
to registered domain to host. A host without a labelled page has n = k = 0 and so its domain's mean, or its suffix's, or the
world's. A host is blocked if even the upper bound of its share of good pages is below `least_good`.

Hosts are grouped without user part and port; the column `host` keeps both. Null or malformed urls (no `://`) have empty host and path; they share the reputation of the empty host. A page labelled more
than once counts once, as good only if all its labels are. Without labels everything that no rule blocks is allowed. Rows may
repeat. A column named like an output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

#: (verdict, rule): a host, and from its first slash on the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A suffix is a host's last label; two labels where the last is a country's (two letters) and the one before is one of these.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
LONG_SUFFIX = rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"
LEAST_GOOD = 0.5
#: Standard deviations from the posterior mean to its bound.
DEVIATIONS = 1.645
#: The share of variance between groups is held in these bounds.
BETWEEN = (0.001, 0.5)


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(at > 0, F.translate(host, upper, upper.lower())).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def site_of(host: Column) -> Column:
    """The host by which pages are grouped: without user part and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def last_labels(host: Column, n: Column | int) -> Column:
    return F.substring_index(host, ".", -n)


def domain_of(host: Column) -> Column:
    return F.when(F.regexp_like(host, F.lit(LONG_SUFFIX)), last_labels(host, 3)).otherwise(last_labels(host, 2))


def suffix_of(host: Column) -> Column:
    return F.when(F.regexp_like(host, F.lit(LONG_SUFFIX)), last_labels(host, 2)).otherwise(last_labels(host, 1))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null; looks up the host's suffixes, not every rule."""
    by_host: dict[str, list] = {}
    for verdict, rule in rules:
        site, slash, start = rule.partition("/")
        by_host.setdefault(site, []).append(F.struct(F.lit(slash + start).alias("start"), F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    known = F.create_map(*(x for site, found in by_host.items() for x in (F.lit(site), F.array(*found))))
    labels = F.split(host, r"\.")
    sites = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.filter(F.transform(sites, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())), lambda r: F.startswith(path, r.start))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r.length.alias("length"), r.rule.alias("rule"), r.verdict.alias("verdict"))))
    return F.when(best.isNotNull(), F.struct(best.rule.alias("rule"), best.verdict.alias("verdict")))


def _level(counts: DataFrame, group: str, parent: str) -> DataFrame:
    """One row (world, weight): the concentration of a level's labelled groups about their parents' shares, by moments."""
    counts = counts.filter("n > 0")
    above = counts.groupBy(parent).agg(F.sum("n").alias("pn"), F.sum("k").alias("pk"))
    pairs = counts.select(group, parent, "n", "k").join(above, parent)
    p = F.col("pk") / F.col("pn")
    spread = p * (1 - p)
    alone = 1 - F.col("n") / F.col("pn")
    excess = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2) - spread * alone)
    whole = F.sum(F.col("n") * alone * spread)
    share = F.greatest(F.lit(BETWEEN[0]), F.least(F.lit(BETWEEN[1]), F.coalesce(F.try_divide(excess, whole), F.lit(BETWEEN[0]))))
    return F.broadcast(pairs.groupBy(F.lit("").alias("world")).agg((1 / share - 1).alias("weight")))


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, mean, bound (the upper one) from one row a page: host, good (0 or 1, null if not labelled). No rows without labels."""
    # Pages are read once; all levels come from one row a host.
    hosts = cut(outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k")))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))).withColumn("world", F.lit(""))
    domains = hosts.groupBy("domain", "suffix", "world").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix", "world").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    shrunk = lambda prior: (F.col("weight") * prior + F.col("k")) / (F.col("weight") + F.col("n"))
    # The weights and the world's mean are one row each.
    world = F.broadcast(suffixes.groupBy("world").agg(F.try_divide(F.sum("k"), F.sum("n")).alias("mean0")))
    s = suffixes.join(_level(suffixes, "suffix", "world"), "world").join(world, "world").select("suffix", shrunk(F.col("mean0")).alias("mean_s"))
    d = domains.join(_level(domains, "domain", "suffix"), "world").join(s, "suffix").select("domain", shrunk(F.col("mean_s")).alias("mean_d"))
    h = hosts.join(_level(hosts, "host", "domain"), "world").join(d, "domain")
    alpha, total = F.col("weight") * F.col("mean_d") + F.col("k"), F.col("weight") + F.col("n")
    mean = alpha / total
    return h.select("host", mean.alias("mean"), (mean + DEVIATIONS * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bound"))


def url_filters(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, least_good: float = LEAST_GOOD) -> DataFrame:
    """pages with host, path, rule and verdict. labels: doc_id (a page's id), quality, toxic.

    The bound holds for every host of pages, by its domain's, suffix's or the world's outcomes where it has none of its own.
    """
    split = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    outcome = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))
    outcomes = split.select(F.col(page_id).alias("doc_id"), site_of(F.col("host")).alias("host")).distinct().join(outcome, "doc_id", "left").select("host", "good")
    known = reputation(outcomes).select(F.col("host").alias("__host"), F.col("bound").alias("__bound"))
    judged = split.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules)).join(known, site_of(F.col("host")) == F.col("__host"), "left")
    method = F.when(F.col("__bound") < least_good, "block").otherwise("allow")
    return judged.withColumn("rule", F.col("__rule.rule")).withColumn("verdict", F.coalesce(F.col("__rule.verdict"), method)).drop("__host", "__bound", "__rule")
