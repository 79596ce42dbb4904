"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted for hosts, registered domains and suffixes.  Rates are shrunk from the whole table to
suffix, to registered domain, to host by beta-binomial priors; the strength of each level's prior comes from how much the
rates of that level differ (method of moments).  A host is blocked if the lower posterior bound of its bad rate is too high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage

#: Up to so many rules are one expression; more are joined, with equal results.
MANY = 200
#: (action, host, path prefix)
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Labels under which a country's registry gives out names.
SECOND_LEVEL = r"(?:^|\.)(?:ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z][a-z]$"
#: Numbers and dots, or an address in brackets.
ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+)+|\[.*\])$"


def _bare(host: Column) -> Column:
    """Without the port."""
    return F.regexp_replace(host, r":[0-9]+$", "")


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, three under a country's second level; an address is its own."""
    h = _bare(host)
    return F.when(h.rlike(ADDRESS), h).when(h.rlike(SECOND_LEVEL), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def suffix_of(host: Column) -> Column:
    """The last label, two under a country's second level; an address has none."""
    h = _bare(host)
    return F.when(h.rlike(ADDRESS), F.lit("")).when(h.rlike(SECOND_LEVEL), F.substring_index(h, ".", -2)).otherwise(F.substring_index(h, ".", -1))


def match_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits: its host is the url's or a parent of it, its path a prefix of the url's."""
    rule = action = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def join_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (host, path, ...) with rule and action as ``match_rules`` finds them, for any number of rules: each distinct host
    and path meets the rules of its parent hosts by equality."""
    table = rows.sparkSession.createDataFrame([(h, p, what, len(h) + len(p), n) for n, (what, h, p) in enumerate(rules)], "parent string, prefix string, what string, size int, n int")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = rows.select("host", "path").distinct()
    met = pairs.select("host", "path", F.explode(parents).alias("parent")).join(table, "parent").filter("startswith(path, prefix)")
    best = met.groupBy("host", "path").agg(F.max(F.struct("size", "n", "parent", "prefix", "what")).alias("b"))
    return rows.join(best.select("host", "path", F.concat("b.parent", "b.prefix").alias("rule"), F.col("b.what").alias("action")), ["host", "path"], "left")


def small(table: DataFrame, row_bytes: int = 64, most_bytes: int = 8 << 20) -> DataFrame:
    """``table`` marked for broadcast if its rows, of about ``row_bytes`` each besides their key, have no more than ``most_bytes``;
    beyond, a join of it may be split where it is skewed."""
    return F.broadcast(table) if table.count() * (row_bytes + 40) <= most_bytes else table


def _strength(level: DataFrame) -> float:
    """Prior strength from the spread of rates about their parents' means: n, k, m for each group."""
    got = level.agg(
        F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 - F.col("n") * F.col("m") * (1 - F.col("m"))).alias("extra"),
        F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m"))).alias("base"),
    ).first()
    rho = (got.extra or 0.0) / got.base if got.base else 0.0
    return 1 / min(max(rho, 1e-3), 0.5) - 1


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, k, rate, lower: posterior mean and lower bound of the bad rate of each host.

    ``outcomes``: host, bad (0 or 1; null: not labelled, counted in no rate).  Hosts without labelled pages get their
    domain's rate.  Counts are partial sums, so a host with most of the rows is no hot spot.
    """
    hosts = stage(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    total = hosts.agg(F.sum("n"), F.sum("k")).first()
    mean = (total[1] + 0.5) / (total[0] + 1) if total[0] else 0.5
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(mean))
    s = _strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("k") + s * F.col("m")) / (F.col("n") + s)).alias("m"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    s = _strength(domains)
    domains = stage(domains.select("domain", ((F.col("k") + s * F.col("m")) / (F.col("n") + s)).alias("m")))
    level = hosts.join(domains, "domain")
    s = _strength(level)
    rate = (F.col("k") + s * F.col("m")) / (F.col("n") + s)
    return level.select("host", "n", "k", rate.alias("rate"), (rate - z * F.sqrt(rate * (1 - rate) / (F.col("n") + s + 1))).alias("lower"))


def junk_outcome(html: Column) -> Column:
    """1 if a page has more symbols ``#*$%&|<>`` in its text than a tenth of its words, else 0; null for null pages."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    text = F.regexp_replace(text, r"&[a-zA-Z]+;", "")
    return (10 * F.regexp_count(text, F.lit(r"[#*$%&|<>]")) > F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("int")


def judge_urls(pages: DataFrame, rules: list[Rule], outcome: Column, max_bad: float = 0.1, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, rate, lower for each row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path, fits no rule and is judged as the host "".  Of rules of one
    length the last wins.  Repeated rows count each for itself.  An empty table gives an empty result.  Columns other than
    the id, the url and those of ``outcome`` are not read.
    """
    u = pages[url]
    rows = stage(pages.select(pages[page_id].alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), outcome.alias("bad")))
    known = stage(reputation(rows).select("host", "rate", "lower"))
    rule, action = match_rules(F.col("host"), F.col("path"), rules[:MANY])
    judged = (rows.withColumns({"rule": rule, "action": action}) if len(rules) <= MANY else join_rules(rows, rules)).join(small(known), "host")
    verdict = F.coalesce("action", F.when(F.col("lower") > max_bad, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "rate", "lower")
