"""URL filters by rules and by the reputation of hosts.

Reputation is empirical Bayes: the share of bad pages of a host is shrunk towards that of its registered
domain, the domain's towards that of its public suffix, and the suffix's towards that of all pages. Each
level's prior is a beta distribution whose weight, in pages, follows from how much the level's groups differ
(the within-class correlation of their outcomes). A host is blocked once the lower posterior bound of its bad
share passes a limit, so one bad page does not condemn a large site.

Outcomes are those of single pages: what a rule says, else what the page's own url and html say. A host's name is
part of its urls, but its pages may differ, and then shrinkage decides: a clean page goes with a host of bad ones, and a
bad one stays with a host of clean ones.

DataFrame functions only. Outcomes are summed per host before they are shuffled, and hosts are written once; domains
and suffixes are sums of hosts. The driver gets one row of sums a level, from one query.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import ascii_lower
from cohortspan.llm.decontamination import words_of
from cohortspan.sources.staging import stage

Rule = tuple[str, str, str]  # verdict, host, path

# Second-level labels under which country-code domains are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
# Words in urls and texts that stand for unwanted sites.
SPAM_WORDS = ("ads", "bets", "casino", "gambling", "pills", "porn", "spam", "viagra", "xxx")
SPAM_LABEL = rf"(^|[.-])({'|'.join(SPAM_WORDS)})([.-]|$)"
SPAM_SEGMENT = rf"(^|[/._-])({'|'.join(SPAM_WORDS)})([/._-]|$)"
#: A text is bad from so many unwanted words on, one in so many of all; a page from so many links on, one in so many words.
UNWANTED, UNWANTED_SHARE = 3, 50
LINKS, LINK_SHARE = 20, 3
#: Standard deviations that the lower bound lies below the mean, and the bad share from which a host is blocked.
BOUND, LIMIT = 1.645, 0.5
#: Weights of a prior, in pages, stay within these.
WEIGHTS = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def registered_domain(host: Column) -> Column:
    """The last two labels of a host, or three under country-code second levels."""
    second = "|".join(SECOND_LEVEL)
    return F.regexp_extract(host, rf"([^.]+\.(?:(?:{second})\.[a-z][a-z]|[^.]+))$", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null. Of equally long rules the first wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def parsed(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.withColumn("hit", matching_rule(F.col("host"), F.col("path"), list(reversed(rules)))).select(
        "page_id", "host", "path", "hit.rule", F.col("hit.verdict").alias("ruled")
    )


def outcomes_by_host(outcomes: DataFrame) -> DataFrame:
    """(host, bad) rows with bad 0 or 1 summed: host, domain, suffix, n, bad."""
    summed = outcomes.where("host <> '' AND bad IS NOT NULL").groupBy("host")
    summed = summed.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    domain = F.when(registered_domain(F.col("host")) == "", F.col("host")).otherwise(registered_domain(F.col("host")))
    return summed.withColumn("domain", domain).withColumn(
        "suffix", F.expr("if(instr(domain, '.') > 0, substring(domain, instr(domain, '.') + 1), domain)")
    )


def prior_weight(groups: int, pages: float, bad: float, squares: float, shares: float, rate: float) -> float:
    """Weight in pages of the prior above groups of n pages each, with their sums of n, bad, n * n and bad * bad / n."""
    if groups < 2 or pages <= groups:
        return WEIGHTS[1]
    apart, inside = shares - 2 * rate * bad + rate * rate * pages, bad - shares
    between, within = apart / (groups - 1), inside / (pages - groups)
    typical = (pages - squares / pages) / (groups - 1)
    if between <= within:
        return WEIGHTS[1]
    return min(WEIGHTS[1], max(WEIGHTS[0], (between + (typical - 1) * within) / (between - within) - 1))


def host_reputation(hosts: DataFrame, bound: float = BOUND) -> DataFrame:
    """host, n, bad, mean and lower: posterior mean and lower bound of a host's bad share."""
    hosts = stage(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    levels = {"suffix": suffixes, "domain": domains, "host": hosts}
    tagged = [level.select(F.lit(name).alias("level"), "n", "bad") for name, level in levels.items()]
    sums = reduce(DataFrame.union, tagged).groupBy("level").agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("bad"), F.sum(F.expr("n * n")), F.sum(F.expr("bad * bad / n"))
    )
    found = {level: figures for level, *figures in sums.collect()}
    _, pages, bad, *_ = found.get("suffix", (0, 0.0, 0.0))
    rate = bad / pages if pages else 0.0
    per_suffix, per_domain, per_host = (prior_weight(*found[x], rate) if x in found else WEIGHTS[1] for x in levels)
    suffix_mean = suffixes.selectExpr("suffix", f"(bad + {per_suffix!r}D * {rate!r}D) / (n + {per_suffix!r}D) AS above")
    domain_mean = domains.join(suffix_mean, "suffix").selectExpr(
        "domain", f"(bad + {per_domain!r}D * above) / (n + {per_domain!r}D) AS above"
    )
    posterior = hosts.join(domain_mean, "domain").selectExpr(
        "host", "n", "bad", f"bad + {per_host!r}D * above AS a", f"n - bad + {per_host!r}D * (1 - above) AS b"
    )
    return posterior.selectExpr(
        "host", "n", "bad", "a / (a + b) AS mean", f"a / (a + b) - {bound!r}D * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower"
    )


def page_is_bad(pages: DataFrame) -> Column:
    """Whether a page speaks against its host: by an unwanted word in the url, by many in its text, or as a farm of links.

    A page that says nothing, with null or empty html or without that column, is as good as its url. Tags are no text.
    """
    url = F.col("url")
    spelled = host_of(url).rlike(SPAM_LABEL) | ascii_lower(path_of(url)).rlike(SPAM_SEGMENT)
    if "html" not in pages.columns:
        return spelled
    # A tag ends where the next begins, so an unclosed one costs no more than its length.
    html = F.coalesce("html", F.lit(""))
    words = words_of(F.regexp_replace(html, "<[^<>]*>?", " "))
    links = F.regexp_count(html, F.lit(r"(?i)<a[ \t\r\n]"))
    unwanted = F.size(F.filter(words, lambda word: word.isin(*SPAM_WORDS)))
    wordy = (unwanted >= UNWANTED) & (UNWANTED_SHARE * unwanted >= F.size(words))
    farm = (links >= LINKS) & (LINK_SHARE * links >= F.size(words))
    return spelled | wordy | farm


def page_outcomes(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(host, bad) of every page, bad 0 or 1: the rule's verdict, else what the page itself says."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = matching_rule(host, path, list(reversed(rules)))["verdict"]
    bad = F.when(ruled.isNotNull(), ruled == "block").otherwise(page_is_bad(pages))
    return pages.select(host.alias("host"), bad.cast("int").alias("bad"))


def judge(
    pages: DataFrame, rules: Sequence[Rule], outcomes: DataFrame | None = None, bound: float = BOUND, limit: float = LIMIT
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``outcomes`` has (host, bad) rows with bad 0 or 1. Without it they are ``page_outcomes``, from url and, if there
    is such a column, html. A page without a rule is blocked if its host's lower bound passes ``limit``, whatever the page
    itself looks like; a page without a host is allowed. Null urls and urls without ``://`` have an empty host and path. Repeated
    rows are judged and counted each.
    """
    judged = parsed(pages, rules)
    outcomes = page_outcomes(pages, rules) if outcomes is None else outcomes
    blocked = host_reputation(outcomes_by_host(outcomes), bound).where(F.col("lower") > limit).select("host", F.lit("block").alias("reputed"))
    return judged.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "reputed", F.lit("allow")).alias("verdict")
    )
