"""URL filtering: written rules first, then the reputation of the host.

Reputation is the share of bad pages by an empirical-Bayes estimate.  Labelled
outcomes are counted by host, registered domain and suffix; each level's
beta-binomial prior has the mean of the level above and a strength fitted to
how much the groups of its own level differ, so a host with few pages leans on
its domain and one with many speaks for itself.  A host is blocked when the
lower bound of its posterior passes a limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.work import settle

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Suffixes of two labels under which names are registered; all others have one label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
#: Limits of a prior's strength, in pages.
STRENGTH = (1.0, 10_000.0)


@dataclass(frozen=True)
class UrlRule:
    """Block or allow a host, its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    block: bool

    def __str__(self) -> str:
        return self.host + self.path


def host(url: str) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _SMALL), F.lit(""))


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def first_rule(rules: Sequence[UrlRule], host_col: Column, path_col: Column) -> tuple[Column, Column]:
    """(rule text, whether it blocks) of the longest rule that fits; null where none does."""
    name, blocks = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host_col == rule.host) | host_col.endswith("." + rule.host)) & path_col.startswith(rule.path)
        name, blocks = F.when(fits, F.lit(str(rule))).otherwise(name), F.when(fits, F.lit(rule.block)).otherwise(blocks)
    return name, blocks


def _suffix_and_domain(host_col: Column) -> tuple[Column, Column]:
    """Suffix (last label, or two of ``LONG_SUFFIXES``) and registered domain (one label more)."""
    last = lambda n: F.substring_index(host_col, ".", -n)
    long = last(2).isin(*LONG_SUFFIXES)
    return F.when(long, last(2)).otherwise(last(1)), F.when(long, last(3)).otherwise(last(2))


def _strength(groups: DataFrame) -> float:
    """Strength of the common beta prior of groups with n pages, bad of them, by the moments of their shares."""
    sums = groups.agg(F.sum("bad").alias("b"), F.sum("n").alias("n"), F.count("*").alias("k"),
                      F.sum(F.col("n") * F.col("n")).alias("nn"),
                      F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")).first()
    low, high = STRENGTH
    if not sums.n or sums.b in (0, sums.n) or sums.k < 2:
        return high
    mean = sums.b / sums.n
    spread = (sums.bb - sums.n * mean * mean) / (mean * (1 - mean))  # sum of n (share - mean)^2, in binomial units
    room = sums.n - sums.nn / sums.n - (sums.k - 1)
    alike = (spread - (sums.k - 1)) / room if room > 0 else 0.0
    return high if alike <= 0 else low if alike >= 1 else min(max(1 / alike - 1, low), high)


def reputation(outcomes: DataFrame, z: float = 2.0) -> DataFrame:
    """host, n, bad, posterior ``mean`` and ``lower`` bound of the bad share, from outcomes (host, bad 0/1 or null).

    Rows without an outcome count as unlabelled: their hosts are rated by the
    levels above.  The bound lies ``z`` standard deviations below the mean.
    """
    suffix, domain = _suffix_and_domain(F.col("host"))
    # One row per host from here on; the hot ones are summed before the shuffle.
    hosts = settle(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
                   .withColumn("suffix", suffix).withColumn("domain", domain))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k_host, k_domain, k_suffix = (_strength(level.where("n > 0")) for level in (hosts, domains, suffixes))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    # Without a single outcome nothing speaks against any host.
    overall = (total[1] + 0.5) / (total[0] + 1.0) if total[0] else 0.0

    def mean(k: float, above: Column) -> Column:
        return (F.col("bad") + k * above) / (F.col("n") + k)

    by_suffix = suffixes.select("suffix", mean(k_suffix, F.lit(overall)).alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", mean(k_domain, F.col("suffix_mean")).alias("domain_mean"))
    alpha = F.col("bad") + k_host * F.col("domain_mean")
    size = F.col("n") + F.lit(k_host)
    share = alpha / size
    return hosts.join(by_domain, "domain").select(
        "host", "n", "bad", share.alias("mean"), (share - z * F.sqrt(share * (1 - share) / (size + 1))).alias("lower"))


def judge(pages: DataFrame, outcome: Column, rules: Sequence[UrlRule], url_col: str = "url", limit: float = 0.1,
          z: float = 2.0) -> DataFrame:
    """The input with host, path, rule and verdict (allow or block).

    A rule decides where one fits; else the host is blocked if the lower bound
    of its bad share exceeds ``limit``.  ``outcome`` is 1 for a bad page, 0 for
    a good one, null for one without a label.  A null url and one without
    ``://`` have an empty host, which is rated like any other.  Input columns
    of the same names are replaced.
    """
    made = {"host", "path", "rule", "verdict"}
    own = pages.withColumn("__bad", outcome.cast("long")).withColumn("__host", host(url_col)).withColumn("__path", path(url_col))
    rated = reputation(own.select(F.col("__host").alias("host"), F.col("__bad").alias("bad")), z).select(
        F.col("host").alias("__rated"), "lower")
    rated = rated.withColumnRenamed("lower", "__lower")
    name, blocks = first_rule(rules, F.col("__host"), F.col("__path"))
    block = F.coalesce(blocks, F.col("__lower") > limit)
    return own.join(rated, F.col("__host") == F.col("__rated"), "left").select(
        *(c for c in pages.columns if c not in made), F.col("__host").alias("host"), F.col("__path").alias("path"),
        name.alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"))
