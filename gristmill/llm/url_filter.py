"""URL rules and an empirical-Bayes reputation of hosts, in SQL expressions only.

A host's share of good pages is shrunk towards its registered domain's, that towards its suffix's,
and that towards the share over all pages, each through a beta prior whose strength is estimated
from how much the children of a level differ. A host is blocked when even the upper posterior
bound of its good share is below what is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expressions import col, require_columns

from .common import join_without_hot_keys, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Beta priors are worth between this many pages, whatever the estimate.
PRIOR_RANGE = (1.0, 1000.0)
# Standard deviations from the posterior mean to its bound.
BOUND_WIDTH = 2.0
MIN_GOOD = 0.5

LEVELS = ("host", "domain", "suffix")


class UrlRule(NamedTuple):
    """allow or block for a host with its subdomains and paths that start with `path`."""

    verdict: str
    pattern: str  # host and path, like net/es/

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.pattern.partition("/")[1:])


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty for a missing url or one without ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw_host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw_host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The longest rule that fits, as struct(pattern, verdict); null if none does."""
    chosen = None
    for rule in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<pattern:string,verdict:string>")


def host_levels(host: Column) -> dict[str, Column]:
    """Registered domain (the last two labels) and suffix (the last label) of a host."""
    return {"domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def reputations(outcomes: DataFrame) -> DataFrame:
    """One row per host from rows (host, good): pages, good share bounds after shrinking.

    `good` is 1 or 0, or null where a page has no label; such pages count nowhere. Columns: host,
    n_labelled, mean, lower, upper.
    """
    labelled = F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k")
    # One row per host. All levels are summed up from it, so the pages are read once.
    hosts = written(outcomes.groupBy("host").agg(*labelled), "host-counts").withColumns(host_levels(F.col("host")))
    total, up = (F.sum("n").alias("n"), F.sum("k").alias("k")), {}
    up["domain"] = hosts.groupBy("domain", "suffix").agg(*total)
    up["suffix"] = up["domain"].groupBy("suffix").agg(*total)
    everything = up["suffix"].agg(*total).first()
    n_all, k_all = everything["n"] or 0, everything["k"] or 0
    # Without any label every share is 1/2.
    overall = F.lit((k_all + 1.0) / (n_all + 2.0) if n_all == 0 else k_all / n_all)

    suffix = up["suffix"].withColumn("prior", overall)
    suffix = _shrunk(suffix, _strength(suffix)).select("suffix", F.col("mean").alias("prior"))
    domain = up["domain"].join(suffix, "suffix")
    domain = _shrunk(domain, _strength(domain)).select("domain", F.col("mean").alias("prior"))
    host = hosts.join(domain, "domain")
    host = _shrunk(host, _strength(host))
    return host.select("host", F.col("n").alias("n_labelled"), "mean", "lower", "upper")


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule], min_good: float = MIN_GOOD
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, n_labelled and upper (of its host).

    pages has page_id and url; outcomes has rows (host, good). The verdict is that of the longest rule
    that fits; without one it is block where the host's upper bound is below min_good, else
    allow. A missing url, or one without ://, has an empty host, which is judged like any other.
    Repeated rows are judged each; other columns are left out.
    """
    require_columns(pages, "page_id", "url")
    host, path = url_parts(col("url"))
    parsed = pages.select(col("page_id"), host.alias("host"), path.alias("path"))
    judged = join_without_hot_keys(parsed, reputations(outcomes), "host")
    judged = judged.withColumn("matched", matching_rule(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("upper") < min_good, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("matched.pattern").alias("rule"),
        F.coalesce(F.col("matched.verdict"), by_host).alias("verdict"),
        F.coalesce("n_labelled", F.lit(0)).cast("long").alias("n_labelled"),
        F.round("upper", 6).alias("upper"),
    )


def html_outcome(html: Column, max_symbols: float = 0.02, min_words: int = 20) -> Column:
    """1 for a page of prose, 0 for one that is short or full of symbols; null without html."""
    visible = F.regexp_replace(html, "<(script|style)[^>]*>[^<]*|<[^>]*>", " ")
    visible = F.regexp_replace(F.regexp_replace(visible, "&[a-z]+;", "&"), r"[ \t\n\r]+", " ")

    def good(text: Column) -> Column:
        letters = F.length(text)
        symbols = letters - F.length(F.regexp_replace(text, "[#*$%&|!]+", ""))
        words = letters - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
        return ((words >= min_words) & (symbols <= letters * F.lit(max_symbols))).cast("int")

    # As the argument of a function the text is made once per page, not once per use.
    return F.when(html.isNotNull(), F.transform(F.array(F.trim(visible)), good)[0])


def _strength(level: DataFrame) -> float:
    """Pages that the prior of a level is worth, by the method of moments.

    The children's squared distances from their priors hold sampling variance m(1-m)/n and the
    variance between children; what is left of it gives the prior's strength m(1-m)/between - 1.
    """
    m = F.col("prior")
    share = F.col("k") / F.col("n")
    row = (
        level.where(F.col("n") > 0)
        .agg(
            F.sum(F.col("n") * (share - m) * (share - m)).alias("spread"),
            F.sum(m * (1 - m)).alias("sampling"),
            F.sum(F.col("n") * m * (1 - m)).alias("weighted"),
            F.sum("n").alias("n"),
        )
        .first()
    )
    low, high = PRIOR_RANGE
    if not row["n"]:
        return low
    between = (row["spread"] - row["sampling"]) / row["n"]
    if between <= 0:
        return high
    return min(high, max(low, row["weighted"] / row["n"] / between - 1))


def _shrunk(level: DataFrame, strength: float) -> DataFrame:
    a = F.col("k") + strength * F.col("prior")
    b = F.col("n") - F.col("k") + strength * (1 - F.col("prior"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    mean = a / (a + b)
    return level.withColumns(
        {
            "mean": mean,
            "lower": F.greatest(F.lit(0.0), mean - BOUND_WIDTH * deviation),
            "upper": F.least(F.lit(1.0), mean + BOUND_WIDTH * deviation),
        }
    )


def parse_rules(text: str) -> list[UrlRule]:
    """Rules from lines or comma-separated parts such as `allow com/`."""
    return [UrlRule(*part.split()) for part in re.split(r"[,\n]", text) if part.strip()]
