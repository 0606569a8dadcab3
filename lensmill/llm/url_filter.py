"""URL filter rules, with DataFrame functions only.

Rules are indexed by their rarest literal token. A URL's tokens fetch the rules filed under them,
and only those rules run their regular expression on the URL.

Two kinds of rules share the index:

* site rules, ``host/path``: they fit the host and its subdomains when the URL's path starts with
  the rule's; the longest that fits decides (of equal ones block, then the one given first);
* patterns over host and path, where ``*`` is any run and ``^`` a place between a letter or digit
  and something else, or an end: they decide where no site rule fits, block before allow.

A literal token is a run of ASCII letters and digits that must stand whole in a URL that fits.
How often the rules' tokens occur is counted over all URLs, so each rule is filed under the token
that fetches it least. Distinct URLs are judged once and joined back, so a hot URL costs no more.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns of the method's own verdict: words that name unwanted sites.
PATTERNS = [("block", f"^{word}^") for word in ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "xxx")]
RULE_SCHEMA = "number int, kind string, action string, rule string, tokens array<string>, regex string"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z in lower case; or ''."""
    return F.coalesce(ascii_lower(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, a hash or the end; or ''."""
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def quoted(text: str) -> str:
    """A regular expression (of Java and RE2) for just this text."""
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)


def site_rule(rule: str) -> tuple[list[str], str]:
    """Literal tokens and regular expression of ``host/path``."""
    host, slash, path = rule.partition("/")
    host, path = host.translate(str.maketrans(UPPER, LOWER)), slash + path
    tokens = re.findall("[a-z0-9]+", host) + [t.lower() for t in re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return tokens, rf"^([^/]*\.)?{quoted(host)}{quoted(path) if path else '(/|$)'}"


def pattern_rule(rule: str) -> tuple[list[str], str]:
    """Literal tokens and regular expression of a pattern."""
    tokens = [m[0].lower() for m in re.finditer(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", rule)]
    return tokens, "".join(".*" if c == "*" else "(^|[^A-Za-z0-9]|$)" if c == "^" else quoted(c) for c in rule)


def rule_table(spark: SparkSession, sites: list[tuple[str, str]], patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rules from (action, text) pairs. Large rule sets can come as a table of RULE_SCHEMA instead."""
    rows = []
    for kind, given, parse in (("site", sites, site_rule), ("pattern", PATTERNS if patterns is None else patterns, pattern_rule)):
        for action, rule in given:
            if action not in ("allow", "block"):
                raise ValueError(f"unknown action {action}")
            tokens, regex = parse(rule)
            rows.append((len(rows), kind, action, rule, tokens, regex))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, pattern and verdict.

    rule is the site rule that decided, pattern the pattern that did; at most one is set. verdict
    is its action, else ``allow``. A null URL, or one without ://, has empty host and path, which
    no site rule fits. Repeated URLs get equal results. New columns replace columns of pages that
    have their names; the others stay. Empty pages or rules are fine.
    """
    pages = pages.drop(*[c for c in ("host", "path", "rule", "pattern", "verdict") if c != url_col])
    url = F.col(url_col)
    urls, _ = common.written(pages.select(host_of(url).alias("host"), path_of(url).alias("path")).distinct(), "urls")  # used twice
    tokens = F.array_distinct(F.split(ascii_lower(F.concat("host", "path")), "[^a-z0-9]+"))
    urls = urls.withColumn("token", F.explode(F.concat(F.filter(tokens, lambda t: t != ""), F.array(F.lit("")))))

    # How often each token of a rule occurs; rules without a token are filed under ''.
    number = rules.count()
    named = rules.select("number", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    wanted = common.small(named.select("token").distinct(), number, 100_000)
    seen = urls.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = named.join(seen, "token", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token"))["token"].alias("token"))
    index = common.small(rules.drop("tokens").join(rarest, "number"), number, 100_000)

    fits = urls.join(index, "token").filter(F.expr("concat(host, path) rlike regex"))
    order = F.struct((F.col("kind") == "site").cast("int"), F.when(F.col("kind") == "site", F.length("rule")).otherwise(0), (F.col("action") == "block").cast("int"), -F.col("number"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("kind", "rule", "action"), order).alias("best"))
    of_host, of_path = common.free_names(pages, "host_", "path_")
    best = best.select(
        F.col("host").alias(of_host),
        F.col("path").alias(of_path),
        F.when(F.col("best.kind") == "site", F.col("best.rule")).alias("rule"),
        F.when(F.col("best.kind") == "pattern", F.col("best.rule")).alias("pattern"),
        F.col("best.action").alias("verdict"),
    )
    out = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    out = out.join(best, (F.col("host") == F.col(of_host)) & (F.col("path") == F.col(of_path)), "left").drop(of_host, of_path)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
