"""URL filters with redirect equivalence (operator 4), in DataFrame functions only.

A url's node is its host and path. Redirects (``<meta http-equiv=refresh>`` and
a given table of redirects) and ``<link rel=canonical>`` tie nodes; connected
components over those edges are found by alternating large-star and small-star
joins. A component with a node that a rule blocks is blocked; the decision
reaches every alias in it that no rule names. A rule on the url itself comes
first, so an explicit allow is never overridden by a blocked alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, stored

#: The contract's rules: (host, path, verdict).
RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rules(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, said in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _tag_target(html: Column) -> Column:
    """The targets of a page's canonical links and refreshes, as written."""
    link = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), 1)
    meta = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), 1)
    href = F.transform(link, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    url = F.transform(meta, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    return F.filter(F.concat(href, url), lambda t: t != "")


def _resolved(host: Column, path: Column, target: Column) -> tuple[Column, Column]:
    """Host and path of a target as seen from a page. Absolute, scheme-relative, rooted and relative forms."""
    absolute = F.when(target.contains("://"), target).when(target.startswith("//"), F.concat(F.lit("x:"), target))
    plain = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    local = F.when(target.startswith("/"), plain).when(plain == "", path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), plain))
    return F.when(absolute.isNotNull(), host_of(absolute)).otherwise(host), F.when(absolute.isNotNull(), path_of(absolute)).otherwise(local)


def link_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (a_host, a_path, b_host, b_path) between different urls: canonical links and refreshes of pages, and redirects (from_url, to_url)."""
    marked = pages.where(F.col("html").rlike(r"(?i)canonical|refresh") & F.col("url").contains("://"))
    found = marked.select(host_of(F.col("url")).alias("a_host"), path_of(F.col("url")).alias("a_path"), F.explode(_tag_target(F.col("html"))).alias("target"))
    to = _resolved(F.col("a_host"), F.col("a_path"), F.col("target"))
    edges = found.select("a_host", "a_path", to[0].alias("b_host"), to[1].alias("b_path"))
    if redirects is not None:
        ends = [f(F.col(c)).alias(f"{x}_{n}") for x, c in (("a", "from_url"), ("b", "to_url")) for n, f in (("host", host_of), ("path", path_of))]
        edges = edges.unionByName(redirects.where(F.col("from_url").contains("://") & F.col("to_url").contains("://")).select(*ends))
    return edges.where("a_host != '' and b_host != '' and not (a_host = b_host and a_path = b_path)").distinct()


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block).

    Null urls and urls without :// have empty host and path, fit no rule and
    are allowed. A null html has no links. Urls and pages of any length are
    read whole. Repeated pages are judged each. Of two rules of one length that
    fit a url the greater (host, path) wins. Other columns are ignored. An
    empty table gives no rows.
    """
    node = lambda h, p: F.concat(h, p)  # noqa: E731  a host holds no slash and a path starts with one, so this is one to one
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = _rules(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("own"))

    edges = stored(link_edges(pages, redirects), "aliases")
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    ends = edges.select(node(F.col("a_host"), F.col("a_path")).alias("a"), node(F.col("b_host"), F.col("b_path")).alias("b"))
    component = connected_components(ends, "a", "b")  # without the smallest nodes, which are their own component
    named = edges.select(F.col("a_host").alias("host"), F.col("a_path").alias("path")).union(edges.select("b_host", "b_path")).distinct()
    blocked = named.where(_rules(F.col("host"), F.col("path"), rules)[1] == "block").select(node(F.col("host"), F.col("path")).alias("node"))
    bad = stored(blocked.join(component, "node", "left").select(F.coalesce("component", "node").alias("component")).distinct(), "blocked")
    aliases = stored(component.join(bad, "component").select("node").unionByName(bad.select(F.col("component").alias("node"))).distinct(), "blocked-aliases")
    out = judged.withColumn("node", node(F.col("host"), F.col("path"))).join(aliases.withColumn("hit", F.lit(True)), "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"))
