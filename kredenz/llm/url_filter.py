"""URL verdicts from rules, spread over redirect and canonical-link aliases. DataFrame operations only.

A rule ``(verdict, host, path)`` fits its host and all subdomains if the url's path
starts with the rule's path; the longest ``host + path`` wins, allow before block at
equal length. Pages without a rule of their own take the decision of their aliases:
block if any alias in the same connected component is blocked by a rule, else allow.
An explicit allow always stands: it is never overruled by a blocked alias.

Aliases are connected by ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` edges
in the html. Urls that differ in scheme, a leading ``www.`` or ``m.``, a trailing slash or
``.html``, a fragment or tracking parameters only are one node.

Null urls and urls without ``://`` have empty host and path, no rule, no aliases, and are
allowed. Null and empty html has no links. Repeated pages give one row each; null ids stay, very long html is
read once, and other columns are not read, whatever their names. An empty table gives no rows. A url
that a third of all pages share is one node; pages meet the blocked nodes in one
equi-join of checkpointed tables, which adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kredenz.llm.components import components
from kredenz.runtime import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
TRACKING = r"(^\?|&)(utm_[^&=]*|ref|fbclid|gclid)=[^&]*"
LINK, META = r"(?is)<link\s[^<>]*>", r"(?is)<meta\s[^<>]*>"  # a tag that is never closed ends at the next
CANONICAL, REFRESH = r"(?i)\srel\s*=\s*[\"']?canonical[\"'\s/>]", r"(?i)\shttp-equiv\s*=\s*[\"']?refresh[\"'\s/>]"
HREF, TARGET = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)", r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """One name for all forms of an address; null without ``://``."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html)$", "")
    query = F.regexp_replace(F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit("")), TRACKING, "")
    query = F.regexp_replace(query, r"^[?&]", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def linked_urls(html: Column, tag: str, kind: str, target: str) -> Column:
    """Targets of all tags of that kind; empty text for a tag without one."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))
    return F.transform(tags, lambda t: F.replace(F.regexp_extract(t, target, 1), F.lit("&amp;"), F.lit("&")))


def absolute(url: Column, target: Column) -> Column:
    base = F.concat(F.lit("http://"), host_of(url))
    return (
        F.when(target == "", None)
        .when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(base, F.regexp_replace(path_of(url), r"[^/]*$", ""), target))
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``(size, allow, rule)``, or null."""
    if not rules:
        return F.lit(None).cast("struct<size:int,allow:boolean,rule:string>")
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(verdict == "allow").alias("allow"), F.lit(h + p).alias("rule")),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``."""
    url, html = F.col("url"), F.col("html")
    named = pages.select("page_id", url, html, host_of(url).alias("host"), path_of(url).alias("path")).select(
        "page_id",
        "host",
        "path",
        fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"),
        node_of(url).alias("node"),
        F.when(F.instr(url, "://") > 0, F.transform(
            F.concat(linked_urls(html, LINK, CANONICAL, HREF), linked_urls(html, META, REFRESH, TARGET)),
            lambda target: node_of(absolute(url, target)),
        )).alias("targets"),
    )
    known = pin(named.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.allow").alias("allow"), "node", "targets"))
    groups = components(known.select(F.col("node").alias("u"), F.explode("targets").alias("v")))
    nodes = known.where("node IS NOT NULL").groupBy("node").agg(F.coalesce(F.bool_or(~F.col("allow")), F.lit(False)).alias("stopped"))
    placed = nodes.join(groups, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "stopped")
    placed = pin(placed)
    stopped = placed.groupBy("label").agg(F.bool_or("stopped").alias("hit")).where("hit").select("label")
    blocked = pin(placed.join(pin(stopped), "label", "left_semi").select("node", F.lit(True).alias("blocked")))
    verdict = F.when(F.coalesce("allow", ~F.coalesce("blocked", F.lit(False))), "allow").otherwise("block")
    return known.join(blocked, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
