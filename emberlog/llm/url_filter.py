"""URL filter by rules and redirect equivalence.

A page's own rule decides first. Pages that redirect to one another, or name one another as canonical, are
one resource: distributed connected components over those edges carry a block to every alias that has no
rule of its own, unless the component also has an explicitly allowed page. A resource's name (node) is its host,
path and query, as different queries of one path may be different pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize
from .graph import connected_components

#: How markup states a canonical link or a redirect, and where the target stands in it. Fixed values.
LINK_TAG = r"""(?i)<link\s[^>]*rel\s*=\s*["']?canonical[^>]*>"""
META_TAG = r"""(?i)<meta\s[^>]*http-equiv\s*=\s*["']?refresh[^>]*>"""
LINK_TARGET = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
META_TARGET = r"""(?i)url\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
    return host & F.startswith(F.col("path"), F.lit(rule.path))


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule and own (the rule's verdict) to pages with host and path; null where no rule fits.

    The longest rule text wins; of equally long ones an allow wins, then the smaller text.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text))
    rule = own = F.lit(None).cast("string")
    for r in reversed(ranked):
        rule, own = F.when(_fits(r), F.lit(r.text)).otherwise(rule), F.when(_fits(r), F.lit(r.verdict)).otherwise(own)
    return pages.withColumn("rule", rule).withColumn("own", own)


def url_node(url: Column) -> Column:
    """Host (A-Z lower-cased), path and query of a url, its name in the graph; null where it is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    node = F.concat(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))
    return F.nullif(node, F.lit(""))


def without_dots(path: Column) -> Column:
    """A path that begins with /, its segments . and .. resolved."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def _targets(html: Column, tag: str, target: str) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, target, 1))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) between nodes, from all canonical links and refresh redirects in html.

    A target is resolved against the page's url: // begins a host, / a path of the same host, ? a query of the same
    path, and other targets without :// stand beside the page's last path segment. Targets that are empty, mere
    fragments or other schemes (mailto:) give no edge, nor do pages without a host.
    """
    both = F.concat(_targets(F.col("html"), LINK_TAG, LINK_TARGET), _targets(F.col("html"), META_TAG, META_TARGET))
    tags = pages.filter("node is not null and host <> ''").select("host", "path", "node", F.explode(both).alias("target"))
    tags = tags.filter(~F.rlike("target", F.lit("^(#|$|[A-Za-z][A-Za-z0-9+.-]*:(?!//))")))
    bare = F.regexp_extract("target", "^([^?#]*)", 1)
    query = F.regexp_extract("target", r"^[^?#]*(\?[^#]*)", 1)
    folder = F.concat(F.regexp_extract("path", "^(.*/)[^/]*$", 1))
    beside = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), bare)
    whole = F.when(F.startswith("target", F.lit("//")), F.concat(F.lit("x:"), "target")).when(F.instr("target", "://") > 0, F.col("target"))
    there = F.when(bare == "", F.col("path")).when(F.startswith("target", F.lit("/")), without_dots(bare)).otherwise(without_dots(beside))
    dst = F.coalesce(url_node(whole), F.when(whole.isNull(), F.concat("host", there, query)))
    return tags.select(F.col("node").alias("src"), dst.alias("dst")).filter("dst is not null")


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component.

    redirects: more edges as (src_url, dst_url). component is the smallest node of the page's resource, null for a
    page without edges. Verdict: the own rule's; else block if the component holds a blocked node and no allowed one
    (a node that no page has counts too); else allow. A null url or one without :// has empty host and path, fits no
    rule, has no edges and is allowed. Null html has no edges. Repeated pages each get a row. An empty table gives an
    empty result. Other columns are not read.
    """
    host, path = url_parts(F.col("__url"))
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"), F.col(html_col).alias("html"))
    parsed = parsed.withColumn("host", host).withColumn("path", path).withColumn("node", url_node(F.col("__url")))
    edges = page_edges(parsed)
    if redirects is not None:
        far = redirects.select(url_node(F.col("src_url")).alias("src"), url_node(F.col("dst_url")).alias("dst"))
        edges = edges.unionByName(far.dropna())
    parts = materialize(connected_components(edges), "aliases")
    nodes = parts.select("node", "component", F.regexp_extract("node", r"^([^/?]*)", 1).alias("host"), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("path"))
    judged = with_rule(nodes, rules).groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("own") == "block"), F.lit(False)).alias("blocked"),
        F.coalesce(F.bool_or(F.col("own") == "allow"), F.lit(False)).alias("allowed"),
    )
    spread = materialize(parts.join(materialize(judged, "judged"), "component"), "spread")
    # pages without a node must not meet in one task of the join
    spot = F.coalesce("node", F.concat(F.lit("\0"), F.col("page_id").cast("string"), F.lit("/"), F.coalesce("__url", F.lit(""))), F.lit("\0"))
    own = with_rule(parsed.select("page_id", "host", "path", spot.alias("node")), rules)
    out = own.join(spread, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.coalesce(F.col("blocked") & ~F.col("allowed"), F.lit(False)), "block").otherwise("allow")).alias("verdict"),
        "component",
    )
    return out
