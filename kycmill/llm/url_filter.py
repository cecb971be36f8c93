"""Block lists for URLs whose decisions reach every alias of a page.

All redirects (``meta refresh``) and canonical links of the pages are edges between URLs. Targets are decoded
from HTML and resolved against the URL of their page. The connected components are found by distributed star operations; a component with a blocked member and no explicitly
allowed one is blocked as a whole. A rule that fits a URL itself always decides that URL.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule and no alias, and is
allowed; a target is absolute if it starts with a scheme and ``://``, and one with another scheme
(``mailto:``) is no alias; dot segments of targets are removed, URLs of pages stay as they are; a repeated page is judged like the first; the longest rule wins, and of equally long ones allow; an
empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .graph import components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the registered query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z in lower case; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """The URL as a node of the alias graph: without scheme and fragment; null where there is no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url_host(url) != "", F.concat(url_host(url), url_path(url), query))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct; null if none does. One expression: rules are a short list."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value).otherwise(chosen)
    return chosen


_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")
_ABSOLUTE = re.compile(r"(?s)(.*?://[^/?#]*)([^?#]*)(\?[^#]*)?")
_ODD = re.compile(r"[\t\n\r]")


def _without_dots(path: str) -> str:
    """The path without dot segments (RFC 3986, 5.2.4)."""
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part in (".", ".."):
            if part == ".." and len(out) > 1:
                out.pop()
            if i + 1 == len(parts):
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def resolved(url: str | None, target: str) -> str | None:
    """The absolute URL a target in the HTML of the page stands for; null if it stands for none."""
    target = _ODD.sub("", html.unescape(target).strip()).partition("#")[0]
    base = _ABSOLUTE.match(url or "")
    if target.startswith("//"):
        target = "http:" + target
    if scheme := _SCHEME.match(target):
        if not target.startswith("//", scheme.end()):
            return None
        site, path, query = _ABSOLUTE.match(target).groups()
        return site + _without_dots(path) + (query or "")
    if base is None:
        return None
    site, path, query = base.groups()
    if not target:
        return site + path + (query or "")
    if target.startswith("?"):
        return site + path + target
    own, mark, query = target.partition("?")
    if not own.startswith("/"):
        own = path[: path.rfind("/") + 1] + own if "/" in path else "/" + own
    return site + _without_dots(own) + mark + query


def _resolved_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls = batch.column("url")
        found = [resolved(u, t) for u, t in zip(urls.to_pylist(), batch.column("target").to_pylist())]
        yield pa.RecordBatch.from_arrays([urls, pa.array(found, pa.string())], ["url", "target"])


def _values(tags: Column, pattern: str) -> Column:
    """In every tag the first of the pattern's three groups (in double, single or no quotes) that matched."""
    return F.transform(tags, lambda tag: F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3))))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``a``, ``b``: nodes joined by a canonical link or a redirect in ``html``."""
    tags = r"(?is)<{}\b[^>]*\b{}\s*=\s*[\"']?{}\b[^>]*>"
    quoted = r"""(?is)(?<![-\w]){}\s*=\s*(?:"([^">]*)"|'([^'>]*)'|["']?([^"'>\s]+))"""
    canonical = F.regexp_extract_all("html", F.lit(tags.format("link", "rel", "canonical")), F.lit(0))
    refresh = F.regexp_extract_all("html", F.lit(tags.format("meta", "http-equiv", "refresh")), F.lit(0))
    targets = F.concat(_values(canonical, quoted.format("href")), _values(refresh, quoted.format("url")))
    linked = pages.select("url", F.explode(targets).alias("target")).filter("target <> ''")
    absolute = linked.mapInArrow(_resolved_rows, "url string, target string")
    return absolute.select(url_node(F.col("url")).alias("a"), url_node(F.col("target")).alias("b"))


def alias_verdicts(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``node``, ``alias_verdict`` for every node of an edge, from the rules that fit any member."""
    edges = checkpointed(edges.dropna().filter("a <> b").distinct())
    rooted = components(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    member = checkpointed(nodes.join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    as_url = F.concat(F.lit("x://"), F.col("node"))
    verdict = fitting_rule(url_host(as_url), url_path(as_url), rules)["verdict"]
    judged = member.groupBy("root").agg(
        F.max(F.coalesce(verdict == "block", F.lit(False))).alias("blocked"),
        F.max(F.coalesce(verdict == "allow", F.lit(False))).alias("allowed"),
    )
    return member.join(judged, "root").select(
        "node", F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow").alias("alias_verdict")
    )


def url_filter(
    pages: DataFrame, rules: Sequence[Rule] = RULES, edges: DataFrame | None = None, key: str = "page_id"
) -> DataFrame:
    """One row per page: ``key``, ``host``, ``path``, ``rule``, ``verdict``.

    ``edges`` (columns ``a``, ``b`` of URLs) adds redirects known from elsewhere, such as a crawl log.
    """
    found = alias_edges(pages)
    if edges is not None:
        found = found.unionByName(edges.select(*(url_node(F.col(c)).alias(c) for c in ("a", "b"))))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = pages.select(
        F.col(key),
        host.alias("host"),
        path.alias("path"),
        fitting_rule(host, path, rules).alias("own"),
        url_node(F.col("url")).alias("node"),
    )
    return judged.join(alias_verdicts(found, rules), "node", "left").select(
        key,
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"),
    )
