"""URL filters with aliases: decisions of rules are carried along redirects and canonical links.

A rule names a host and a path's beginning, and allows or blocks what it fits; the longest fitting rule decides. Addresses that redirect to each
other, or name each other as canonical, are one thing under several names: connected components over these edges. A page without a rule of its
own takes the decision of its component: allow if a member has an allowing rule, else block if a member has a blocking one. What no decision
reaches is allowed.

Edges come from the pages (`<link rel=canonical>`, `<meta http-equiv=refresh>`, outside comments, scripts, styles and other raw text) and from a
table of redirects, if there is one. Two spellings are one address if they differ in scheme, the host's case, user, default port or last dot, fragment
or tracking parameters alone. Redirects by scripts are not followed.

Rules are a table of any length. Each distinct address is matched once: its host's suffixes meet the hosts of rules, then the beginnings of its path, cut at the lengths that
the host's rules have, meet the rules themselves. No address meets all rules of its host. Nothing goes to the driver.

Defined cases: a null url, or one without `://`, has an empty host and path, no rule and no aliases; a null html has no links; a target that is no http address, or no
address at all, makes no edge; of several base elements the first holds; of rules of one length the longer host decides, then allow; repeated pages are each judged; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, keep, scan
from millrace.operators.components import components

ALLOW, BLOCK = "allow", "block"
TRACKING = r"^(utm_\w+|gclid|fbclid|msclkid)(=|$)"
#: Pages without one of these words have no link that is looked for.
WORDS = r"(?i)canonical|refresh"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|xmp)\b.*?(?:</\1\b|\Z)|<(link|meta|base)\b((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)", re.I | re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_REFRESH = re.compile(r"\s*+[\d.]*+\s*+[;,]?\s*+(?:url\s*=)?\s*+(?:\"([^\"]*)|'([^']*)|([^\s\"']\S*))", re.I)


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://` up to `/`, `?`, `#` or the end, lower-cased; then up to `?`, `#` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    piece = lambda n: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", n), F.lit(""))
    return lower(piece(1)), piece(2)


def address(url: Column) -> Column:
    """host, path and key of the address that a url spells; key is null for a url without a host."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:(80|443)?)?$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.array_join(F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: ~p.rlike(TRACKING)), "&")
    key = F.when(host != "", F.unhex(F.md5(F.concat(host, path, F.lit("?"), query))))  # 128 bits
    return F.struct(host.alias("host"), path.alias("path"), key.alias("key"))


def links_of(url: str | None, page: str) -> list[str]:
    """Targets of a page's canonical links and refreshes, as absolute addresses."""
    base, found = None, []
    for m in _TAG.finditer(page):
        if not (tag := m[2]):
            continue
        attributes: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(m[3]):
            attributes.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
        tag = tag.lower()
        if tag == "base":
            base = base if base is not None else attributes.get("href")
        elif tag == "link" and "canonical" in attributes.get("rel", "").lower().split():
            found.append(attributes.get("href"))
        elif tag == "meta" and attributes.get("http-equiv", "").strip().lower() == "refresh" and (to := _REFRESH.match(attributes.get("content", ""))):
            found.append(next(filter(None, to.groups()), None))
    out = []
    for target in found:
        try:
            joined = urljoin(urljoin(url or "", (base or "").strip()), target.strip()) if target and target.strip() else ""
        except ValueError:  # no address, as a host in open brackets
            continue
        if re.match(r"https?://", joined, re.I):
            out.append(joined)
    return out


def links(pages: DataFrame) -> DataFrame:
    """url, target: edges that the pages themselves state."""
    bounded_batches(pages.sparkSession)

    def each(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"url": [], "target": []}
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for target in links_of(url, page.as_py()):
                out["url"].append(url)
                out["target"].append(target)
        return out

    return scan(pages.select("url", "html").where(F.col("url").isNotNull() & F.col("html").rlike(WORDS)), each, "url string, target string")


def matched(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses: host, path. rules: host, path, verdict. host, path, rule, verdict of the distinct addresses that a rule fits."""
    own = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    lengths = own.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    names = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    each = keep(addresses.where("host <> ''").select("host", "path").distinct(), "addresses")
    near = each.select("host", "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    near = near.select("host", "path", "rule_host", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    near = near.select("host", "path", "rule_host", F.expr("substring(path, 1, n)").alias("rule_path"))
    better = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == ALLOW)
    best = near.join(own, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), better).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def alias_verdicts(addresses: DataFrame, edges: DataFrame, ruled: DataFrame) -> DataFrame:
    """addresses: key, host, path of all ends of edges. edges: u, v (keys). ruled: of matched(). key, verdict of the addresses that a decision reaches."""
    decided = addresses.join(ruled, ["host", "path"]).groupBy("key").agg(F.bool_or(F.col("verdict") == ALLOW).alias("allows"))
    member = keep(components(edges), "members")
    # Summed up by component before anything is shuffled, and kept, so that a component of any size can be split when it is joined.
    by = keep(member.join(keep(decided, "decided"), member["node"] == F.col("key")).groupBy("component").agg(F.bool_or("allows").alias("allows")), "components")
    return member.join(by, "component").select(F.col("node").alias("key"), F.when(F.col("allows"), ALLOW).otherwise(BLOCK).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """pages: page_id, url, html. rules: host, path, verdict. redirects: url, target.

    Returns page_id, url, host, path, rule (null if none fits), verdict, and by: rule, alias or default.
    """
    known = links(pages)
    if redirects is not None:
        known = known.unionByName(redirects.select("url", "target").where("url is not null and target is not null"))
    ends = keep(known.distinct().select(address(F.col("url")).alias("u"), address(F.col("target")).alias("v")).where("u.key is not null and v.key is not null"), "links")
    edges = ends.select(F.col("u.key").alias("u"), F.col("v.key").alias("v"))
    nodes = ends.select("u.*").unionByName(ends.select("v.*")).distinct()
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"), address(F.col("url")).alias("at"))
    every = own.select("host", "path").unionByName(own.select("at.host", "at.path")).unionByName(nodes.select("host", "path"))
    ruled = keep(matched(every, rules), "ruled")
    reached = keep(alias_verdicts(nodes, edges, ruled), "reached").select("key", F.col("verdict").alias("alias_verdict"))
    spelled = ruled.select(F.struct("host", "path").alias("spelled"), F.col("verdict").alias("spelled_verdict"))
    out = own.join(ruled, ["host", "path"], "left").join(reached, F.col("at.key") == F.col("key"), "left")
    # An address with a port or a user in it is one that the rule of its plain spelling knows.
    out = out.join(spelled, F.struct("at.host", "at.path") == F.col("spelled"), "left")
    alias = F.coalesce("alias_verdict", "spelled_verdict")
    by = F.when(F.col("verdict").isNotNull(), "rule").when(alias.isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", alias, F.lit(ALLOW)).alias("verdict"), by.alias("by"))
