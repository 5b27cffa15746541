"""URL filter: rules on host and path, and block decisions that follow redirects and canonical links.

A page is a node: its URL without scheme, fragment, default port, tracking parameters and closing
slash. Canonical links and refresh redirects in its HTML are edges to other nodes; components of the
graph are aliases of one page. A URL that a rule fits, closing slash included, has the rule's verdict,
whether it is the URL of a row or only the target of a link. Any other URL is
blocked if a rule blocks one of its aliases, unless a rule explicitly allows one of them; without
either it is allowed. Everything is DataFrame expressions; hosts with very many pages are ordinary
rows here, since nodes are whole URLs.

Nulls and empties: a URL that is null or has no ``://`` has an empty host and path, no rule and no
aliases, and is allowed; null HTML has no links. Repeated rows and ids give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.components import connected_components
from tabloom.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(?:utm_\w+|gclid|fbclid|ref)="

#: (host, path, verdict) of the rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to the next ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains if the path
    starts with its path; of equally long rules an allowing one wins. ``rules`` is a list that a person writes.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2], r))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in order]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def without_port(host: Column) -> Column:
    """``host`` without a default port."""
    return F.regexp_replace(host, r":(?:80|443)$", "")


def node_of(url: Column) -> Column:
    """What aliases by convention share; null for what is no URL of a page."""
    host = without_port(host_of(url))
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    path = F.regexp_replace(path_of(url), r"/$", "")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not; empty if missing."""
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*{quoted}", 1), F.lit("")) for quoted in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")], F.lit(""))


def resolve(link: Column, url: Column) -> Column:
    """``link`` as a whole URL, seen from the page at ``url``."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(url, r"^([\s\S]*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^([\s\S]*/)", 1)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, link)).when((link == "") | link.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None).cast("string"))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link)))


def links_of(html: Column, url: Column) -> Column:
    """URLs that a page names as its canonical address or redirects to."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: F.lower(attribute(t, "rel")).rlike(r"(?:^|\s)canonical(?:\s|$)")), lambda t: attribute(t, "href"))
    refresh = F.transform(F.filter(tags, lambda t: F.lower(attribute(t, "http-equiv")) == "refresh"),
                          lambda t: F.regexp_extract(attribute(t, "content"), r"(?i)url\s*=\s*['\"]?([^'\"]*)", 1))
    return F.filter(F.transform(F.concat(canonical, refresh), lambda x: resolve(x, url)), lambda x: x.isNotNull())


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html).

    ``redirects`` (url, target) are known redirects, as from a crawl log; they are edges like the others.
    """
    rules = RULES if rules is None else rules
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), links_of(F.col("html"), url).alias("links"))
    rows = cut_lineage(rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)))
    edges = rows.select(F.col("node").alias("u"), F.explode("links").alias("link"))
    named = edges.select("link")
    edges = edges.select("u", node_of(F.col("link")).alias("v"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v")))
        # A redirect's ends are URLs too: a rule that fits them speaks for their aliases.
        named = named.unionByName(redirects.select(F.explode(F.array("url", "target")).alias("link")))
    aliases = connected_components(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct())

    said = lambda verdict: F.coalesce(F.max(F.col("fit.verdict") == verdict), F.lit(False))
    # A rule may end where the path does: it is held against the path as it is written, which the node has no more.
    link = F.col("link")
    named = named.select(node_of(link).alias("node"), without_port(host_of(link)).alias("host"), path_of(link).alias("path")).where(F.col("node").isNotNull()).distinct()
    named = named.select("node", rule_of(F.col("host"), F.col("path"), rules).alias("fit"))
    spoken = rows.where(F.col("node").isNotNull()).select("node", "fit").unionByName(named).where(F.col("fit").isNotNull())
    verdicts = spoken.groupBy("node").agg(said("block").alias("blocks"), said("allow").alias("allows"))
    member = lambda df: df.join(aliases.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("group", F.coalesce("component", "node"))
    groups = member(verdicts).groupBy("group").agg((F.max("blocks") & ~F.max("allows")).alias("bad")).where("bad").select("group", "bad")
    judged = member(rows.drop("links")).join(groups, "group", "left")
    own = F.col("fit.verdict")
    verdict = F.coalesce(own, F.when(F.col("bad"), F.lit("block")), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
