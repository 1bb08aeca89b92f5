"""URL filters with redirect equivalence.

A url is judged by the longest rule that fits it. Urls that redirect or canonical-link
edges tie together are aliases: their connected components are found with distributed
star contraction, and what a rule says of one member decides for those that no rule
fits: one allowed member allows them, else one blocked member blocks them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import page_text
from .common import components, staged

#: Up to so many rules become one expression; more are joined by host.
INLINE_RULES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """What follows the first :// up to / ? # or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    """What follows the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest(rules: list[tuple[str, str, str]], host, path):
    """The longest rule that fits, as a struct (n, allow, rule); allow wins between equals."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(verdict == "allow").alias("allow"), F.lit(h + p).alias("rule")),
        )
        for verdict, h, p in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0] if fits else F.lit(None).cast("struct<n:int,allow:boolean,rule:string>")


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (with a column url), host, path and own: the longest fitting rule (n, allow, rule) or null.

    rules: (verdict, host, path) each, as a list or as a DataFrame with these columns.
    Longer lists and DataFrames are joined on the parents of each distinct host; that
    join has an equality key, and adaptive execution splits hosts with very many rows.
    """
    out = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE_RULES:
            return out.withColumn("own", _longest(rules, F.col("host"), F.col("path")))
        rules = urls.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    rules = rules.select(F.col("verdict").alias("v"), F.col("host").alias("of"), F.col("path").alias("p"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = out.select("host", "path").distinct()
    found = asked.withColumn("of", F.explode(parents)).join(rules, "of").where(F.col("path").startswith(F.col("p")))
    best = F.max(F.struct((F.length("of") + F.length("p")).alias("n"), (F.col("v") == "allow").alias("allow"), F.concat("of", "p").alias("rule")))
    found = found.groupBy("host", "path").agg(best.alias("own"))
    return out.join(found, ["host", "path"], "left")


def canonical_key(url):
    """What aliases are told by: a url without its fragment, the host in lower case."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(F.length(scheme) > 0, F.concat(F.lower(scheme), host_of(url), path_of(url), query))


def page_links(pages: DataFrame, *, url_col="url", html_col="html") -> DataFrame:
    """(a, b): the url of each page and the one that its canonical link or refresh names.

    Relative targets are made absolute against the page's own url.
    """
    marked = pages.where(F.lower(html_col).rlike("canonical|refresh") & F.col(url_col).isNotNull())
    return marked.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(_named, "a string, b string")


REFRESH = re.compile(r"url\s*=\s*['\"]?([^'\"\s]+)", re.I)


def targets_of(page: str) -> list[str]:
    """What the canonical links and refreshes of a page name; comments, scripts and other raw text hold no links."""
    from html import unescape

    out, at, skip = [], 0, ""
    for start, stop, tag, ends, attrs in page_text.tags_of(page):
        if start < at:
            continue
        if skip:
            skip = "" if ends and tag == skip else skip
            continue
        if tag in page_text.RAW and tag != "head" and not ends and not attrs.endswith("/"):
            if tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, stop)
                at = end.end() if end else len(page)
            else:
                skip = tag
        elif tag in ("link", "meta"):
            has = {name: unescape(value).strip() for name, value in page_text.attributes(attrs).items()}
            if tag == "link" and "canonical" in has.get("rel", "").lower().split():
                out.append(has.get("href", ""))
            elif tag == "meta" and has.get("http-equiv", "").lower() == "refresh" and (found := REFRESH.search(has.get("content", ""))):
                out.append(found[1])
    return [x for x in out if x]


def _named(batches):
    """The canonical and refresh targets of pages, made absolute."""
    from urllib.parse import urljoin

    import pyarrow as pa

    for batch in batches:
        pairs = []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for target in targets_of(page):
                try:
                    pairs.append((url, urljoin(url, target)))
                except ValueError:
                    continue  # no url at all
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["a", "b"])


def judge(pages: DataFrame, rules, *, edges: DataFrame | None = None, keep=("page_id",), url_col="url", default="allow") -> DataFrame:
    """The columns in keep, host, path, rule (null if none fits) and verdict of each row.

    edges: (a, b) urls that redirect to or name each other as canonical; a url is told by
    canonical_key. The verdict is the longest fitting rule's. Where none fits, it is
    allow if a rule allows a member of the url's component, else block if one blocks a
    member, else default. Rows without a url have empty host and path and the default.
    Repeated urls are judged alike; empty tables give an empty result.
    """
    rows = ruled(pages.select(*keep, F.col(url_col).cast("string").alias("url")), rules)
    verdict = F.when(F.col("own.allow"), "allow").when(~F.col("own.allow"), "block")
    if edges is not None:
        keyed = edges.select(canonical_key(F.col("a")).alias("a"), canonical_key(F.col("b")).alias("b"))
        found = components(keyed)
        members = ruled(found.select(F.col("id").alias("url"), "component"), rules)
        said = members.groupBy("component").agg(F.max("own.allow").alias("allowed"), F.count("own").alias("n"))
        said = said.where("n > 0").select("component", F.when(F.col("allowed"), "allow").otherwise("block").alias("said"))
        said = staged(found.join(said, "component").select(F.col("id").alias("key"), "said"), "aliases")
        rows = rows.withColumn("key", canonical_key(F.col("url"))).join(said, "key", "left")
        verdict = F.coalesce(verdict, F.col("said"))
    return rows.select(*keep, "host", "path", F.col("own.rule").alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
