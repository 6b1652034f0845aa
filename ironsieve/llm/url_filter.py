"""URL filters with redirect equivalence; DataFrame operations only.

A rule names a host and a path: it fits that host and all its subdomains if the url's path starts with the rule's, and
the longest rule wins. A url that no rule fits takes its alias class's decision. Classes are the connected components
over redirect and canonical-link edges, found in the pages themselves (``<link rel=canonical>`` and
``<meta http-equiv=refresh>``) and in an optional table of redirects (from_url, to_url). In a class, an explicit allow
takes precedence over every block; a block decides if there is no allow; a class without decisions is allowed.
Urls that are only named as targets are judged by the rules, too, and carry their decision to their aliases.

Hosts: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased. Aliases are the
same url without scheme and fragment. A relative target is resolved against the page's ``<base href>`` or url, its dot
segments removed; one of a scheme without ``://`` (``mailto:``) has no edge. Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule,
has no aliases and is allowed. Null html has no edges. Repeated rows are judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ironsieve.operators.components import connected_components
from ironsieve.session import cut

Rule = tuple[str, str, str]
#: Up to so many rules become one expression in the plan; more are joined by host suffix.
INLINE_RULES = 256
#: Up to so many rules may be broadcast for that join.
BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """The url without scheme and fragment, its host lower-cased; null if it isn't absolute."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null: rules tried from long to short."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0], r[1], r[2]))
    fits = [
        F.when(
            ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in longest
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def judge_by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same decision for a large table of rules (verdict, host, path): hosts' suffixes are joined with the rules.

    Distinct (host, path) pairs go into the join, so a host that holds a third of all rows is there once for each path.
    """
    pairs = urls.select("host", "path").distinct()
    label = F.split("host", r"\.")
    suffix = F.transform(
        F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), ".")
    )
    rules = rules.select(F.col("verdict").alias("v"), F.col("host").alias("h"), F.col("path").alias("p")).distinct()
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    keyed = pairs.where("host != ''").withColumn("h", F.explode(suffix))
    fit = keyed.join(F.broadcast(rules) if few else rules, "h").where(F.startswith("path", "p"))
    whole = F.concat("h", "p")
    best = fit.groupBy("host", "path").agg(
        F.max(F.struct(F.length(whole), F.length("h"), (F.col("v") == "allow").alias("a"), whole.alias("rule"))).alias(
            "best"
        )
    )
    best = best.select(
        "host",
        "path",
        F.struct("best.rule", F.when(F.col("best.a"), "allow").otherwise("block").alias("verdict")).alias("hit"),
    )
    return urls.join(best, ["host", "path"], "left")


def plain_path(path: Column) -> Column:
    """An absolute path without dot segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(x == ".", done)
        .otherwise(F.concat(done, F.array(x))),
    )
    end = F.when(F.rlike(path, F.lit(r"/\.\.?$")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    dotted = F.rlike(path, F.lit(r"/\.\.?(?:/|$)"))
    return F.when(dotted, F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """The absolute url of a target named in a page at ``base``; null if it is empty or of another kind of scheme."""
    scheme = F.regexp_extract(base, r"(?s)^([^:/?#]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)?", 1))
    path, rest = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, plain_path(path), rest))
        .when(F.startswith(target, F.lit("?")), F.concat(root, path_of(base), target))
        .when(F.startswith(target, F.lit("#")), base)
        .when((target != "") & ~F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.concat(root, plain_path(F.concat(folder, path)), rest))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): alias keys joined by a canonical link or a refresh redirect of the page."""
    html, url = F.col(html_col), F.col(url_col)
    tags = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)),
        lambda t: F.rlike(t, F.lit(r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))
        | F.rlike(t, F.lit(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b")),
    )
    named = F.transform(
        tags, lambda t: F.regexp_extract(t, r"(?is)(?:\bhref\s*=|\burl\s*=)\s*[\"']?\s*([^\"'\s>]+)", 1)
    )
    # in two steps, so that the markup is searched once
    base = F.regexp_extract(html, r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    links = (
        pages.where(F.contains(url, F.lit("://")) & html.isNotNull())
        .select(url.alias("url"), F.when(F.size(named) > 0, base).alias("base"), named.alias("targets"))
        .select("url", F.coalesce(resolved(F.col("url"), F.col("base")), "url").alias("base"), F.explode("targets").alias("target"))
    )
    whole = resolved(F.col("base"), F.replace("target", F.lit("&amp;"), F.lit("&")))
    return links.select(alias_key(F.col("url")).alias("a"), alias_key(whole).alias("b")).where(
        "a is not null and b is not null and a != b"
    )


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """(id, host, path, rule, verdict, component) for every row of ``pages``; component: the class's smallest alias."""

    def judged(df: DataFrame) -> DataFrame:
        if isinstance(rules, DataFrame):
            return judge_by_table(df, rules)
        if len(rules) > INLINE_RULES:
            return judge_by_table(df, df.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string"))
        return df.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))

    url = F.col(url_col)
    rows = judged(
        pages.select(
            F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("key")
        )
    )
    links = [page_links(pages, url_col, html_col)] if html_col else []
    if redirects is not None:
        links.append(redirects.select(alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")))
    out = rows.withColumn("component", F.lit(None).cast("string")).withColumn("class", F.lit(None).cast("string"))
    if links:
        edges = links[0] if len(links) == 1 else links[0].unionAll(links[1])
        edges = cut(edges.where("a is not null and b is not null and a != b").distinct())
        if not edges.isEmpty():
            parts = connected_components(edges)
            slash = F.concat(F.lit("x://"), F.col("node"))
            named = judged(
                parts.select("node", "component", host_of(slash).alias("host"), path_of(slash).alias("path"))
            )
            rank = F.max(F.when(F.col("hit.verdict") == "allow", 2).when(F.col("hit.verdict") == "block", 1))
            decided = named.groupBy("component").agg(rank.alias("rank"))
            member = parts.join(decided, "component").select(
                F.col("node").alias("key"),
                "component",
                F.when(F.col("rank") == 1, "block").when(F.col("rank") == 2, "allow").alias("class"),
            )
            out = rows.join(member, "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.col("class"), F.lit("allow")).alias("verdict"),
        "component",
    )
