"""URL filters with redirect equivalence, in DataFrame operations only.

A URL is judged by the longest rule (host, path) that fits it. URLs that redirect
to each other, or name each other as canonical, are aliases: what is blocked
spreads over their connected component, except to URLs that a rule allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.plans.scratch import Scratch

#: (host, path, verdict)
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path, else null. Ties go to the rule that is first by name."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [(F.when((host == h) | F.endswith(host, F.lit(f".{h}")), F.startswith(path, F.lit(p))), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered]
    none = F.lit(None).cast("struct<rule: string, verdict: string>")
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(fits), none)


def key_of(url: Column) -> Column:
    """What makes two spellings one URL: host, path and query, without scheme and fragment."""
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def named_urls(html: Column, url: Column) -> Column:
    """Array of the URLs that a page's canonical links and meta refreshes name, made absolute.

    Comments, scripts and styles are left out, up to the end of the page if they
    aren't closed. All patterns pass over the page once and have no repeated
    group, so pages and URLs of any length are read. Limits: ./ and ../ segments
    stay as they are, so such a target is a URL of its own; base elements and
    entities other than &amp; aren't read; a tag ends at the next < or >.
    """
    visible = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)", "")
    tags = F.regexp_extract_all(visible, F.lit(r"(?is)<(?:link|meta)\b[^<>]*>"), F.lit(0))
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(url)
    folder = F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)))
    folder = F.concat(origin, F.when(F.contains(path, F.lit("/")), folder).otherwise(F.lit("/")))

    def target(tag: Column) -> Column:
        href = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
        fresh = F.regexp_extract(tag, r"""(?is)\burl\s*=\s*(['"]?[^'">]+)""", 1)
        canonical = tag.rlike(r"""(?is)^<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b""")
        refresh = tag.rlike(r"""(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b""")
        said = F.when(canonical, href).when(refresh, fresh)
        t = F.replace(F.trim(F.regexp_replace(said, r"""['"]""", "")), F.lit("&amp;"), F.lit("&"))
        relative = (t != "") & ~t.rlike(r"^[#?]") & ~t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:")
        return (
            F.when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), t)
            .when(F.startswith(t, F.lit("//")), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), t))
            .when(F.startswith(t, F.lit("/")), F.concat(origin, t))
            .when(relative, F.concat(folder, t))
        )

    found = F.filter(F.transform(tags, target), lambda t: t.isNotNull())
    return F.when(F.lower(html).rlike("canonical|refresh"), found).otherwise(F.array().cast("array<string>"))


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, component for every row of `pages` (page_id, url, html).

    The verdict is the longest fitting rule's. Without one, a URL is blocked if
    a rule blocks some URL of its component, whatever else is in there, and
    allowed otherwise; so an allowed URL stays allowed among blocked aliases.
    `component` is the smallest alias, null for a URL that has none. A null URL,
    or one without ://, has an empty host and path, no alias, and is allowed. A
    null html names nothing. Repeated rows are judged alike; an empty table gives
    an empty result. Rules are a short list held by the plan.
    """
    scratch = Scratch(spark, "urls")
    url, html = F.col("url").cast("string"), F.col("html").cast("string") if "html" in pages.columns else F.lit(None).cast("string")
    rows = scratch.put(pages.select("page_id", url.alias("url"), key_of(url).alias("key"), named_urls(html, url).alias("named")), "rows")
    edges = rows.select("url", "key", F.explode("named").alias("to")).select("url", "key", "to", key_of(F.col("to")).alias("to_key")).where("key <> to_key")
    edges = scratch.put(edges, "edges")
    shown = rows.select("page_id", "key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    shown = shown.withColumn("m", matched(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        return shown.select("page_id", "host", "path", "m.rule", F.coalesce("m.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    aliases = scratch.put(components(edges.select("key", "to_key"), scratch), "aliases")
    ends = edges.select("key", "url").unionAll(edges.select("to_key", "to"))
    verdict = matched(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    bad = ends.where(verdict == "block").select(F.col("key").alias("node")).distinct().join(aliases, "node").select("component").distinct()
    known = scratch.put(aliases.join(bad.withColumn("bad", F.lit(True)), "component", "left").select(F.col("node").alias("key"), "component", F.coalesce("bad", F.lit(False)).alias("bad")), "known")
    spread = F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))
    return shown.join(known, "key", "left").select("page_id", "host", "path", "m.rule", F.coalesce("m.verdict", spread).alias("verdict"), "component")
