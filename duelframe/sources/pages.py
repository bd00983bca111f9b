"""Stored pages -> rows. `df` has one row per page with its html."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import _c


LINK = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
# The entities of a link's target; the ampersand last, so that nothing is decoded twice.
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def decode_entities(c) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def extract_links(df: DataFrame, html, prefix="") -> DataFrame:
    """One row per link of a page whose target starts with `prefix`; quotes of either kind or none, common entities
    decoded."""
    found = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(0))
    found = F.transform(found, lambda x: decode_entities(F.regexp_replace(x, LINK, "$1$2$3")))
    kept = F.filter(found, lambda x: F.startswith(x, F.lit(prefix)))
    return df.select(*[c for c in df.columns if c != html], F.posexplode(kept).alias("pos", "href"))


def strip_tags(c) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), "(?s)<[^>]*>", " "), r"\s+", " "))


def extract_fields(df: DataFrame, html, patterns: dict) -> DataFrame:
    """One column per field; a field lists patterns with one group, the first that matches is used, tags removed."""
    def field(options):
        options = [options] if isinstance(options, str) else options
        return F.coalesce(*[F.nullif(strip_tags(F.regexp_extract(F.col(html), p, 1)), F.lit("")) for p in options])

    return df.select(*[c for c in df.columns if c != html], *[field(p).alias(name) for name, p in patterns.items()])


def flag_by_title(c, s) -> Column:
    return F.contains(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(s.lower()))


def crawl_frontier(links: DataFrame, pages: DataFrame, link="href", url="url", crawled="crawled_ts") -> DataFrame:
    """Targets still to visit: links to unknown pages and known pages without a crawl time."""
    known = pages.select(F.col(url).alias("url"))
    new = links.select(F.col(link).alias("url")).distinct().join(known, "url", "left_anti")
    waiting = pages.where(F.col(crawled).isNull()).select(F.col(url).alias("url"))
    return new.unionByName(waiting).distinct()


def missing_stats_filter(df: DataFrame, marker, html="html", n_tables=None) -> tuple:
    """(usable pages, rejects with a reason)."""
    n_found = F.size(F.regexp_extract_all(F.col(html), F.lit("(?i)(<table)"), F.lit(1)))
    reason = F.when(F.contains(F.col(html), F.lit(marker)), "marker")
    if n_tables is not None:
        reason = reason.when(n_found != n_tables, "tables")
    tagged = df.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")
