"""Nested documents, arrays and stored pages."""

from pyspark.sql import functions as F

from ..functions import nested as N
from ..sources import pages as H
from .registry import query
from .standin import raw_contests, raw_sql, table

MARKETS = ["h2h", "h2h_lay"]


def snapshots(spark, sf):
    """One snapshot document per event: two bookmakers with two markets of two outcomes."""
    outcome = lambda who, price: F.struct(who.alias("name"), price.alias("price"))
    home, away = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("v"), F.col("event_type"))
    market = lambda i, j: F.struct(F.lit(MARKETS[j]).alias("key"), F.array(
        outcome(home, F.col("value") + i), outcome(away, F.col("value") + 10 * j)).alias("outcomes"))
    book = lambda i: F.struct(F.lit(f"book{i}").alias("title"), F.array(market(i, 0), market(i, 1)).alias("markets"))
    doc = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.array(F.struct(
        F.date_format("ts", "yyyy-MM-dd").alias("commence_time"), home.alias("home_team"), away.alias("away_team"),
        F.array(book(0), book(1)).alias("bookmakers"))).alias("data"))
    return table(spark, sf, "events").select(F.to_json(doc).alias("data"))


@query("N1_flatten_snapshots", """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, strftime(ts, '%Y-%m-%d') AS commence_time, 'u' || user_id AS home_team, 'v' || event_type AS away_team,
'book' || i AS bookmaker_name, CASE j WHEN 0 THEN 'h2h' ELSE 'h2h_lay' END AS market_name, CASE o WHEN 0 THEN 'u' || user_id ELSE 'v' || event_type END AS outcome_name,
CASE o WHEN 0 THEN value + i ELSE value + 10 * j END AS price
FROM events, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j), (VALUES (0), (1)) c(o)""")
def n1(spark, sf):
    return N.flatten_snapshots(snapshots(spark, sf), "data")


@query("N2_ordered_names", raw_sql("SELECT least(side, opp) AS side, greatest(side, opp) AS opp, count(*) AS n FROM raw GROUP BY ALL"))
def n2(spark, sf):
    df = raw_contests(spark, sf).select(N.ordered_names("side", "opp").alias("p")).select("p.side", "p.opp")
    return df.groupBy("side", "opp").agg(F.count(F.lit(1)).alias("n"))


@query("N3_prefix_sum_array", raw_sql("SELECT event, contest, line, list_sum(list_slice([5, 5, CAST(side_q AS INT), 3, 2], 1, line - 1)) AS total FROM (SELECT * FROM raw WHERE line > 1) UNION ALL SELECT event, contest, line, 0 FROM raw WHERE line <= 1"))
def n3(spark, sf):
    arr = F.array(F.lit(5), F.lit(5), F.col("side_q").cast("int"), F.lit(3), F.lit(2))
    return raw_contests(spark, sf).select("event", "contest", "line", N.prefix_sum_array(arr, F.col("line") - 1).alias("total"))


@query("N4_split_sections", """SELECT doc_id, i - 1 AS section, split_part(p, chr(10), 1) AS section_title, CASE WHEN contains(p, chr(10)) THEN substr(p, length(split_part(p, chr(10), 1)) + 2) ELSE '' END AS section_body
FROM (SELECT doc_id, unnest(list_slice(parts, 2, len(parts))) AS p, generate_subscripts(list_slice(parts, 2, len(parts)), 1) AS i FROM (SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(10) || '## '), chr(10) || '## ') AS parts FROM documents))""")
def n4(spark, sf):
    marked = F.replace("text", F.lit(".\n"), F.lit(".\n## "))  # headings where a line follows a full stop
    return N.split_sections(table(spark, sf, "documents").select("doc_id", marked.alias("text")), "text")


@query("N5_interleave_split", """SELECT doc_id, len(list_filter(w, lambda x, i: i % 2 = 1)) AS n_side, len(list_filter(w, lambda x, i: i % 2 = 0)) AS n_opp, w[1] AS first_side, w[2] AS first_opp,
md5(array_to_string(list_filter(w, lambda x, i: i % 2 = 1), ' ')) AS side_md5 FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def n5(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", N.interleave_split(F.split("text", " ")).alias("s"))
    return df.select("doc_id", F.size("s.side").alias("n_side"), F.size("s.opp").alias("n_opp"), F.get("s.side", F.lit(0)).alias("first_side"),
                     F.get("s.opp", F.lit(0)).alias("first_opp"), F.md5(F.array_join("s.side", " ").cast("binary")).alias("side_md5"))


@query("N6_round_rows", raw_sql("""SELECT event, contest, CAST(r AS INT) AS round, CAST(s AS INT) AS side_no,
CASE s WHEN 0 THEN CAST(CAST(side_q AS INT) + r AS VARCHAR) ELSE CAST(CAST(opp_q AS INT) AS VARCHAR) END AS landed, CASE s WHEN 0 THEN side ELSE opp END AS name
FROM (SELECT *, unnest(CASE WHEN line % 2 = 0 THEN [1, 2] ELSE [1] END) AS r FROM raw), (VALUES (0), (1)) t(s)"""))
def n6(spark, sf):
    cell = lambda a, b: F.concat(a.cast("string"), F.lit("_"), b.cast("string"))
    q, o = F.col("side_q").cast("int"), F.col("opp_q").cast("int")
    names = cell(F.col("side"), F.col("opp"))
    two = F.col("line") % 2 == 0
    df = raw_contests(spark, sf).select(
        "event", "contest",
        F.when(two, F.concat(cell(q + 1, o), F.lit("|"), cell(q + 2, o))).otherwise(cell(q + 1, o)).alias("landed"),
        F.when(two, F.concat(names, F.lit("|"), names)).otherwise(names).alias("name"))
    return N.round_rows(df, ["landed", "name"])


@query("H1_extract_links", r"""SELECT page_id, url, CAST(i - 1 AS INT) AS pos, href FROM (SELECT page_id, url, unnest(hs) AS href, generate_subscripts(hs, 1) AS i FROM
(SELECT page_id, url, list_filter(list_transform(regexp_extract_all(html, '(?i)\bhref\s*=\s*(?:"[^"]*"|{q}[^{q}]*{q}|[^\s"{q}>]+)'), lambda x:
replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?i)^href\s*=\s*["{q}]?([^"{q}]*)["{q}]?$', '\1'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)),
'&lt;', '<'), '&gt;', '>'), '&amp;', '&')), lambda x: starts_with(x, '/')) AS hs FROM pages))""".replace("{q}", 2 * "'"))
def h1(spark, sf):
    return H.extract_links(table(spark, sf, "pages"), "html", "/")


_STRIP = "nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '{0}', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '')"


@query("H2_extract_fields", f"""SELECT page_id, url, {_STRIP.format('(?s)<title>(.*?)</title>')} AS title,
coalesce({_STRIP.format('(?s)<h2>(.*?)</h2>')}, {_STRIP.format('(?s)<h1>(.*?)</h1>')}) AS heading, md5(coalesce({_STRIP.format('(?s)<article>(.*?)</article>')}, '')) AS body_md5 FROM pages""")
def h2(spark, sf):
    out = H.extract_fields(table(spark, sf, "pages"), "html", {
        "title": "(?s)<title>(.*?)</title>", "heading": ["(?s)<h2>(.*?)</h2>", "(?s)<h1>(.*?)</h1>"], "body": "(?s)<article>(.*?)</article>"})
    return out.select("page_id", "url", "title", "heading", F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("body_md5"))


@query("H3_flag_by_title", "SELECT page_id, CAST(contains(lower(coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '')), 'the') AS INT) AS hit FROM pages")
def h3(spark, sf):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", H.flag_by_title(title, "The").cast("int").alias("hit"))


_LINKS = """lk AS (SELECT DISTINCT 'http://' || split_part(url, '/', 3) || h AS url FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) WHERE starts_with(h, '/'))"""


@query("H4_crawl_frontier", f"""WITH {_LINKS} SELECT DISTINCT url FROM (SELECT url FROM lk WHERE url NOT IN (SELECT url FROM pages)
UNION ALL SELECT url FROM pages WHERE page_id % 5 = 0)""")
def h4(spark, sf):
    pages = table(spark, sf, "pages")
    host = F.concat(F.lit("http://"), F.split_part("url", F.lit("/"), F.lit(3)))
    links = H.extract_links(pages, "html", "/").select(F.concat(host, "href").alias("href"))
    stamped = pages.select("url", F.when(F.col("page_id") % 5 != 0, F.lit("2024-01-01").cast("timestamp")).alias("crawled_ts"))
    return H.crawl_frontier(links, stamped)


@query("H5_missing_stats_filter", """SELECT page_id, CASE WHEN contains(html, 'class="ad"') THEN 'marker' WHEN len(regexp_extract_all(html, '(?i)(<table)', 1)) <> 0 THEN 'tables' ELSE 'ok' END AS reason FROM pages""")
def h5(spark, sf):
    ok, rejects = H.missing_stats_filter(table(spark, sf, "pages"), 'class="ad"', n_tables=0)
    return ok.withColumn("reason", F.lit("ok")).select("page_id", "reason").unionByName(rejects.select("page_id", "reason"))
