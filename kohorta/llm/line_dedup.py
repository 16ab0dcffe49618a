"""Line de-duplication by site-relative frequency (DataFrame functions only).

A line that a large share of a site's pages carry is boilerplate. Pages are
grouped by host, the pages that contain a line are divided by the pages of the
host, and lines above ``max_ratio`` are dropped from all pages of that host.

Defined results:

* null or empty text: no lines, nothing dropped, kept text empty;
* null or unreadable url: the page belongs to no site, nothing is dropped;
* a line that repeats inside one page counts that page once; if it stays, all its
  copies stay, in page order;
* repeated rows are pages of their own;
* an empty table gives an empty table;
* other columns are carried unchanged, whatever their names, unless they have the
  name of a result column, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.operators.skew import salted_join
from kohorta.session import cut_lineage

# What is no visible text, and the tags that end a line.
HIDDEN = (
    r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<title\b.*?</title\s*>"
)
LINE_TAGS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|button|dd|div|dl|dt|fieldset|figcaption"
    r"|figure|footer|form|h[1-6]|head|header|hr|html|legend|li|main|nav|ol|option|p|pre|section"
    r"|select|table|tbody|td|tfoot|th|thead|tr|ul)(?:[\s/][^>]*)?>"
)
OTHER_TAGS = r"<[a-zA-Z/!?][^>]*>"
SPACE = r"[\x20\t\r\f\x0B]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def html_lines(html: Column) -> Column:
    """Visible lines of raw HTML: scripts and comments go, block tags end a line."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(text, LINE_TAGS, "\n")
    text = F.regexp_replace(text, OTHER_TAGS, "")
    return plain_lines(text)


def plain_lines(text: Column) -> Column:
    """Non-empty lines, white space collapsed and trimmed."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(line))
    return F.filter(lines, lambda line: line != "")


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute url, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def site_lines(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """Boilerplate lines of each host: ``(__host, __drop)``, digests in one array.

    ``pages`` has ``__host`` and ``__lines``. Counts are combined before the
    shuffle, so a hot host or a hot line is one row per map task. The array of a
    host holds at most (mean lines per page) / ``max_ratio`` digests, because each
    of them takes up that share of the host's pages.
    """
    sited = pages.filter("__host != ''")
    totals = sited.groupBy("__host").agg(F.count("*").alias("__pages"))
    counts = (
        sited.select(
            "__host",
            F.explode(F.array_distinct(F.transform("__lines", F.md5))).alias("__digest"),
        )
        .groupBy("__host", "__digest")
        .agg(F.count("*").alias("__with"))
        .filter(F.col("__with") >= min_pages)
    )
    return (
        salted_join(counts, totals, "__host")
        .filter(F.col("__with") / F.col("__pages") > max_ratio)
        .groupBy("__host")
        .agg(F.collect_list("__digest").alias("__drop"))
    )


def drop_site_lines(
    pages: DataFrame,
    max_ratio: float = 0.3,
    min_pages: int = 3,
    url: str = "url",
    text: str = "html",
    lines=html_lines,
) -> DataFrame:
    """``pages`` with ``host``, ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line goes if at least ``min_pages`` pages and more than ``max_ratio`` of all
    pages of its host carry it. ``lines`` turns the text column into its lines.
    """
    made = ("host", "n_lines", "n_dropped", "kept_text")
    rest = [c for c in pages.columns if c.lower() not in made]
    page = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(1).alias("_"))
    split = pages.select(
        page.alias("__page"), url_host(F.col(url)).alias("__host"), lines(F.col(text)).alias("__lines")
    )
    # Written first, so that Spark knows its size: pages are shuffled only beyond a broadcast.
    drops = cut_lineage(site_lines(split.select("__host", "__lines"), max_ratio, min_pages), "line-dedup")
    kept = F.when(
        F.col("__drop").isNotNull(),
        F.filter("__lines", lambda line: ~F.array_contains("__drop", F.md5(line))),
    ).otherwise(F.col("__lines"))
    marked = salted_join(split, drops, "__host", "left").withColumn("__kept", kept)
    return marked.select(
        *[F.col("__page").getField(c).alias(c) for c in rest],
        F.col("__host").alias("host"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.array_join("__kept", "\n").alias("kept_text"),
    )


def query(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return drop_site_lines(pages).select(
        "page_id", "url", "host", "n_lines", "n_dropped", "kept_text"
    )


SQL = rf"""
WITH t AS (
  SELECT page_id, url, row_number() OVER () AS r,
    lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '{HIDDEN}', '', 'g'), '{LINE_TAGS}', chr(10), 'g'), '{OTHER_TAGS}', '', 'g'),
      '{SPACE}', ' ', 'g') AS txt
  FROM pages),
l AS (
  SELECT *, list_filter(list_transform(string_split(txt, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM t),
e AS (SELECT r, host, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM l),
totals AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
counts AS (SELECT host, line, count(DISTINCT r) AS w FROM e GROUP BY host, line),
boiler AS (
  SELECT c.host, c.line FROM counts c JOIN totals t USING (host)
  WHERE c.host <> '' AND c.w >= 3 AND c.w / t.pages > 0.3),
m AS (
  SELECT e.r, e.i, e.line, b.line IS NOT NULL AS gone
  FROM e LEFT JOIN boiler b ON b.host = e.host AND b.line = e.line),
k AS (
  SELECT r, count(*) FILTER (gone) AS n_dropped,
    string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept_text
  FROM m GROUP BY r)
SELECT l.page_id, l.url, l.host, len(l.lines)::BIGINT AS n_lines,
  coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, coalesce(k.kept_text, '') AS kept_text
FROM l LEFT JOIN k USING (r)
"""
