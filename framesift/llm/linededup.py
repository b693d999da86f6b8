"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over all pages of the
host; lines above MAX_RATIO that repeat at all (that are on MIN_PAGES pages, two) are the site's boilerplate and are dropped
from each of its pages. Without the second condition a site of one page would lose it whole. Lines of a page come from its HTML: scripts, styles and comments go, block elements end a line, other tags
vanish, lines are trimmed and empty ones left out.

Lines are counted by two 64-bit hashes, once per page, with partial sums before the exchange; text is never
exchanged for counting. A page's lines are held against its own host's boilerplate by the first hash: with a hundred such lines and
10^9 others on a host, one is dropped wrongly with a chance of 5 in 10^9. A host's boilerplate is short by nature (its ratios can't sum above its mean lines per page), so
one row per host holds it; those rows are broadcast after their count is checked, or else joined by host, where
Spark may split a hot host's pages.

Defined results: a null or unreadable address has the empty host, a site like any other; a null page has no lines; a
line that repeats within a page counts once and is dropped at every place; repeated rows are pages of their
own; null ids stay. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import materialized, work_path

MAX_RATIO = 0.3
MIN_PAGES = 2
#: Boilerplate lines that may be broadcast (8 bytes each, and the host's name).
BROADCAST_LINES = 500_000
HIDDEN = r"(?is)<(?:script\b.*?</script|style\b.*?</style|!--.*?--)>"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
BLANKS = " \t\r\x0b\f"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def lines_of(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))

    def trimmed(line: Column) -> Column:
        """Trimming reads a line character by character, so only lines with a blank at an end are trimmed."""
        blank = F.ascii(line).isin(*map(ord, BLANKS))
        for c in BLANKS:
            blank |= F.endswith(line, F.lit(c))
        return F.when(blank, F.btrim(line, F.lit(BLANKS))).otherwise(line)

    return F.filter(F.transform(F.split(text, "\n"), trimmed), lambda line: line != "")


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """host, lines (array of hashes) of host, line hashes (one row per page and distinct line)."""
    totals = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    spread = pages.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counted = spread.groupBy("host", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("check")).agg(F.count("*").alias("n"))
    common = counted.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > max_ratio * F.col("n_pages"))
    return common.groupBy("host").agg(F.collect_set("h").alias("dropped"))


def drop_boilerplate(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """id, host, n_lines, n_dropped, text (kept lines, one newline between)."""
    rows = pages.select(
        pages[id_col].cast("long").alias("id"),
        host_of(pages[url_col].cast("string")).alias("host"),
        lines_of(pages[html_col].cast("string")).alias("lines"),
    )
    spark, path = pages.sparkSession, work_path(pages.sparkSession, "lines")
    rows.write.parquet(path)  # read twice; parsing costs more than storing
    rows = spark.read.parquet(path)
    common = materialized(boilerplate(rows, max_ratio, min_pages))
    if (common.agg(F.sum(F.size("dropped") + 8)).head()[0] or 0) <= broadcast_lines:
        common = F.broadcast(common)
    joined = rows.join(common, "host", "left")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda line: ~F.array_contains(F.col("dropped"), F.xxhash64(line))))
    joined = joined.select("id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return joined.select("id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def query(spark, sf_dir):
    from framesift.llm.common import table

    found = drop_boilerplate(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH plain AS (
  SELECT row_number() OVER () AS row_id, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS text FROM pages
), lined AS (
  SELECT row_id, page_id, host, list_filter(list_transform(string_split(
    replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
    chr(10)), lambda x: trim(x, E' \t\r\x0B\f')), lambda x: x <> '') AS lines FROM plain
), spread AS (
  SELECT row_id, host, pos, lines[pos] AS line FROM (SELECT row_id, host, lines, unnest(range(1, len(lines) + 1)) AS pos FROM lined)
), common AS (
  SELECT s.host, s.line FROM (SELECT host, line, count(DISTINCT row_id) AS n FROM spread GROUP BY ALL) s
  JOIN (SELECT host, count(*) AS n_pages FROM lined GROUP BY host) t USING (host) WHERE s.n >= 2 AND s.n > 0.3 * t.n_pages
), kept AS (
  SELECT row_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM spread
  WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.host = spread.host AND c.line = spread.line) GROUP BY row_id
)
SELECT l.page_id, l.host, len(l.lines)::BIGINT AS n_lines, (len(l.lines) - coalesce(k.n, 0))::BIGINT AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM lined l LEFT JOIN kept k USING (row_id)
"""
