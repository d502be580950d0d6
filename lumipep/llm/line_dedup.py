"""Line dedup by site-relative frequency, in DataFrame functions only.

A page's lines are the trimmed, non-empty pieces of text between its tags. For each host, the pages that hold
a line are divided by the host's pages; a line above the boilerplate ratio is dropped from that host's pages.

Lines are counted by their md5, once a page, with partial sums before the exchange, so a host or a line with
a third of all rows is summed where it is read. A host's list of boilerplate lines has at most (mean lines a
page) / ratio entries, whatever its number of pages; those lists, one row a host, are written and their size is
counted. Up to BROADCAST_BYTES they are broadcast and no text moves; beyond, the pages are joined to them by host,
and AQE splits the partition of a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .url_filter import host_path

RATIO = 0.5
#: A line on fewer pages of a host repeats nothing. At the ratio above this only concerns hosts of a single page.
MIN_REPEATS = 2
BROADCAST_BYTES = 32 << 20
#: Scripts, styles and comments with what they hold, then any other tag. Fixed value.
TAGS = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"


def page_lines(html: Column) -> Column:
    """Trimmed, non-empty lines of the text of a page, in order; for a plain text, its lines."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), TAGS, "\n")
    return F.filter(F.transform(F.split(text, r"[\n\r]+"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(pages: DataFrame, ratio: float, min_repeats: int) -> DataFrame:
    """pages: host, lines. Gives host, drop: md5 of the lines in more than `ratio` of the host's pages."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages_of_host"))
    held = pages.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    frequent = held.filter(F.col("n") >= min_repeats).join(totals, "host").filter(F.col("n") > F.col("pages_of_host") * F.lit(ratio))
    return frequent.groupBy("host").agg(F.collect_list("key").alias("drop"))


def line_dedup(pages: DataFrame, host: Column, text: str = "html", id_col: str = "page_id", ratio: float = RATIO, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """One row for each row of pages: id, host, n_lines, n_dropped, text (the lines that stay, joined by newlines).

    A line counts once a page. A null text has no lines and gives an empty text, but its page counts for the
    host. Null or unreadable URLs share the empty host. Exactly at the ratio a line stays. Rows that repeat
    count as pages of their own, those with a null id as well; a long page is handled whole. Empty input gives an empty result; further columns are ignored.
    """
    parts = pages.select(F.col(id_col), host.alias("host"), page_lines(F.col(text)).alias("lines"))
    drop = stage(boilerplate(parts, ratio, min_repeats), "boilerplate")
    held = drop.agg(F.sum(F.size("drop") * 32 + F.octet_length("host") + 32).alias("bytes")).first()["bytes"] or 0
    joined = parts.join(F.broadcast(drop) if held <= BROADCAST_BYTES else drop, "host", "left")
    stay = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), _key(x))))
    return joined.withColumn("stay", stay).select(
        id_col,
        "host",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size("stay")).alias("n_dropped"),
        F.array_join("stay", "\n").alias("text"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "pages"), host_path(F.col("url"))[0])


_BLANK = r"[\x20\x09-\x0D]+"
SQL = {
    "op10_line_dedup": rf"""
WITH a AS (SELECT page_id, translate(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^/?#]*'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_replace(coalesce(html, ''), '{TAGS}', chr(10), 'g') AS txt FROM pages),
l AS (SELECT row_number() OVER () AS r, page_id, host,
             list_filter(list_transform(regexp_split_to_array(txt, '[\n\r]+'), lambda x: regexp_replace(x, '^{_BLANK}|{_BLANK}$', '', 'g')), lambda x: x <> '') AS lines FROM a),
h AS (SELECT host, count(*) AS n FROM l GROUP BY host),
f AS (SELECT host, line, count(*) AS c FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY ALL),
b AS (SELECT f.host, line FROM f JOIN h ON h.host = f.host WHERE f.c >= {MIN_REPEATS} AND f.c > h.n * {RATIO}),
bl AS (SELECT host, list(line) AS bad FROM b GROUP BY host),
k AS (SELECT l.page_id, l.host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)) AS stay FROM l LEFT JOIN bl ON bl.host = l.host)
SELECT page_id, host, len(lines)::INTEGER AS n_lines, (len(lines) - len(stay))::INTEGER AS n_dropped, array_to_string(stay, chr(10)) AS text FROM k"""
}
QUERIES = {"op10_line_dedup": op10_line_dedup}
