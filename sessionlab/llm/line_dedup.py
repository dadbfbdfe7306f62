"""Line dedup by site-relative frequency: lines that a large share of a site's pages contain are boilerplate.

DataFrame functions only. Lines are counted by 64-bit hashes, once for each different page, with partial sums before
the shuffle. A site has at most (lines a page) / ratio boilerplate lines, so they fit one array for each site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlab.llm.common import stage

#: Boilerplate lines up to this many are sent to all executors; beyond, documents meet them in a shuffle, whose hot
#: sites the adaptive join splits.
BROADCAST_LINES = 100_000


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): the hashes of the lines of each host that more than `ratio` of its pages, and at least min_pages,
    contain. pages: host, text. A page that a host repeats word for word counts once; blank lines are never counted."""
    known = pages.where("host is not null and text is not null").select("host", F.xxhash64("text").alias("page"), "text")
    total = known.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    lines = known.select("host", "page", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.trim("line") != "")
    seen = lines.select("host", "page", F.xxhash64("line").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return seen.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """docs with text less its host's boilerplate lines, and n_lines and n_dropped (names that docs must not have).

    Lines are separated by \\n and compared as they are. Rows with a null host keep all lines; a null text stays null,
    with 0 lines; a text all of whose lines go is empty. Other columns pass through. An empty table stays empty.
    """
    common = stage(boilerplate(docs.select(F.col(host).alias("host"), "text"), ratio, min_pages), "boilerplate").withColumnsRenamed({"host": "_host", "lines": "_lines"})
    size = common.agg(F.coalesce(F.sum(F.size("_lines")), F.lit(0))).first()[0]
    met = docs.join(F.broadcast(common) if size <= BROADCAST_LINES else common, F.col(host) == F.col("_host"), "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("_lines").isNull(), lines).otherwise(F.filter(lines, lambda line: ~F.array_contains(F.col("_lines"), F.xxhash64(line))))
    count = lambda a: F.when(F.col("text").isNull(), 0).otherwise(F.size(a))
    met = met.withColumn("_kept", kept).withColumns({"n_lines": count(lines), "n_dropped": count(lines) - count(F.col("_kept"))})
    return met.withColumn("text", F.array_join("_kept", "\n")).select(*docs.columns, "n_lines", "n_dropped")


LINE_SQL = """
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
total AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages),
common AS (SELECT source, line FROM (SELECT source, line, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY source, line)
  JOIN total USING (source) WHERE n >= 5 AND n > 0.05 * pages),
listed AS (SELECT source, list(line) AS gone FROM common GROUP BY source),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines,
  CASE WHEN gone IS NULL THEN string_split(text, chr(10)) ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, x)) END AS kept
  FROM documents LEFT JOIN listed USING (source))
SELECT doc_id, CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS INTEGER) AS n_dropped,
  md5(array_to_string(kept, chr(10))) AS kept_md5 FROM cut
"""
