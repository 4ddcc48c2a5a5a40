"""Operator 4, WARC fixity audit by Merkle trees.

Pages become WARC response records, stored in files by page_id. The hash of a record, with its
offset inside the lowest range and its length, is a leaf; ``FAN`` leaves in the order of their
offsets hash into a range, ``FAN`` ranges into a larger one, up to the root of the file. Two
replicas are compared root by root, and only ranges whose parents differ are compared further,
down to the records. Ranges are aligned by record id, so a lost or longer record changes the
hashes of its own ranges only.

Native DataFrame code. Records that share an id are one leaf (count, least and greatest hash, sum of
hashes), so every grouping but that pre-aggregated one is bounded by ``FAN``.

Defined results: a null url or html is an empty field, a null page_id belongs to file -1; an id
repeated more or less often is ``altered``; a table against itself or two empty ones give no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.llm.common import cut_lineage, table

FAN = 16
#: Levels of ranges above the records: a file covers FAN ** LEVELS ids.
LEVELS = 3
NO_ID_FILE = -1


def records(pages: DataFrame) -> DataFrame:
    """``(page_id, bytes)``: each page's record, headers and payload; dates and ids follow from the page."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
                    F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
                    F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.concat(head, html, F.lit("\r\n\r\n")).alias("bytes"))


def leaves(recs: DataFrame) -> DataFrame:
    """One leaf per record id: file, place in the file, length, offset in the file, hash."""
    per_file = FAN**LEVELS
    d = recs.select("page_id", F.octet_length("bytes").cast("long").alias("length"), F.sha2(F.col("bytes").cast("binary"), 256).alias("sha"))
    d = d.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.min("sha").alias("lo"), F.max("sha").alias("hi"),
                                 F.sum(F.xxhash64("sha").cast("decimal(38,0)")).alias("all"))
    once = F.col("n") == 1
    digest = F.when(once, F.col("lo")).otherwise(F.sha2(F.concat_ws("|", F.col("n").cast("string"), "lo", "hi", F.col("all").cast("string")), 256))
    d = d.select("page_id", F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(NO_ID_FILE)).alias("file"),
                 F.coalesce(F.pmod(F.col("page_id"), F.lit(per_file)), F.lit(0)).cast("long").alias("place"), "length", digest.alias("digest"))
    before = F.sum("length").over(Window.partitionBy("file").orderBy("place", "page_id").rowsBetween(Window.unboundedPreceding, -1))  # at most FAN ** LEVELS rows
    return d.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels 0 (records) to ``LEVELS`` (roots): ``(file, node, hash, start, length)``, node = place div FAN ** level."""
    first = F.min("offset").over(Window.partitionBy("file", F.floor(F.col("place") / FAN)))
    here = leaf.select("file", F.col("place").alias("node"), "page_id", "offset", "length", "digest",
                       F.sha2(F.concat_ws("|", (F.col("offset") - first).cast("string"), F.col("length").cast("string"), "digest"), 256).alias("hash"))
    levels = [cut_lineage(here)]
    for _ in range(LEVELS):
        below = levels[-1]
        kids = F.sort_array(F.collect_list(F.struct("node", "offset", "length", "hash")))  # at most FAN
        up = below.groupBy("file", F.floor(F.col("node") / FAN).alias("node")).agg(kids.alias("k"))
        joined = F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), "|")
        levels.append(cut_lineage(up.select("file", "node", F.get("k.offset", F.lit(0)).alias("offset"),
                                            F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
                                            F.sha2(joined, 256).alias("hash"))))
    return levels


def _differing(a: DataFrame, b: DataFrame, more: list[str]) -> DataFrame:
    """Nodes whose hashes differ or that one side lacks; ``more`` columns from both sides."""
    cols = ["hash", *more]
    l = a.select("file", "node", *[F.col(c).alias("l_" + c) for c in cols])  # noqa: E741
    r = b.select("file", "node", *[F.col(c).alias("r_" + c) for c in cols])
    return l.join(r, ["file", "node"], "full_outer").where(~F.col("l_hash").eqNullSafe(F.col("r_hash")))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Corrupt records of ``right`` against ``left`` (both ``(page_id, bytes)``).

    ``page_id, file, offset, length`` (of ``left``; null where it lacks the record), ``found_length``,
    ``expected``, ``found`` (hashes) and ``kind``: altered, missing or extra.
    """
    a, b = tree(leaves(left)), tree(leaves(right))
    open_ = _differing(a[LEVELS], b[LEVELS], []).select("file", "node")
    for level in range(LEVELS - 1, -1, -1):
        parent = F.floor(F.col("node") / FAN)
        marks = open_.select("file", F.col("node").alias("parent"))
        x, y = (s.withColumn("parent", parent).join(marks, ["file", "parent"], "left_semi") for s in (a[level], b[level]))
        found = _differing(x, y, ["page_id", "offset", "length", "digest"] if level == 0 else [])
        open_ = cut_lineage(found.select("file", "node")) if level else found
    # a leaf's hash also holds its offset in the range: a record that only moved is no damage
    bad = open_.where(~F.col("l_digest").eqNullSafe(F.col("r_digest")))
    kind = F.when(F.col("r_hash").isNull(), "missing").when(F.col("l_hash").isNull(), "extra").otherwise("altered")
    return bad.select(F.coalesce("l_page_id", "r_page_id").alias("page_id"), "file", F.col("l_offset").alias("offset"), F.col("l_length").alias("length"),
                      F.col("r_length").alias("found_length"), F.col("l_digest").alias("expected"), F.col("r_digest").alias("found"), kind.alias("kind"))


def damaged(pages: DataFrame) -> DataFrame:
    """The replica of the query: of every 1,009 pages one lost its record, of every 211 one has a byte of the page altered."""
    keep = F.coalesce(F.col("page_id") % 1009 != 17, F.lit(True))
    html = F.coalesce("html", F.lit(""))
    at = F.floor(F.length(html) / 2).cast("int")
    hit = F.coalesce(F.col("page_id") % 211 == 5, F.lit(False)) & (F.length(html) > 1)
    other = F.when(F.substring(html, at, F.lit(1)) == "#", "%").otherwise("#")
    bad: Column = F.concat(F.substring(html, F.lit(1), at - 1), other, F.substring(html, at + 1, F.length(html)))
    return pages.where(keep).withColumn("html", F.when(hit, bad).otherwise(F.col("html")))


def op4_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(records(pages), records(damaged(pages)))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, CASE WHEN page_id % 211 = 5 AND length(html) > 1
        THEN substr(html, 1, length(html) // 2 - 1) || CASE WHEN substr(html, length(html) // 2, 1) = '#' THEN '%' ELSE '#' END
             || substr(html, length(html) // 2 + 1) ELSE html END AS bad FROM p),
r AS (SELECT page_id,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
  chr(13) || chr(10) || chr(13) || chr(10) AS crlf2, html, bad FROM d),
w AS (SELECT page_id, head || strlen(html) || crlf2 || html || crlf2 AS a,
  CASE WHEN page_id % 1009 = 17 THEN NULL ELSE head || strlen(bad) || crlf2 || bad || crlf2 END AS b FROM r),
o AS (SELECT page_id, page_id // 4096 AS file, strlen(a) AS length, strlen(b) AS found_length, sha256(a) AS expected, sha256(b) AS found,
  coalesce(sum(strlen(a)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM w)
SELECT page_id, CAST(file AS BIGINT) AS file, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, CAST(found_length AS BIGINT) AS found_length,
  expected, found, CASE WHEN found IS NULL THEN 'missing' ELSE 'altered' END AS kind
FROM o WHERE found IS NULL OR expected <> found
"""
