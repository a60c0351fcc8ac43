"""Line dedup by site-relative frequency.

Rows are pages of a host. For every host the pages that contain a line are counted and
divided by the pages of the host; lines above ``ratio`` are boilerplate of that host and
are removed from all its pages. Pages of a host with the same text count once in both
numbers: a page that was copied a hundred times says no more about its host than one, and
must not lose its own lines for it.

Counts cover all pages. Copies are counted out by a digest of the text (combined map-side,
so a hot page is one row a task), lines are made distinct inside each page, and the rest is
one map-side combined aggregation over (host, line hash): a hot host spreads over its many
lines and a hot line is combined before the shuffle. A page has one more line that stands for
the page itself, so the pages of a host are counted in the same pass. Texts are read once for the counts and
once to be cleaned, and are not shuffled for the counts.

Lines are told by 64-bit hashes, inside their host: among a billion different lines of a host and a thousand of
boilerplate, one line is taken for another with a chance of one in ten million. A page's lines meet the host's
boilerplate as sets, so the work grows with the lines of both and not with their product.

Defined results: a null text stays null and has no lines; lines are split at ``\\n`` and
compared without surrounding spaces; blank lines are never dropped; a null host is a host
of its own; a line must stand on ``min_pages`` different pages at least, so that hosts of a
few pages lose nothing by chance; a page that consists of boilerplate becomes empty text, it
is not removed. Repeated rows are pages with the same text, and all are cleaned. Very long
texts are read whole; empty tables give empty results. Columns of the input named
``lines_total`` or ``lines_dropped`` are replaced, columns that begin with ``__`` dropped; all
others are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, snapshot

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.01
#: ... if it stands on this many of them at least.
MIN_PAGES = 3
#: Boilerplate lines are broadcast up to this many (about 20 bytes each); beyond it the
#: pages meet them in a join on (host, salt).
BROADCAST_LINES = 50_000
SALTS = 64


def _hash(line: Column) -> Column:
    """A long that stands for a line, without the spaces around it."""
    return F.xxhash64(F.btrim(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(lines: Column) -> Column:
    """Hashes of the lines that are not blank."""
    return F.transform(F.filter(lines, lambda x: F.btrim(x) != ""), _hash)


def _without(lines: Column, bad: Column) -> Column:
    """The lines whose hashes are not among ``bad``; blank ones stay."""

    def cut(found: Column) -> Column:
        stays = lambda x: (F.btrim(x) == "") | ~F.array_contains(found, _hash(x))
        return F.when(F.size(found) == 0, lines).otherwise(F.filter(lines, stays))

    # what the page has of the host's boilerplate, found once for all its lines
    return F.element_at(F.transform(F.array(F.array_intersect(_keys(lines), bad)), cut), 1)


def boilerplate_lines(
    pages: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, line hash, pages with the line, pages of the host) of every boilerplate line."""
    keys = F.array_distinct(_keys(_lines(F.col("text"))))
    rows = pages.select(host.alias("__host"), F.unhex(F.md5(F.col("text"))).alias("__page"), keys.alias("__keys"))
    rows = rows.groupBy("__host", "__page").agg(F.first("__keys").alias("__keys"))  # equal pages have equal keys
    none = F.array(F.lit(None).cast("bigint"))  # the page itself
    counts = (
        rows.select("__host", F.explode(F.concat(F.coalesce("__keys", F.array().cast("array<bigint>")), none)).alias("__line"))
        .groupBy("__host", "__line")
        .agg(F.count("*").alias("line_pages"))
        .where(F.col("__line").isNull() | (F.col("line_pages") >= min_pages))
    )
    counts = snapshot(counts, "line-counts")
    totals = counts.where(F.col("__line").isNull()).select(F.col("__host").alias("__h"), F.col("line_pages").alias("host_pages"))
    same = F.col("__host").eqNullSafe(F.col("__h"))
    return (
        counts.where(F.col("__line").isNotNull())
        .join(totals, same)
        .where(F.col("line_pages") > ratio * F.col("host_pages"))
        .drop("__h")
    )


def drop_boilerplate(
    pages: DataFrame,
    host: Column | None = None,
    id_col: str = "doc_id",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``pages`` with cleaned ``text`` and the counts ``lines_total`` and ``lines_dropped``.

    The boilerplate of a host is at most (mean lines of its pages) / ratio lines, kept as
    one array of hashes per host. While all of it is at most ``broadcast_lines`` lines,
    no text is shuffled; otherwise pages and salted copies of the arrays meet by
    (host, salt), so that a hot host is dealt to ``SALTS`` keys.
    """
    spark = pages.sparkSession
    host = F.col("source") if host is None else host
    columns = [c for c in pages.columns if c not in ("text", "lines_total", "lines_dropped") and not c.startswith("__")]
    found = boilerplate_lines(pages, host, ratio, min_pages).select("__host", "__line")
    few = found.limit(broadcast_lines + 1).collect()
    small = len(few) <= broadcast_lines
    if small:
        found = spark.createDataFrame([tuple(r) for r in few], found.schema)
    bad = found.groupBy(F.col("__host").alias("__h")).agg(F.collect_list("__line").alias("__bad"))
    same = F.col("__host").eqNullSafe(F.col("__h"))
    hosted = pages.select(*columns, "text", host.alias("__host"))
    if small:
        joined = hosted.join(F.broadcast(bad), same, "left")  # at most ``broadcast_lines`` hashes
    else:
        bad = bad.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(id_col, "text"), F.lit(SALTS)).cast("int")
        joined = hosted.withColumn("__salt", salt).join(bad, same & (F.col("__salt") == F.col("__s")), "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("__bad").isNull(), lines).otherwise(_without(lines, F.col("__bad")))
    out = joined.withColumn("__kept", kept)
    text = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.array_join("__kept", "\n"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    total = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(size(lines))
    left = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(size("__kept"))
    return out.select(
        *columns, total.alias("lines_total"), (total - left).alias("lines_dropped"), text.alias("text")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "lines_total", "lines_dropped", "text")


OP7_SQL = f"""
WITH p AS (SELECT DISTINCT source, text FROM documents),
totals AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
keys AS (
  SELECT source,
         unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line
  FROM p),
bad AS (
  SELECT k.source, k.line FROM keys k JOIN totals t ON k.source IS NOT DISTINCT FROM t.source
  GROUP BY k.source, k.line, t.pages
  HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * t.pages),
lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
cut AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS ls, d.text IS NULL AS none,
         list_filter(string_split(d.text, chr(10)),
           lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(l.bad, []), trim(x, ' '))) AS kept
  FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, source,
       CASE WHEN none THEN 0 ELSE len(ls) END AS lines_total,
       CASE WHEN none THEN 0 ELSE len(ls) - len(kept) END AS lines_dropped,
       CASE WHEN none THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM cut
"""
