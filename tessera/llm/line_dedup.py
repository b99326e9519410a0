"""Line dedup by site-relative frequency (operator 9), DataFrame functions only.

A line that stands on a large share of a host's pages is boilerplate of that
host. Per host, the pages that contain a line are divided by the pages of the
host; lines above ``ratio`` are dropped from the texts. Copies of a page are one
page here: a line is no boilerplate because its page was copied. What near
copies share may still pass the ratio, so a page that would lose more than
``most`` of its text keeps all of it; telling copies apart is not this operator's.

Scale. Pages are made distinct by two 64-bit hashes of their text, and the shuffle
carries two more per distinct line of a page, never the line itself; both are
summed before it (copies collapse within a task). What comes back is one row per
host with the hashes of its boilerplate lines: sum(pages of a line) =
sum(distinct lines of a page), so a host has at most (mean distinct lines of a
page) / ``ratio`` of them. That table is cut, its size is known, and it is
broadcast only below ``broadcast_rows`` hashes; beyond, the pages are dealt by
(host, salt), so that a host with a third of all pages is spread over ``salts``
tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh


def _hashes(c, name: str):
    """128 bits of a text."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(name), c).alias("b"))


def _key(line):
    return _hashes(F.trim(line), "line")


def boilerplate_lines(pages: DataFrame, text: str = "text", host: str = "source",
                      ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """(host, lines: array of line keys) for hosts that have boilerplate.

    A page is a different text of a host, NULL is no page; blank lines are not
    judged; NULL is a host of its own. A line repeated within a page counts once.
    """
    p = pages.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    page = _hashes(F.col("text"), "page").alias("page")
    totals = p.select("host", page).distinct().groupBy("host").agg(F.count("*").alias("total"))
    lines = F.array_distinct(F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))
    # the key of a copy is the same, and so are its lines
    distinct = p.select("host", page, lines.alias("lines")).groupBy("host", "page").agg(F.first("lines").alias("lines"))
    counted = (distinct.select("host", F.explode("lines").alias("line"))
                .groupBy("host", "line").agg(F.count("*").alias("n"))
                .where(F.col("n") >= min_pages))
    bad = (counted.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
                  .where(F.col("n") > F.lit(float(ratio)) * F.col("total")))
    return bad.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, text: str = "text", host: str = "source",
                     ratio: float = 0.05, min_pages: int = 3, salts: int = 64,
                     broadcast_rows: int = 1_000_000, most: float = 0.5) -> DataFrame:
    """``pages`` with ``text`` rid of its boilerplate lines, plus ``n_lines``
    and ``n_dropped`` (both replace columns of that name).

    Every row stays. A NULL text stays NULL with 0 lines; an empty text has one
    (blank) line and stays as it is. A text that would lose more than ``most`` of
    its characters loses none, so no text ends empty. Repeated texts of a host
    count as one page and are all cleaned alike. Lines end at '\\n' and keep their own
    white space; the comparison ignores spaces around a line.
    """
    h, bad, salt = (fresh(pages, x) for x in ("host", "bad", "salt"))
    found = cut(boilerplate_lines(pages, text, host, ratio, min_pages)
                .select(F.col("host").alias(h), F.col("lines").alias(bad)))
    hashes = found.agg(F.sum(F.size(bad))).first()[0] or 0
    same_host = F.col(host).eqNullSafe(F.col(h))
    if hashes <= broadcast_rows:       # 16 bytes a hash: bounded by the check
        joined = pages.join(F.broadcast(found), same_host, "left")
    else:
        copies = found.withColumn(salt + "r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = (pages.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(salts)).cast("int"))
                       .join(copies, same_host & (F.col(salt) == F.col(salt + "r")), "left")
                       .drop(salt, salt + "r"))
    lines = F.split(F.col(text), "\n")
    keep = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(bad), _key(x)))
    n, kept = fresh(pages, "n"), fresh(pages, "kept")
    enough = F.length(F.array_join(kept, "\n")) >= F.lit(1.0 - most) * F.length(text)
    out = (joined.withColumn(kept, F.when(F.col(bad).isNull(), lines).otherwise(keep))
                 .withColumn(kept, F.when(enough, F.col(kept)).otherwise(lines))
                 .withColumn(n, F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)))
                 .withColumn(text, F.array_join(kept, "\n"))
                 .withColumn("n_lines", F.col(n).cast("long"))
                 .withColumn("n_dropped", F.when(F.col(text).isNull(), F.lit(0).cast("long"))
                             .otherwise((F.col(n) - F.size(kept)).cast("long"))))
    return out.drop(h, bad, n, kept)


def sql(ratio: float = 0.05, min_pages: int = 3, most: float = 0.5) -> str:
    """The same for DuckDB over ``documents``, comparing texts and lines themselves."""
    return f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(DISTINCT text) AS total FROM documents WHERE text IS NOT NULL GROUP BY source),
freq AS (
  SELECT source, trim(line) AS k, count(DISTINCT text) AS n
  FROM lines WHERE trim(line) <> '' GROUP BY ALL),
bad AS (
  SELECT f.source, f.k FROM freq f JOIN totals t ON f.source IS NOT DISTINCT FROM t.source
  WHERE f.n >= {min_pages} AND f.n > CAST({ratio} AS DOUBLE) * t.total),
judged AS (
  SELECT l.*, b.k IS NOT NULL AS drop_it FROM lines l
  LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line) = b.k),
joined AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_it), '') AS text,
         count(*) AS n_lines, count(*) FILTER (drop_it) AS n_dropped
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN whole THEN d.text ELSE j.text END AS text, coalesce(j.n_lines, 0) AS n_lines,
       CASE WHEN whole THEN 0 ELSE coalesce(j.n_dropped, 0) END AS n_dropped
FROM (SELECT d.*, length(j.text) < CAST({1.0 - most} AS DOUBLE) * length(d.text) AS whole, j.doc_id AS jd
      FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id) d LEFT JOIN joined j ON d.doc_id = j.doc_id"""
