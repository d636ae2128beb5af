"""Line deduplication with DataFrame functions only.

Lines are exploded without their text: only (document, position, 128-bit hash of the normalised line) is shuffled. Counting distinct
documents and finding the largest doc_id of a hash are aggregates with map-side partials, so a line that a third of all documents hold
costs one row per task. The hashes are computed once and checkpointed, and so are the common ones, so their join is a broadcast of a
counted table or one of plain exchanges, whose large partitions Spark splits. What a document loses comes back as a list of positions,
joined to its lines, which are put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidestream.llm.common import quoted
from slidestream.shared import broadcast_if_small, cut

MIN_CHARS = 20
MIN_DOCS = 3
_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def dropped_lines(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``(id, row, drop)`` of rows that lose lines: the positions, from 0."""
    key = line_key(F.col("line"))
    keyed = cut(
        rows.select("id", "row", F.posexplode("lines").alias("pos", "line"))
        .where(F.char_length(key) >= min_chars)
        .select("id", "row", "pos", F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))
    )
    common = cut(keyed.groupBy("h", "g").agg(F.countDistinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).drop("n"))
    return keyed.join(broadcast_if_small(common), ["h", "g"]).where("id < last").groupBy("id", "row").agg(F.collect_set("pos").alias("drop"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` cut down, and ``n_lines`` and ``n_dropped`` added (replacing columns of those names).

    Lines whose key has at least ``min_chars`` code points and is found in at least ``min_docs`` documents go from all but the largest
    doc_id that holds the key; there all its lines stay. A null or empty text is one empty line. Rows that share a doc_id count as
    one document; a null doc_id counts as one document, smaller than all others. Repeated rows give repeated results; an empty
    table gives no rows. Other columns pass through, whatever their names.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    held = F.struct(*[F.col(quoted(c)) for c in names if c != "text"]).alias("__rest")
    rows = docs.select(held, F.xxhash64("doc_id", "text").alias("row"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    drops = dropped_lines(rows.select("id", "row", "lines"), min_chars, min_docs)
    both = rows.join(drops, ["id", "row"], "left").withColumn("n_lines", F.size("lines").cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    lines = F.col("lines")
    text = F.when(F.col("drop").isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(stay, lambda k: lines[k]), "\n"))
    return both.select(
        *[text.alias("text") if c == "text" else F.col("__rest").getField(c).alias(c) for c in names],
        "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM {documents}),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines),
common AS (
  SELECT line_key, max(doc_id) AS last FROM keyed WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id < last, false) AS dropped FROM keyed LEFT JOIN common USING (line_key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
