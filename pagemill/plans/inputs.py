"""Inputs of the registered queries, written alike in Spark and in SQL.

The driver's tables hold next to no headings, lists or references, so documents get
them by their number: headings, blanks and formulas as lines of their own, item marks,
citations and odd characters around lines that stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, line_idx, line: all lines of documents, whole, with further lines put before some of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.split(F.coalesce("text", F.lit("")), "\n"), F.array(F.concat(F.lit("["), F.col("doc_id") % 9 + 1, F.lit("] Some source")), F.lit("[^2]: A note"))).alias("lines"))
    k = F.col("doc_id")

    def with_more(t, n):
        title = F.concat((k % 3 + 1).cast("string"), F.when(k % 2 == 1, F.concat(F.lit("."), (k % 4 + 1).cast("string"))).otherwise(""), F.lit(" Title "), k.cast("string"))
        line = (
            F.when(t.rlike(r"^\[\^?\d"), t).when((n + k) % 5 == 1, F.concat(F.lit("- "), t)).when((n + k) % 7 == 2, F.concat(n.cast("string"), F.lit(". "), t))
            .when((n + k) % 6 == 4, F.concat(t, F.lit(" ["), (k % 9 + 1).cast("string"), F.lit(", 77] and [^2] in Figure "), (k % 3 + 1).cast("string"), F.lit(" or Table "), (k % 2 + 1).cast("string")))
            .when((n + k) % 11 == 0, F.concat(t, F.lit("\u00ad"))).when((n + k) % 13 == 0, F.concat(t, F.lit(" (cid:7) \ufffd"))).when((n + k) % 17 == 0, F.concat(t, F.lit(" word- break"))).otherwise(t)
        )
        more = [F.when(n == 0, title), F.when((n == 1) & (k % 7 == 0), "References"), F.when((n + k) % 4 == 3, ""), F.when((n + k) % 23 == 5, "f(x) = sum_i a * b_1 / n"), F.when((n + k) % 29 == 6, "y = a + b / c")]
        return F.filter(F.array(*more, line), lambda x: x.isNotNull())

    rows = d.select("doc_id", F.posexplode(F.flatten(F.transform("lines", with_more))).alias("l", "line"))
    return rows.select("doc_id", (F.floor(F.col("l") / LINES_PER_PAGE) + 1).cast("int").alias("page_number"), (F.col("l") % LINES_PER_PAGE).alias("line_idx"), "line")


INJECTED = f"""
inj0 AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10)) || ['[' || (doc_id % 9 + 1) || '] Some source', '[^2]: A note']) AS t,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)) || ['', ''], 1) - 1 AS n FROM documents
), inj1 AS (
  SELECT doc_id, n, [CASE WHEN n = 0 THEN (doc_id % 3 + 1) || CASE WHEN doc_id % 2 = 1 THEN '.' || (doc_id % 4 + 1) ELSE '' END || ' Title ' || doc_id END,
    CASE WHEN n = 1 AND doc_id % 7 = 0 THEN 'References' END, CASE WHEN (n + doc_id) % 4 = 3 THEN '' END,
    CASE WHEN (n + doc_id) % 23 = 5 THEN 'f(x) = sum_i a * b_1 / n' END, CASE WHEN (n + doc_id) % 29 = 6 THEN 'y = a + b / c' END,
    CASE WHEN regexp_matches(t, '^\\[\\^?[0-9]') THEN t WHEN (n + doc_id) % 5 = 1 THEN '- ' || t WHEN (n + doc_id) % 7 = 2 THEN n || '. ' || t
         WHEN (n + doc_id) % 6 = 4 THEN t || ' [' || (doc_id % 9 + 1) || ', 77] and [^2] in Figure ' || (doc_id % 3 + 1) || ' or Table ' || (doc_id % 2 + 1)
         WHEN (n + doc_id) % 11 = 0 THEN t || chr(173) WHEN (n + doc_id) % 13 = 0 THEN t || ' (cid:7) ' || chr(65533) WHEN (n + doc_id) % 17 = 0 THEN t || ' word- break' ELSE t END] AS x FROM inj0
), inj2 AS (
  SELECT doc_id, n, unnest(x) AS line, generate_subscripts(x, 1) AS j FROM inj1
), inj3 AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n, j) - 1 AS l FROM inj2 WHERE line IS NOT NULL
), inj AS (
  SELECT doc_id, CAST(l // {LINES_PER_PAGE} + 1 AS INTEGER) AS page_number, CAST(l % {LINES_PER_PAGE} AS INTEGER) AS line_idx, line FROM inj3
)""".replace("\\\\", "\\")


CLASSIFIED = INJECTED + r""", cls AS (
  SELECT doc_id, page_number, line_idx, line,
    CASE WHEN regexp_matches(line, '^\s*$') THEN 'blank'
         WHEN lower(line) IN ('abstract', 'references', 'acknowledgements') OR regexp_matches(line, '^\d+(\.\d+)*\s+\S') THEN 'heading'
         WHEN regexp_matches(line, '^([*+\-•▪◦]|\d+[.)])\s+.+$') THEN 'list_item' ELSE 'paragraph' END AS kind,
    CASE WHEN lower(line) IN ('abstract', 'references', 'acknowledgements') THEN 1
         WHEN regexp_matches(line, '^\d+(\.\d+)*\s+\S') THEN least(6, len(regexp_replace(split_part(regexp_replace(line, '\s', ' '), ' ', 1), '[^.]', '', 'g')) + 1) END AS heading_level,
    CASE WHEN regexp_matches(line, '^([*+\-•▪◦])\s+.+$') THEN false WHEN regexp_matches(line, '^\d+[.)]\s+.+$') THEN true END AS ord_,
    CASE WHEN NOT regexp_matches(line, '^\d+(\.\d+)*\s+\S') AND regexp_matches(line, '^([*+\-•▪◦]|\d+[.)])\s+.+$') THEN regexp_extract(line, '^([*+\-•▪◦]|\d+[.)])\s+(.+)$', 2) ELSE line END AS content
  FROM inj
), w1 AS (
  SELECT *, lag(kind) OVER p AS before, lead(kind) OVER p AS after_, lag(line) OVER p AS line_before FROM cls WINDOW p AS (PARTITION BY doc_id, page_number ORDER BY line_idx)
), w2 AS (
  SELECT *, last_value(CASE WHEN kind = 'list_item' THEN 'list_item' WHEN kind = 'heading' OR (kind = 'paragraph' AND before = 'blank') THEN 'other' END IGNORE NULLS)
    OVER (PARTITION BY doc_id, page_number ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner,
    kind = 'paragraph' AND coalesce(before = 'paragraph', false) AS runs_on FROM w1
), w3 AS (
  SELECT *, kind IN ('heading', 'list_item') OR (kind = 'paragraph' AND NOT runs_on AND coalesce(owner, 'other') <> 'list_item') AS starts FROM w2
), w4 AS (
  SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id, page_number ORDER BY line_idx) - 1 AS block_idx,
    CASE WHEN kind = 'paragraph' AND ends_with(line, chr(173)) AND coalesce(after_ = 'paragraph', false) THEN left(content, len(content) - 1) ELSE content END AS cut FROM w3
), blocks AS (
  SELECT doc_id, page_number, CAST(block_idx AS BIGINT) AS block_idx, max(kind) FILTER (starts) AS kind,
    string_agg(CASE WHEN starts THEN cut WHEN runs_on AND ends_with(line_before, chr(173)) THEN ltrim(cut) ELSE ' ' || cut END, '' ORDER BY line_idx) AS text,
    CAST(max(heading_level) FILTER (starts) AS INTEGER) AS heading_level, bool_or(CASE WHEN kind = 'list_item' THEN ord_ END) FILTER (starts) AS ordered
  FROM w4 WHERE kind <> 'blank' GROUP BY ALL
)"""
