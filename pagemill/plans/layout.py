"""Queries over positioned words, tables, figures and OCR."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import extract as E
from pagemill.operators import figures as G
from pagemill.operators import layout as Y
from pagemill.operators import ocr as O
from pagemill.operators import tables as T
from pagemill.plans.inputs import table

PAGE = ["doc_id", "page_number"]


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents, whole, set in boxes of 24 by 10 units: eight to a line, 50 lines a page, tops jittered by 0.3.

    Every third line jumps over the middle of the page after its fourth word; five lines
    make a paragraph, 18 units from the next.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).alias("i", "text"))
    line, at = F.floor(F.col("i") / 8), F.col("i") % 8
    page, row = F.floor(line / 50), line % 50
    left = at * 30.0 + F.when((row % 3 != 2) & (at >= 4), 320.0).otherwise(F.when(row % 3 == 2, at * 30.0).otherwise(0.0))
    top = row * 12.0 + F.floor(row / 5) * 16.0 + (F.col("i") % 2) * 0.3 + 60
    size = F.when(row == 0, 18.0).when(row == 20, 13.5).otherwise(10.0)
    return d.select("doc_id", (page + 1).cast("int").alias("page_number"), F.col("i").alias("word_idx"), "text", left.alias("x0"), (left + 24).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), size.alias("font_size"))


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select(*PAGE).distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(900.0))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(spark, sf_dir).select(*PAGE, F.lit(0.0).alias("x0"), F.lit(200.0).alias("top"), F.lit(600.0).alias("x1"), F.lit(260.0).alias("bottom"))


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.group_lines(_words(spark, sf_dir))


def line_group_anchored(spark, sf_dir):
    return _lined(spark, sf_dir).select("doc_id", "page_number", "line_idx", "word_idx")


def line_extents(spark, sf_dir):
    return Y.lines(_lined(spark, sf_dir))


def heading_levels_typographic(spark, sf_dir):
    return Y.typographic_headings(Y.lines(_lined(spark, sf_dir)))


def paragraph_gap_breaks(spark, sf_dir):
    return Y.paragraph_gaps(Y.lines(_lined(spark, sf_dir))).where("gap_before").select("doc_id", "page_number", "line_idx")


def gutter_split(spark, sf_dir):
    return Y.gutter_split(_lined(spark, sf_dir), _geometry(spark, sf_dir)).groupBy(*PAGE, "line_idx").agg(F.sum("side").alias("right_words"))


def two_column_order(spark, sf_dir):
    return Y.reading_order(_lined(spark, sf_dir), _geometry(spark, sf_dir), _boxes(spark, sf_dir))


def table_region_semijoin(spark, sf_dir):
    return Y.in_boxes(Y.lines(_lined(spark, sf_dir)), _boxes(spark, sf_dir)).select("doc_id", "page_number", "line_idx")


def bullet_nearest_line(spark, sf_dir):
    return Y.graphic_bullets(_shapes(spark, sf_dir), Y.lines(_lined(spark, sf_dir)))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(spark, sf_dir).select(*PAGE, F.explode(F.sequence(F.lit(0), F.lit(9))).alias("prim_idx")).select(*PAGE, "prim_idx", F.lit(-9.0).alias("x0"), F.lit(-5.0).alias("x1"), (F.col("prim_idx") * 37.0 + 62).alias("top"), (F.col("prim_idx") * 37.0 + 66).alias("bottom"), (F.col("prim_idx") % 4 != 3).alias("fill"))


def page_extraction(spark, sf_dir):
    """Positioned words to blocks, all steps together."""
    b = E.page_blocks(_words(spark, sf_dir), _geometry(spark, sf_dir), _boxes(spark, sf_dir), _shapes(spark, sf_dir))
    return b.select(*PAGE, "block_idx", "kind", "heading_level", "ordered", F.sha2("text", 256).alias("sha256"))


def caption_segments(spark, sf_dir):
    return Y.segment_lines(Y.segments(_lined(spark, sf_dir), 12.0)).select("doc_id", "page_number", "line_idx", "segment", "text", "x0", "x1")


def _raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table on each page of eight order lines; now and then a broken one, and one with other headers."""
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), "l_returnflag", "l_quantity", "l_partkey")
    head = F.array(F.lit("flag"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" part\nno "), (F.col("page_number") % 2).cast("string"))).otherwise("part"))
    row = F.array("l_returnflag", F.when((F.col("doc_id") + F.col("page_number")) % 5 == 0, F.when(F.col("doc_id") % 2 == 0, "").otherwise("(cid:3)")).otherwise(F.concat(F.lit("  p\t"), F.col("l_partkey").cast("string"), F.lit("\n\nx "))))
    grouped = o.groupBy("doc_id", "page_number").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_partkey").alias("l_partkey"))
    return grouped.select("doc_id", F.col("page_number").cast("int").alias("page_number"), F.lit(1).alias("table_number"), F.array(head, row).alias("cells"))


def table_normalize(spark, sf_dir):
    t = T.normalize_tables(_raw_tables(spark, sf_dir))
    return t.select("doc_id", "page_number", "accepted", F.array_join(F.flatten("cells"), "|").alias("cells"))


def table_reject(spark, sf_dir):
    return T.rejected_counts(T.normalize_tables(_raw_tables(spark, sf_dir)))


def table_merge_adjacent(spark, sf_dir):
    m = T.render(T.merge_adjacent(T.normalize_tables(_raw_tables(spark, sf_dir))))
    return m.select("doc_id", "table_id", "page_number", F.size("rows").alias("n_rows"), "markdown")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 4).alias("doc_id"), F.lit(1).alias("page_number"), (F.col("p_partkey") % 4).alias("image_idx"), F.col("p_partkey").alias("k"))
    return p.select("doc_id", "page_number", "image_idx", F.when(F.col("k") % 7 != 0, (F.col("k") % 5 * 100 + 40).cast("int")).alias("width"), F.lit(300).alias("height"), F.lit(8).alias("bits"), F.lit("DeviceGray").alias("color_space"), F.lit("FlateDecode").alias("filter"), F.when(F.col("k") % 3 == 0, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("00"))).alias("raw"), F.when(F.col("k") % 5 == 2, F.repeat(F.lit("x"), F.lit(72000)).cast("binary")).otherwise(F.unhex(F.lit("00"))).alias("decoded"))


def image_filter(spark, sf_dir):
    return G.image_kind(_images(spark, sf_dir)).select("doc_id", "image_idx", "kind", G.figure_id(F.col("page_number"), F.col("figure_number")).alias("asset_id"))


def _drawings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Primitives, captions and geometry of every page: two groups of strokes, captions below."""
    n = _geometry(spark, sf_dir).select(*PAGE)
    prim = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("prim_idx"))
    right = F.col("prim_idx") >= 5
    i = (F.col("prim_idx") % 5).cast("double")
    prim = prim.select(*PAGE, "prim_idx", (F.when(right, 340.0).otherwise(72.0) + i * 40).alias("x0"), (250 + i * 45).alias("top"), (F.when(right, 375.0).otherwise(107.0) + i * 40).alias("x1"), F.when(F.col("doc_id") % 4 == 0, 250 + i * 45).otherwise(290 + i * 45).alias("bottom"))
    cap = n.select(*PAGE, F.explode(F.sequence(F.lit(0), F.lit(1))).alias("caption_idx"))
    left = F.col("caption_idx") * 268 + F.when(F.col("doc_id") % 5 == 0, 0).otherwise(72)
    cap = cap.select(*PAGE, "caption_idx", F.concat(F.lit("Fig. "), F.col("caption_idx") + 1, F.lit(": x")).alias("caption"), left.cast("double").alias("x0"), (left + 190).cast("double").alias("x1"), F.lit(480.0).alias("top"), F.lit(492.0).alias("bottom"))
    return prim, cap, n.withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prim, captions, geometry = _drawings(spark, sf_dir)
    words = captions.select(*PAGE, "x0", "x1", "top", "bottom")
    return G.figure_candidates(G.components(G.boxes(prim)), captions, words, geometry)


def figure_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


def figure_numbering(spark, sf_dir):
    have = _drawings(spark, sf_dir)[2].where("doc_id % 2 = 0").select(*PAGE)
    return G.number_figures(_candidates(spark, sf_dir), have).select("doc_id", "caption", "asset_id")


def figure_crop(spark, sf_dir):
    return G.crop(_candidates(spark, sf_dir), _drawings(spark, sf_dir)[2], 144).select("doc_id", "caption", "left_px", "top_px", "right_px", "bottom_px", "valid")


def _tsv_rows(d: DataFrame) -> DataFrame:
    """d(doc_id, page_number, w) as OCR output: twelve fields a row, some broken."""
    row = lambda w, i: F.concat_ws("\t", F.when(i % 9 == 8, "4").otherwise("5"), F.lit("1\t1\t1\t1\t1"), (i % 10 * 50).cast("string"), F.floor(i / 10).cast("string"), F.when(i % 13 == 12, "wide").otherwise((F.length(w) * 5).cast("string")), F.lit("10"), F.when(i % 7 == 6, "n/a").otherwise((F.col("doc_id") % 40 + 60 + i % 3).cast("string")), w)
    return d.select("doc_id", "page_number", F.concat(F.lit("head\n"), F.array_join(F.transform("w", row), "\n")).alias("tsv"))


def _tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each document, 60 a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.split(F.coalesce("text", F.lit("")), r"\s+"))).alias("all"))
    # slice() would read the whole document for each page.
    page = lambda p: F.struct((p + 1).cast("int").alias("page_number"), F.transform(F.sequence(p * 60, F.least(p * 60 + 60, F.size("all")) - 1), lambda i: F.get("all", i)).alias("w"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / 60).cast("int")), page)
    # Dealt by page, so that neither a long document nor a table of one file stays in one task.
    return _tsv_rows(d.select("doc_id", F.inline(pages)).repartition(*PAGE))


def ocr_tsv_parse(spark, sf_dir):
    return O.parse_tsv(_tsv(spark, sf_dir))


def ocr_confidence(spark, sf_dir):
    pages = _tsv(spark, sf_dir)
    return O.confidence(O.parse_tsv(pages), pages, 70.0).select("doc_id", "page_number", "word_count", F.round("confidence", 6).alias("confidence"), "code")


def ocr_positioned_text(spark, sf_dir):
    return O.page_layouts(_tsv(spark, sf_dir))


def ocr_page_ranges(spark, sf_dir):
    s = spark.createDataFrame([("all",), ("1-3,5",), ("2",), ("0",), ("4-2",), ("1, 2",), ("9",), ("a",), ("3,1-2,2",)], "spec string")
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return s.select("spec", listed(O.page_list(F.col("spec"), F.lit(6))).alias("pages"), listed(O.page_range(F.col("spec"))).alias("one_range"))


QUERIES = {f.__name__: f for f in (line_group_anchored, line_extents, heading_levels_typographic, paragraph_gap_breaks, gutter_split, two_column_order, table_region_semijoin, bullet_nearest_line, page_extraction, caption_segments, table_normalize, table_reject, table_merge_adjacent, image_filter, figure_candidates, figure_numbering, figure_crop, ocr_tsv_parse, ocr_confidence, ocr_positioned_text, ocr_page_ranges)}

#: Lines of the synthetic words are 12 units apart at least, so here a line is its row.
_WORDS = r"""WITH w0 AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS t, generate_subscripts(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> ''), 1) - 1 AS i FROM documents
), w AS (
  SELECT doc_id, CAST(i // 8 // 50 + 1 AS INTEGER) AS page_number, CAST(i // 8 % 50 AS INTEGER) AS line_idx, CAST(i AS INTEGER) AS word_idx, t AS text,
    (i % 8) * 30.0::DOUBLE + CASE WHEN i // 8 % 50 % 3 <> 2 AND i % 8 >= 4 THEN 320 WHEN i // 8 % 50 % 3 = 2 THEN (i % 8) * 30 ELSE 0 END AS x0,
    i // 8 % 50 * 12.0::DOUBLE + i // 8 % 50 // 5 * 16.0::DOUBLE + (i % 2) * 0.3::DOUBLE + 60 AS top, CASE i // 8 % 50 WHEN 0 THEN 18.0 WHEN 20 THEN 13.5 ELSE 10.0 END AS font_size FROM w0
), l AS (
  SELECT doc_id, page_number, line_idx, string_agg(text, ' ' ORDER BY x0, word_idx) AS text, min(x0) AS x0, max(x0 + 24) AS x1, min(top) AS top, max(top + 10) AS bottom, max(font_size)::DOUBLE AS font_size FROM w GROUP BY ALL
)"""

_TABLES = r"""WITH g AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS page_number, min(l_returnflag) AS f, min(l_partkey) AS p FROM lineitem GROUP BY ALL
), t AS (
  SELECT doc_id, page_number, CASE WHEN doc_id % 3 = 0 THEN 'part<br>no ' || (page_number % 2) ELSE 'part' END AS h, f, 'p ' || p || '<br>x' AS c, (doc_id + page_number) % 5 <> 0 AS accepted FROM g
)"""

_TSV = r"""WITH r AS (
  SELECT doc_id, text, n % 60 AS i, CAST(n // 60 + 1 AS INTEGER) AS page_number FROM (SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS n FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\s+') AS w FROM documents))
), p AS (
  SELECT doc_id, page_number, CAST(i + 1 AS INTEGER) AS word_idx, text, CAST(i % 10 * 50 AS INTEGER) AS left, CAST(i // 10 AS INTEGER) AS top, CAST(len(text) * 5 AS INTEGER) AS width, 10 AS height, (doc_id % 40 + 60 + i % 3)::DOUBLE AS conf
  FROM r WHERE i % 9 <> 8 AND i % 13 <> 12 AND i % 7 <> 6 AND text <> ''
)"""

ORACLES = {
    "line_group_anchored": _WORDS + " SELECT doc_id, page_number, line_idx, word_idx FROM w",
    "line_extents": _WORDS + " SELECT * FROM l",
    "heading_levels_typographic": _WORDS + """, b AS (SELECT *, median(font_size) OVER (PARTITION BY doc_id, page_number) AS body FROM l)
SELECT doc_id, page_number, line_idx, text, CAST(least(6, dense_rank() OVER (PARTITION BY doc_id, page_number ORDER BY font_size DESC)) AS INTEGER) AS level FROM b WHERE font_size >= body * 1.2 AND len(text) <= 160 AND NOT contains(text, '=')""",
    "paragraph_gap_breaks": _WORDS + """, g AS (SELECT *, top - lag(bottom) OVER p AS gap, 1.5 * median(bottom - top) OVER (PARTITION BY doc_id, page_number) AS lim FROM l WINDOW p AS (PARTITION BY doc_id, page_number ORDER BY line_idx))
SELECT doc_id, page_number, line_idx FROM g WHERE gap > lim""",
    "gutter_split": _WORDS + " SELECT doc_id, page_number, line_idx, sum(CASE WHEN line_idx % 3 <> 2 AND word_idx % 8 >= 4 THEN 1 ELSE 0 END) AS right_words FROM w GROUP BY ALL",
    "table_region_semijoin": _WORDS + " SELECT doc_id, page_number, line_idx FROM l WHERE (x0 + x1) / 2 BETWEEN 0 AND 600 AND (top + bottom) / 2 BETWEEN 200 AND 260",
    "bullet_nearest_line": _WORDS + """, s AS (SELECT i, i * 37.0::DOUBLE + 64 AS y FROM range(10) t(i) WHERE i % 4 <> 3), p AS (
  SELECT doc_id, page_number, line_idx, i, abs(y - (top + bottom) / 2) AS far FROM l, s WHERE x0 >= -5 AND abs(y - (top + bottom) / 2) <= greatest(4, (bottom - top) * 0.6)
), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, i ORDER BY far, line_idx) AS k FROM p) SELECT DISTINCT doc_id, page_number, line_idx FROM best WHERE k = 1""",
    "caption_segments": _WORDS + """, c AS (SELECT *, CASE WHEN x0 - lag(x0 + 24) OVER p > 12 THEN 1 ELSE 0 END AS cut FROM w WINDOW p AS (PARTITION BY doc_id, page_number, line_idx ORDER BY x0, word_idx)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page_number, line_idx ORDER BY x0, word_idx) AS segment FROM c)
SELECT doc_id, page_number, line_idx, segment, string_agg(text, ' ' ORDER BY x0, word_idx) AS text, min(x0) AS x0, max(x0 + 24) AS x1 FROM s GROUP BY ALL""",
    "table_normalize": _TABLES + " SELECT doc_id, page_number, accepted, CASE WHEN accepted THEN 'flag|' || h || '|' || f || '|' || c END AS cells FROM t",
    "table_reject": _TABLES + " SELECT doc_id, page_number, count(*) AS n, 'UNSUPPORTED_TABLE_STRUCTURE' AS code FROM t WHERE NOT accepted GROUP BY ALL",
    "table_merge_adjacent": _TABLES + """, a AS (SELECT *, CASE WHEN lag(page_number) OVER p = page_number - 1 AND lag(h) OVER p = h THEN 0 ELSE 1 END AS new FROM t WHERE accepted WINDOW p AS (PARTITION BY doc_id ORDER BY page_number)),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page_number) AS k FROM a)
SELECT doc_id, printf('page-%03d-table-01', min(page_number)) AS table_id, min(page_number) AS page_number, CAST(count(*) AS INTEGER) AS n_rows,
  '| flag | ' || min(h) || ' |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || f || ' | ' || c || ' |', chr(10) ORDER BY page_number) AS markdown FROM b GROUP BY doc_id, k""",
    "image_filter": """WITH k AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 5 * 100 + 40 END AS w FROM part)
SELECT k // 4 AS doc_id, k % 4 AS image_idx, CASE WHEN w * 300 < 50000 THEN 'decorative' WHEN k % 3 = 0 THEN 'jpg' WHEN k % 5 = 2 AND w * 300 = 72000 THEN 'png' ELSE 'unsupported' END AS kind,
  printf('page-001-figure-%02d', row_number() OVER (PARTITION BY k // 4 ORDER BY k % 4)) AS asset_id FROM k""",
    "ocr_tsv_parse": _TSV + " SELECT * FROM p",
    "ocr_confidence": _TSV + " SELECT d.doc_id, d.page_number, count(p.conf) AS word_count, round(avg(conf), 6) AS confidence, CASE WHEN avg(conf) < 70 THEN 'OCR_LOW_CONFIDENCE' END AS code FROM (SELECT DISTINCT doc_id, page_number FROM r) d LEFT JOIN p USING (doc_id, page_number) GROUP BY ALL",
    "ocr_page_ranges": "SELECT * FROM (VALUES ('all', '1,2,3,4,5,6', NULL), ('1-3,5', '1,2,3,5', NULL), ('2', '2', '2'), ('0', NULL, NULL), ('4-2', NULL, NULL), ('1, 2', '1,2', NULL), ('9', NULL, '9'), ('a', NULL, NULL), ('3,1-2,2', '1,2,3', NULL)) AS v(spec, pages, one_range)",
}
