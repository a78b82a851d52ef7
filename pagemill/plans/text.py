"""Queries over page text, findings, references and derivatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import blocks as B
from pagemill.operators import contract as C
from pagemill.operators import derivatives as D
from pagemill.operators import extract as E
from pagemill.operators import findings as W
from pagemill.operators import lifecycle as L
from pagemill.operators import links as K
from pagemill.operators import references as R
from pagemill.plans.inputs import CLASSIFIED, INJECTED, injected, table


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.build_blocks(B.classify(injected(spark, sf_dir)))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir).select("doc_id", "page_number").distinct()


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.render_document(_pages(spark, sf_dir), _blocks(spark, sf_dir)).select("doc_id", "markdown")


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, code, severity of all text findings."""
    rendered = W.render_formulas(W.normalize(_blocks(spark, sf_dir)))
    codes = rendered.select("doc_id", "page_number", F.explode(F.concat("codes", F.filter(F.array("code"), lambda c: c.isNotNull()))).alias("code"))
    pages = injected(spark, sf_dir).groupBy("doc_id", "page_number").agg(F.concat_ws("\n", F.collect_list("line")).alias("text")).withColumn("column_count", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1)).withColumn("formula_candidates", F.when(F.col("doc_id") % 31 == 0, 1).otherwise(0))
    return codes.unionByName(W.extractability(pages)).withColumn("severity", F.when(F.col("code") == "SOFT_HYPHEN_PRESERVED", "info").otherwise("warning"))


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second derivative: some pages thinner, some with a table or formula."""
    pages = D.split_pages(_markdown(spark, sf_dir))
    k = F.col("doc_id") + F.col("page_number")
    thin = F.when(k % 5 == 0, "short").when(k % 7 == 0, F.concat("content", F.lit("\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"))).when(k % 11 == 0, F.concat("content", F.lit("\n\nso $x = 1$ holds\n![gone](a b)\n![kept](a) words\n"))).otherwise(F.col("content"))
    return pages.select("doc_id", "page_number", thin.alias("content"))


def line_explode(spark, sf_dir):
    return B.lines_of(table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text"))


def line_classify(spark, sf_dir):
    return B.classify(injected(spark, sf_dir)).select("doc_id", "page_number", "line_idx", "kind", "heading_level", "ordered", "content")


def block_build(spark, sf_dir):
    return _blocks(spark, sf_dir)


def ordered_numbering(spark, sf_dir):
    return B.number_list_items(_blocks(spark, sf_dir)).where("number is not null").select("doc_id", "page_number", "block_idx", "number")


def list_continuation(spark, sf_dir):
    return B.list_continuations(_blocks(spark, sf_dir))


def page_marker_render(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), F.coalesce("text", F.lit("")).alias("markdown"))
    return B.render_pages(c).select("doc_id", F.sha2("markdown", 256).alias("sha256"), F.regexp_count("markdown", F.lit(D.PAGE)).alias("markers"))


def document_markdown(spark, sf_dir):
    return _markdown(spark, sf_dir).select("doc_id", F.sha2("markdown", 256).alias("sha256"), F.length("markdown").alias("n"))


def normalize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.replace("text", F.lit("\u00e9"), F.lit("e\u0301")), F.when(F.col("doc_id") % 3 == 0, "\r\nx\ry").otherwise("")).alias("text"))
    return W.normalize(d).select("doc_id", F.sha2("normalized", 256).alias("sha256"), F.array_join("transformations", ",").alias("transformations"), F.array_join("codes", ",").alias("codes"))


def formula_render(spark, sf_dir):
    return W.render_formulas(_blocks(spark, sf_dir)).where("rendered <> text or code is not null").select("doc_id", "page_number", "block_idx", "rendered", "code")


def document_references(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    ids = table(spark, sf_dir, "documents").select("doc_id")
    one = lambda kind, ord_: ids.select("doc_id", F.lit(kind).alias("kind"), F.lit(ord_).alias("ord"), F.concat(F.lit(f"{kind}-"), F.lit(ord_).cast("string")).alias("id"), F.lit(ord_ + 1).alias("page_number"))
    return R.references(b, one("figure", 0).unionByName(one("figure", 1)).unionByName(one("table", 0)))


def warning_counts(spark, sf_dir):
    return W.counts_by_code(_warnings(spark, sf_dir)).select("doc_id", "code", "n", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def quality_section(spark, sf_dir):
    return W.quality(_warnings(spark, sf_dir))


def readiness_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "cloud").otherwise("local").alias("selected"))
    return W.readiness(d, _warnings(spark, sf_dir)).select("doc_id", "status", "next_step", F.array_join("reasons", ",").alias("reasons"), F.array_join("steps", ",").alias("steps"))


def vision_page_plan(spark, sf_dir):
    return W.vision_pages(_warnings(spark, sf_dir), _pages(spark, sf_dir), "auto")


def review_table(spark, sf_dir):
    return L.review_table(_warnings(spark, sf_dir))


def structure_score(spark, sf_dir):
    return D.structure_score(_markdown(spark, sf_dir)).drop("markdown")


def derivative_choice(spark, sf_dir):
    cloud = B.render_pages(_cloud(spark, sf_dir).where("doc_id % 9 <> 0"), "content")
    return D.choose(_markdown(spark, sf_dir), cloud)


def page_split(spark, sf_dir):
    return D.split_pages(_markdown(spark, sf_dir)).select("doc_id", "page_number", F.sha2("content", 256).alias("sha256"))


def completeness_check(spark, sf_dir):
    local = D.split_pages(_markdown(spark, sf_dir))
    return D.completeness(local, _cloud(spark, sf_dir).where("doc_id % 13 <> 0 or page_number <> 1"))


def marker_validation(spark, sf_dir):
    k, m = F.col("doc_id"), F.col("markdown")
    broken = F.when(k % 7 == 0, "").when(k % 7 == 1, F.concat(m, F.lit("<script>"))).when(k % 7 == 2, F.concat(F.lit("intro\n"), m)).when(k % 7 == 3, F.concat(m, F.lit(" <!-- srcmap:page=99 -->"))).when(k % 7 == 4, F.replace(m, F.lit("page=1 -->"), F.lit("page=1 --> x"))).otherwise(m)
    pages = _pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page_number").alias("n"))
    rows = _markdown(spark, sf_dir).join(pages, "doc_id").withColumn("markdown", broken)
    return rows.select("doc_id", D.marker_code(F.col("markdown"), F.lit(1), F.col("n")).alias("code"))


def batch_plan(spark, sf_dir):
    return D.plan_batches(D.batch_profiles(_cloud(spark, sf_dir)))


def provenance_add_strip(spark, sf_dir):
    m = _markdown(spark, sf_dir)
    named = F.concat(F.lit('a "quoted" name '), F.col("doc_id").cast("string"), F.lit(".pdf"))
    once = D.add_provenance(F.col("markdown"), named, F.sha2("markdown", 256), F.lit("local"))
    twice = D.add_provenance(F.col("once"), named, F.sha2("markdown", 256), F.lit("local"))
    return m.withColumn("once", once).select("doc_id", F.sha2("once", 256).alias("sha256"), (twice == F.col("once")).alias("idempotent"), (D.strip_provenance(F.col("once")) == F.col("markdown")).alias("reversible"))


def run_status(spark, sf_dir):
    return C.run_status(table(spark, sf_dir, "documents"), _warnings(spark, sf_dir))


def document_full_markdown(spark, sf_dir):
    """Whole documents: OCR layouts, list continuations, link lists, figures and tables; some with content of a page they haven't."""
    k = F.col("doc_id") + F.col("page_number")
    key = ["doc_id", "page_number"]
    pages = _pages(spark, sf_dir).withColumn("layout_html", F.when(k % 9 == 0, F.concat(F.lit("<pre>"), "doc_id", F.lit("</pre>"))))
    links = pages.where(k % 3 == 0).select(*key, F.explode(F.sequence(F.lit(1), F.lit(2))).alias("link_idx")).withColumn("uri", F.concat(F.lit("https://h/("), "link_idx", F.lit(")"))).withColumn("visible_title", F.when(F.col("link_idx") == 2, "[b]"))
    lists = K.render_links(links).select(*key, F.lit(0).alias("rank"), F.lit(0).alias("ord"), F.col("markdown").alias("text"))
    figure = E.asset_markdown(F.concat(F.lit("f"), "page_number"), F.col("page_number"), F.lit("assets/f.png"), F.when(F.col("doc_id") % 2 == 0, "Figure 1"), F.when(F.col("doc_id") % 3 == 0, F.lit("f.md")))
    figures = pages.where(k % 5 == 0).select(*key, F.lit(1).alias("rank"), F.lit(0).alias("ord"), figure.alias("text"))
    tables = pages.where(k % 4 == 0).select(*key, F.lit(2).alias("rank"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("ord"), F.lit("| a | b |\n| --- | --- |").alias("text"))
    stray = pages.where("doc_id % 50 = 0 and page_number = 1").select("doc_id", F.lit(999).alias("page_number"), F.lit(2).alias("rank"), F.lit(1).alias("ord"), F.lit("x").alias("text"))
    parts = lists.unionByName(figures).unionByName(tables).unionByName(stray)
    return B.render_document(pages, _blocks(spark, sf_dir), parts).select("doc_id", F.sha2("markdown", 256).alias("sha256"), "code")


QUERIES = {f.__name__: f for f in (run_status, document_full_markdown, line_explode, line_classify, block_build, ordered_numbering, list_continuation, page_marker_render, document_markdown, normalize_text, formula_render, document_references, warning_counts, quality_section, readiness_status, vision_page_plan, review_table, structure_score, derivative_choice, page_split, completeness_check, marker_validation, batch_plan, provenance_add_strip)}

_BLOCKS = "WITH " + CLASSIFIED

#: Reads blocks one after another: a page's first paragraph goes on with an item if the last other block is one.
_BODIES = """, may AS (
  SELECT *, kind = 'paragraph' AND block_idx = min(block_idx) OVER (PARTITION BY doc_id, page_number) AS may FROM {blocks}
), cont AS (
  SELECT *, may AND coalesce(last_value(CASE WHEN NOT may THEN kind = 'list_item' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS continues FROM may
), run AS (
  SELECT *, sum(CASE WHEN continues OR (kind = 'list_item' AND ordered) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_number, block_idx) AS run FROM cont
), numbered AS (
  SELECT *, CASE WHEN kind = 'list_item' AND ordered THEN row_number() OVER (PARTITION BY doc_id, run, kind = 'list_item' AND ordered ORDER BY page_number, block_idx) END AS number FROM run
)"""

_NUMBERED = _BLOCKS + _BODIES.format(blocks="blocks")

_PIECES = """, pieces AS (
  SELECT *, CASE WHEN lag(kind) OVER p IS NULL THEN '' WHEN lag(continues) OVER p OR kind = 'list_item' AND lag(kind) OVER p = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END
    || CASE WHEN continues THEN '  <!-- srcmap:page=' || page_number || ' -->' || chr(10) || '  ' || text WHEN kind = 'heading' THEN repeat('#', heading_level) || ' ' || text WHEN kind = 'list_item' THEN coalesce(number || '. ', '- ') || text ELSE text END AS piece
  FROM numbered WINDOW p AS (PARTITION BY doc_id, page_number ORDER BY block_idx)
), bodies AS (
  SELECT doc_id, page_number, string_agg(piece, '' ORDER BY block_idx) AS body, bool_or(continues) AS continues FROM pieces GROUP BY ALL
)"""

_MARKDOWN = _NUMBERED + _PIECES + """, mpages AS (
  SELECT doc_id, page_number, coalesce(continues, false) AS continues,
    CASE WHEN continues THEN body ELSE '<!-- srcmap:page=' || page_number || ' -->' || coalesce(chr(10) || body, '') END AS page
  FROM (SELECT DISTINCT doc_id, page_number FROM inj) LEFT JOIN bodies USING (doc_id, page_number)
), mdocs AS (
  SELECT doc_id, string_agg(CASE WHEN page_number = 1 THEN '' WHEN continues THEN chr(10) ELSE chr(10) || chr(10) END || page, '' ORDER BY page_number) AS markdown FROM mpages GROUP BY doc_id
)"""

#: Page contents as they lie between markers.
_CONTENTS = _MARKDOWN + """, contents AS (
  SELECT doc_id, unnest(list_transform(regexp_extract_all(markdown, '<!-- srcmap:page=([0-9]+) -->', 1), lambda x: CAST(x AS INTEGER))) AS page_number, unnest(string_split_regex(markdown, '<!-- srcmap:page=[0-9]+ -->')[2:]) AS content FROM mdocs
), cloud AS (
  SELECT doc_id, page_number, CASE WHEN (doc_id + page_number) % 5 = 0 THEN 'short'
    WHEN (doc_id + page_number) % 7 = 0 THEN content || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10)
    WHEN (doc_id + page_number) % 11 = 0 THEN content || chr(10) || chr(10) || 'so $x = 1$ holds' || chr(10) || '![gone](a b)' || chr(10) || '![kept](a) words' || chr(10) ELSE content END AS content FROM contents
)"""

_SUM = r"^([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)?\([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)?\))\s*=\s*sum_([A-Za-z0-9]+)\s+([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)?(?:\s*\*\s*[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)?)*)\s*/\s*([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)?)$"
_CANDIDATE = r"^[A-Za-z][A-Za-z0-9_]*(?:\([A-Za-z0-9_]+\))?\s*=\s*[A-Za-z0-9_()\[\]{}+\-*/^.,\\\s]+$"

_FORMULAS = _BLOCKS + rf""", formulas AS (
  SELECT doc_id, page_number, block_idx, text,
    CASE WHEN kind = 'paragraph' AND regexp_matches(trim(text), '{_SUM}') THEN '$$' || regexp_extract(trim(text), '{_SUM}', 1) || ' = \frac{{\sum_' || regexp_extract(trim(text), '{_SUM}', 2) || ' '
      || trim(regexp_replace(replace(regexp_extract(trim(text), '{_SUM}', 3), '*', ' '), '\s+', ' ', 'g')) || '}}{{' || regexp_extract(trim(text), '{_SUM}', 4) || '}}$$' ELSE text END AS rendered,
    CASE WHEN kind = 'paragraph' AND NOT regexp_matches(trim(text), '{_SUM}') AND len(trim(text)) <= 160 AND regexp_matches(trim(text), '{_CANDIDATE}') THEN 'FORMULA_NOT_RECONSTRUCTED' END AS code
  FROM blocks
)"""

_WARNINGS = _FORMULAS + r""", found AS (
  SELECT doc_id, page_number, 'TEXT_REPLACEMENT_CHARACTER' AS code FROM blocks WHERE contains(text, chr(65533))
  UNION ALL SELECT doc_id, page_number, 'SOFT_HYPHEN_PRESERVED' FROM blocks WHERE contains(text, chr(173))
  UNION ALL SELECT doc_id, page_number, 'POSSIBLE_HYPHENATION_PRESERVED' FROM blocks WHERE regexp_matches(text, '[\p{L}\p{M}\p{N}_]-\s+[\p{L}\p{M}\p{N}_]')
  UNION ALL SELECT doc_id, page_number, code FROM formulas WHERE code IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, page_number, 'UNREADABLE_PDF_GLYPHS' FROM inj WHERE contains(line, '(cid:')
  UNION ALL SELECT DISTINCT doc_id, page_number, 'MULTI_COLUMN_LAYOUT' FROM inj WHERE doc_id % 5 = 0
  UNION ALL SELECT DISTINCT doc_id, page_number, 'DISPLAY_FORMULA_LAYOUT_NOT_RECONSTRUCTED' FROM inj WHERE doc_id % 31 = 0
)"""

_BLOCKERS = "('DISPLAY_FORMULA_LAYOUT_NOT_RECONSTRUCTED', 'FORMULA_NOT_RECONSTRUCTED', 'MULTI_COLUMN_LAYOUT', 'UNREADABLE_PDF_GLYPHS')"

_COUNT = "len(regexp_extract_all({}, '{}'))"
_GFM = r"(?m)^\|[^\n]*\|\r?\n\|(?:\s*:?-{3,}:?\s*\|)+\s*$"


def _score(rows: str) -> str:
    n = lambda p: _COUNT.format("markdown", p)
    return f"SELECT doc_id, {n('<!-- srcmap:page=[0-9]+ -->')} AS page_markers, {n('(?m)^#{1,6}[ ]')} AS headings, {n(_GFM)} AS tables, {n('(?m)^[$][$]')} AS formulas, {n('[(]cid:')} AS glyphs FROM {rows}"


ORACLES = {
    "run_status": _WARNINGS + " SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM found) THEN 'partial' ELSE 'success' END AS status FROM documents",
    "document_full_markdown": _BLOCKS + """, pages AS (SELECT DISTINCT doc_id, page_number, (doc_id + page_number) % 9 = 0 AS laid_out FROM inj), set_ AS (
  SELECT b.* FROM blocks b JOIN pages USING (doc_id, page_number) WHERE NOT laid_out
  UNION ALL SELECT doc_id, page_number, 0, 'layout', '<pre>' || doc_id || '</pre>', NULL, NULL FROM pages WHERE laid_out
)""" + _BODIES.format(blocks="set_") + _PIECES + """, whole AS (
  SELECT doc_id, page_number, coalesce(continues, false) AS continues, array_to_string(list_filter([body,
    CASE WHEN (doc_id + page_number) % 3 = 0 THEN '<!-- srcmap:native-pdf-links page=' || page_number || ' -->' || chr(10) || '**Native PDF links**' || chr(10) || '- [Link](<https://h/(1)>)' || chr(10) || '- [\\[b\\]](<https://h/(2)>)' END,
    CASE WHEN (doc_id + page_number) % 5 = 0 THEN '<!-- srcmap:asset=f' || page_number || ' page=' || page_number || ' -->' || chr(10) || '![' || CASE WHEN doc_id % 2 = 0 THEN 'Figure 1' ELSE 'Figure f' || page_number END || '](assets/f.png)' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '[Edit description](f.md)' ELSE '' END END,
    CASE WHEN (doc_id + page_number) % 4 = 0 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS text
  FROM pages LEFT JOIN bodies USING (doc_id, page_number)
), joined AS (
  SELECT doc_id, string_agg(CASE WHEN page_number = 1 THEN '' WHEN continues THEN chr(10) ELSE chr(10) || chr(10) END || CASE WHEN continues THEN '' ELSE '<!-- srcmap:page=' || page_number || ' -->' || CASE WHEN text = '' THEN '' ELSE chr(10) END END || text, '' ORDER BY page_number) AS markdown FROM whole GROUP BY doc_id
) SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN sha256(markdown) END AS sha256, CASE WHEN doc_id % 50 = 0 THEN 'CONTENT_WITHOUT_PAGE' END AS code FROM joined""".replace("\\\\", "\\"),
    "line_explode": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM s)
SELECT doc_id, 1 AS page_number, generate_subscripts(l, 1) - 1 AS line_idx, unnest(l) AS line FROM c""",
    "line_classify": _BLOCKS + " SELECT doc_id, page_number, line_idx, kind, CAST(CASE WHEN kind = 'heading' THEN heading_level END AS INTEGER) AS heading_level, CASE WHEN kind = 'list_item' THEN ord_ END AS ordered, content FROM cls",
    "block_build": _BLOCKS + " SELECT * FROM blocks",
    "ordered_numbering": _NUMBERED + " SELECT doc_id, page_number, block_idx, number FROM numbered WHERE number IS NOT NULL",
    "list_continuation": _NUMBERED + " SELECT doc_id, page_number, bool_or(continues) AS continues FROM numbered GROUP BY ALL",
    "page_marker_render": "SELECT conv_id AS doc_id, sha256(string_agg('<!-- srcmap:page=' || (turn + 1) || ' -->' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS sha256, count(*) AS markers FROM conversations GROUP BY conv_id",
    "document_markdown": _MARKDOWN + " SELECT doc_id, sha256(markdown) AS sha256, len(markdown) AS n FROM mdocs",
    "normalize_text": r"""WITH t AS (SELECT doc_id, replace(text, 'é', 'e' || chr(769)) || CASE WHEN doc_id % 3 = 0 THEN chr(13) || chr(10) || 'x' || chr(13) || 'y' ELSE '' END AS raw FROM documents),
lf AS (SELECT doc_id, raw, replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS lf FROM t), n AS (SELECT *, nfc_normalize(lf) AS nfc FROM lf)
SELECT doc_id, sha256(nfc) AS sha256, concat_ws(',', CASE WHEN contains(raw, chr(13)) THEN 'line_endings_to_lf' END, CASE WHEN nfc <> lf THEN 'unicode_nfc' END) AS transformations,
  concat_ws(',', CASE WHEN contains(nfc, chr(65533)) THEN 'TEXT_REPLACEMENT_CHARACTER' END, CASE WHEN contains(nfc, chr(173)) THEN 'SOFT_HYPHEN_PRESERVED' END, CASE WHEN regexp_matches(nfc, '[\p{L}\p{M}\p{N}_]-\s+[\p{L}\p{M}\p{N}_]') THEN 'POSSIBLE_HYPHENATION_PRESERVED' END) AS codes FROM n""",
    "formula_render": _FORMULAS + " SELECT doc_id, page_number, block_idx, rendered, code FROM formulas WHERE rendered <> text OR code IS NOT NULL",
    "document_references": _BLOCKS + r""", m AS (
  SELECT doc_id, page_number, block_idx, 'citation' AS kind, unnest(string_split(array_to_string(regexp_extract_all(text, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), ','), ',')) AS v FROM blocks WHERE NOT regexp_matches(text, '^\[\d+\]\s+.+') AND regexp_matches(text, '\[\d+(?:\s*,\s*\d+)*\]')
  UNION ALL SELECT doc_id, page_number, block_idx, 'footnote', unnest(regexp_extract_all(text, '\[\^(\d+)\]', 1)) FROM blocks WHERE NOT regexp_matches(text, '^\[\^\d+\]:\s+.+')
  UNION ALL SELECT doc_id, page_number, block_idx, 'figure', unnest(regexp_extract_all(text, '(?i)\b(?:Figure|Fig\.)\s+(\d+)\b', 1)) FROM blocks
  UNION ALL SELECT doc_id, page_number, block_idx, 'table', unnest(regexp_extract_all(text, '(?i)\bTable\s+(\d+)\b', 1)) FROM blocks
), defs AS (
  SELECT doc_id, 'citation' AS kind, CAST(regexp_extract(text, '^\[(\d+)\]', 1) AS BIGINT) AS n, arg_min(page_number, page_number * 1000000 + block_idx) AS target_page, NULL AS target_id FROM blocks WHERE regexp_matches(text, '^\[\d+\]\s+.+') GROUP BY ALL
  UNION ALL SELECT doc_id, 'footnote', CAST(regexp_extract(text, '^\[\^(\d+)\]', 1) AS BIGINT), arg_min(page_number, page_number * 1000000 + block_idx), NULL FROM blocks WHERE regexp_matches(text, '^\[\^\d+\]:\s+.+') GROUP BY ALL
  UNION ALL SELECT doc_id, kind, n, p, id FROM documents, (VALUES ('figure', 1, 1, 'figure-0'), ('figure', 2, 2, 'figure-1'), ('table', 1, 1, 'table-0')) AS v(kind, n, p, id)
) SELECT m.doc_id, page_number, block_idx, m.kind, CAST(CAST(trim(v) AS BIGINT) AS VARCHAR) AS label, target_page, target_id, target_page IS NOT NULL AS resolved
FROM m LEFT JOIN defs ON m.doc_id = defs.doc_id AND m.kind = defs.kind AND CAST(trim(v) AS BIGINT) = defs.n""",
    "warning_counts": _WARNINGS + " SELECT doc_id, code, count(*) AS n, array_to_string(list_sort(list_distinct(list(page_number))), ',') AS pages FROM found GROUP BY doc_id, code",
    "quality_section": _WARNINGS + " SELECT doc_id, CASE WHEN bool_or(code <> 'SOFT_HYPHEN_PRESERVED') THEN 'warning' ELSE 'ok' END AS status, count(*) AS warnings, CAST(0 AS BIGINT) AS errors FROM found GROUP BY doc_id",
    "readiness_status": _WARNINGS + f""", r AS (SELECT doc_id, list_sort(list_distinct(list(code))) AS codes FROM found WHERE code IN {_BLOCKERS} GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN codes IS NULL THEN 'ready' WHEN d.doc_id % 4 = 0 THEN 'review_required' ELSE 'local_not_suitable' END AS status,
  CASE WHEN codes IS NULL THEN 'none' WHEN d.doc_id % 4 = 0 THEN 'review_recommended_derivative' ELSE 'cloud_document' END AS next_step, coalesce(array_to_string(codes, ','), '') AS reasons,
  CASE WHEN codes IS NULL THEN '' WHEN d.doc_id % 4 = 0 THEN 'review_recommended_derivative' WHEN list_contains(codes, 'UNREADABLE_PDF_GLYPHS') THEN 'force_ocr,cloud_document' ELSE 'cloud_document' END AS steps
FROM documents d LEFT JOIN r USING (doc_id)""",
    "vision_page_plan": _WARNINGS + " SELECT DISTINCT doc_id, page_number FROM found WHERE code IN ('FORMULA_NOT_RECONSTRUCTED', 'MULTI_COLUMN_LAYOUT', 'POSSIBLE_HYPHENATION_PRESERVED', 'UNREADABLE_PDF_GLYPHS')",
    "review_table": _WARNINGS + " SELECT doc_id, code, '| | ' || code || ' | ' || count(*) || ' | ' || array_to_string(list_sort(list_distinct(list(page_number))), ', ') || ' | |' AS line FROM found GROUP BY doc_id, code",
    "structure_score": _MARKDOWN + f", s AS ({_score('mdocs')}) SELECT *, headings + 3 * tables + 2 * formulas - glyphs AS structure_score FROM s",
    "derivative_choice": _CONTENTS + f""", cdocs AS (
  SELECT doc_id, string_agg('<!-- srcmap:page=' || page_number || ' -->' || chr(10) || content, chr(10) || chr(10) ORDER BY page_number) AS markdown FROM cloud WHERE doc_id % 9 <> 0 GROUP BY doc_id
), a AS ({_score('mdocs')}), b AS ({_score('cdocs')}), j AS (
  SELECT a.doc_id, a.headings + 3 * a.tables + 2 * a.formulas - a.glyphs AS local_score, b.headings + 3 * b.tables + 2 * b.formulas - b.glyphs AS cloud_score FROM a LEFT JOIN b USING (doc_id)
) SELECT *, CASE WHEN cloud_score > local_score THEN 'cloud' ELSE 'local' END AS selected,
  CASE WHEN cloud_score IS NULL THEN 'cloud_derivative_not_available' WHEN cloud_score > local_score THEN 'validated_cloud_has_more_structure' ELSE 'local_structure_is_equal_or_better' END AS reason FROM j""",
    "page_split": _CONTENTS + " SELECT doc_id, page_number, sha256(content) AS sha256 FROM contents",
    "completeness_check": _CONTENTS + r""", kept AS (
  SELECT side, doc_id, page_number, list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '^\s{0,3}#{1,6}\s|^\s*>|^\s*!\[[^\]]*\]\([^\n]*\)\s*$')) AS l
  FROM (SELECT 'l' AS side, * FROM contents UNION ALL SELECT 'c', * FROM cloud WHERE doc_id % 13 <> 0 OR page_number <> 1)
), p AS (
  SELECT side, doc_id, page_number, len(regexp_extract_all(b, '[\p{L}\p{M}\p{N}]+')) AS n, t,
    contains(b, '$$') OR len(replace(b, '\$', '')) - len(replace(replace(b, '\$', ''), '$', '')) > 1 AS f
  FROM (SELECT *, array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*$')), chr(10)) AS b, len(list_filter(l, lambda x: regexp_matches(x, '^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*$'))) > 0 AS t FROM kept)
), j AS (
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page_number, b.page_number) AS page_number, a.n AS ln, a.t AS lt, a.f AS lf, b.n AS cn, b.t AS ct, b.f AS cf
  FROM (SELECT * FROM p WHERE side = 'l') a FULL JOIN (SELECT * FROM p WHERE side = 'c') b ON a.doc_id = b.doc_id AND a.page_number = b.page_number
) SELECT doc_id, page_number, 'page_list_differs' AS problem FROM j WHERE ln IS NULL OR cn IS NULL
UNION ALL SELECT doc_id, page_number, 'too_few_words' FROM j WHERE ln > 0 AND cn < least(ln, greatest(1, ceil(ln / 5.0)))
UNION ALL SELECT doc_id, page_number, 'table_missing' FROM j WHERE lt AND NOT ct UNION ALL SELECT doc_id, page_number, 'formula_missing' FROM j WHERE lf AND NOT cf""",
    "marker_validation": _MARKDOWN + """ SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'CLOUD_MARKDOWN_EMPTY' WHEN 1 THEN 'CLOUD_MARKDOWN_FORBIDDEN_OUTPUT' WHEN 2 THEN 'CLOUD_MARKDOWN_FIRST_PAGE' WHEN 3 THEN 'CLOUD_MARKDOWN_PAGE_COUNT' WHEN 4 THEN 'CLOUD_MARKDOWN_FIRST_PAGE' END AS code FROM mdocs""",
    "provenance_add_strip": _MARKDOWN + """ SELECT doc_id, sha256('---' || chr(10) || 'srcmap_source: "a \\"quoted\\" name ' || doc_id || '.pdf"' || chr(10) || 'srcmap_sha256: ' || sha256(markdown) || chr(10) || 'srcmap_kind: local' || chr(10) || '---' || chr(10) || chr(10) || markdown) AS sha256, true AS idempotent, true AS reversible FROM mdocs""",
}
