"""Warnings, quality section, readiness and the next step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import constants as C
from pagemill.functions import text as X


def normalize(blocks: DataFrame) -> DataFrame:
    """Adds normalized, transformations and codes to blocks(text, ...).

    Only texts that composition may change are sent to Python, null for all others.
    """
    rows = blocks.withColumn("_lf", X.line_endings(F.col("text")))
    out = rows.withColumn("normalized", F.coalesce(X.nfc(F.when(X.needs_nfc(F.col("_lf")), F.col("_lf"))), F.col("_lf")))
    steps = F.filter(F.array(F.when(F.contains("text", F.lit("\r")), "line_endings_to_lf"), F.when(F.col("normalized") != F.col("_lf"), "unicode_nfc")), lambda x: x.isNotNull())
    return out.withColumn("transformations", steps).withColumn("codes", text_codes(F.col("normalized"))).drop("_lf")


def text_codes(text: Column) -> Column:
    return F.filter(F.array(F.when(F.contains(text, F.lit("�")), "TEXT_REPLACEMENT_CHARACTER"), F.when(F.contains(text, F.lit("­")), "SOFT_HYPHEN_PRESERVED"), F.when(text.rlike(C.POSSIBLE_HYPHENATION), "POSSIBLE_HYPHENATION_PRESERVED")), lambda x: x.isNotNull())


def render_formulas(blocks: DataFrame) -> DataFrame:
    """Paragraphs that are a known formula become display LaTeX; others that look like one are marked."""
    latex = X.display_formula(F.col("text"))
    para = F.col("kind") == "paragraph"
    return blocks.withColumn("rendered", F.when(para & latex.isNotNull(), F.concat(F.lit("$$"), latex, F.lit("$$"))).otherwise(F.col("text"))).withColumn("code", F.when(para & latex.isNull() & X.is_formula_candidate(F.col("text")), "FORMULA_NOT_RECONSTRUCTED"))


def extractability(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, code for pages(text, column_count, formula_candidates)."""
    codes = F.array(F.when(F.col("column_count") > 1, "MULTI_COLUMN_LAYOUT"), F.when(F.contains("text", F.lit("(cid:")), "UNREADABLE_PDF_GLYPHS"), F.when(F.col("formula_candidates") > 0, "DISPLAY_FORMULA_LAYOUT_NOT_RECONSTRUCTED"))
    return pages.select("doc_id", "page_number", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))


def counts_by_code(warnings: DataFrame) -> DataFrame:
    """doc_id, code, n and its pages in order."""
    return warnings.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("page_number")).alias("pages"))


def quality(warnings: DataFrame) -> DataFrame:
    """doc_id, status (the worst severity, info counting as ok), warnings and errors."""
    rank = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return warnings.groupBy("doc_id").agg(F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("error")), rank + 1).alias("status"), F.count(F.when(F.col("severity") != "error", 1)).alias("warnings"), F.count(F.when(F.col("severity") == "error", 1)).alias("errors"))


def readiness(documents: DataFrame, warnings: DataFrame) -> DataFrame:
    """doc_id, selected, reasons, status, steps, next_step for documents(doc_id, selected).

    selected: the derivative that the scores chose, local or cloud.
    """
    reasons = counts_by_code(warnings.where(F.col("code").isin(*C.BLOCKERS))).groupBy("doc_id").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    out = documents.join(reasons, "doc_id", "left").withColumn("reasons", F.coalesce("codes", F.array().cast("array<string>"))).drop("codes")
    blocked, chosen = F.size("reasons") > 0, F.col("selected") == "cloud"
    status = F.when(~blocked, "ready").when(chosen, "review_required").otherwise("local_not_suitable")
    ocr = F.when(F.array_contains("reasons", "UNREADABLE_PDF_GLYPHS"), "force_ocr")
    steps = F.when(~blocked, F.array().cast("array<string>")).when(chosen, F.array(F.lit("review_recommended_derivative"))).otherwise(F.filter(F.array(ocr, F.lit("cloud_document")), lambda x: x.isNotNull()))
    out = out.withColumn("status", status).withColumn("steps", steps)
    return out.withColumn("next_step", next_step(F.col("status"), F.col("steps")))


def next_step(status: Column, steps: Column) -> Column:
    """The first of cloud_document, force_ocr and review that is suggested; none when ready."""
    return F.when(status == "ready", "none").when(F.array_contains(steps, "cloud_document"), "cloud_document").when(F.array_contains(steps, "force_ocr"), "force_ocr").otherwise("review_recommended_derivative")


def ocr_layout(pages: DataFrame, headings: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages with an OCR layout that have neither a heading nor a table."""
    key = ["doc_id", "page_number"]
    return pages.where(F.col("layout_html").isNotNull()).join(headings, key, "left_anti").join(tables, key, "left_anti").select(*key, F.lit("OCR_LAYOUT_FALLBACK").alias("code"))


def vision_pages(warnings: DataFrame, pages: DataFrame, mode: str) -> DataFrame:
    """Pages for a vision model: none, all (force), or those with a risk (auto)."""
    if mode in ("none", "off"):
        return pages.where("false")
    if mode == "force":
        return pages
    return pages.join(warnings.where(F.col("code").isin(*C.VISION_RISKS)), ["doc_id", "page_number"], "left_semi")


def reader_warnings(warnings: DataFrame, glyph_pages: DataFrame) -> DataFrame:
    """Warnings that readers of a derivative see; glyph warnings only where glyphs are left."""
    shown = warnings.where(F.col("page_number").isNotNull() & F.col("severity").isin("warning", "error") & F.col("code").isin(*C.READER_CODES))
    left = glyph_pages.select("doc_id", "page_number").distinct().withColumn("_left", F.lit(True))
    return shown.join(left, ["doc_id", "page_number"], "left").where((F.col("code") != "UNREADABLE_PDF_GLYPHS") | F.col("_left")).drop("_left")
