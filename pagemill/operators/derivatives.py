"""Markdown derivatives: pages, scores, completeness, markers, batches, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import constants as C
from pagemill.functions import text as X
from pagemill.operators import lifecycle as L

PAGE = rf"<!-- {C.NAMESPACE}:page=(\d+) -->"
TABLE_MARKER = rf"<!-- {C.NAMESPACE}:table=[^\s>]+ page=\d+ -->"


def split_pages(markdown: DataFrame) -> DataFrame:
    """doc_id, page_number, content: text between page markers; what precedes the first is dropped."""
    numbers = F.regexp_extract_all("markdown", F.lit(PAGE), F.lit(1))
    parts = F.slice(F.split("markdown", PAGE), 2, F.size(numbers))
    both = markdown.select("doc_id", F.posexplode(F.arrays_zip(numbers.alias("n"), parts.alias("content"))).alias("ord", "x"))
    return both.select("doc_id", F.col("x.n").cast("int").alias("page_number"), F.col("x.content").alias("content"))


def table_count(text: Column) -> Column:
    """Markers and tables, a marker right before a table counting once."""
    paired = F.regexp_count(text, F.lit(rf"(?Um){TABLE_MARKER}\s*(?=^\|[^\n]*\|\r?\n\|(?:\s*:?-{{3,}}:?\s*\|)+\s*$)"))
    return F.regexp_count(text, F.lit(TABLE_MARKER)) + F.regexp_count(text, F.lit(C.GFM_TABLE)) - paired


def structure_score(markdown: DataFrame) -> DataFrame:
    """Adds the counts of page markers, headings, tables, formula marks, bad glyphs, and the score."""
    text = F.col("markdown")
    out = (
        markdown.withColumn("page_markers", F.regexp_count(text, F.lit(PAGE))).withColumn("headings", F.regexp_count(text, F.lit(C.MARKDOWN_HEADING))).withColumn("tables", table_count(text))
        .withColumn("formulas", F.regexp_count(text, F.lit(C.DISPLAY_FORMULA))).withColumn("glyphs", F.regexp_count(text, F.lit(C.UNREADABLE_GLYPH)))
    )
    return out.withColumn("structure_score", F.col("headings") + 3 * F.col("tables") + 2 * F.col("formulas") - F.col("glyphs"))


#: Fixed values of the choice's record.
NO_CLOUD, MORE_STRUCTURE, LOCAL_IS_ENOUGH = "cloud_derivative_not_available", "validated_cloud_has_more_structure", "local_structure_is_equal_or_better"


def choose(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """doc_id, local_score, cloud_score, selected, reason: the cloud derivative only where its score is higher."""
    a = structure_score(local).select("doc_id", F.col("structure_score").alias("local_score"))
    b = structure_score(cloud).select("doc_id", F.col("structure_score").alias("cloud_score"))
    more = F.col("cloud_score") > F.col("local_score")
    reason = F.when(F.col("cloud_score").isNull(), NO_CLOUD).when(more, MORE_STRUCTURE).otherwise(LOCAL_IS_ENOUGH)
    return a.join(b, "doc_id", "left").withColumn("selected", F.when(more, "cloud").otherwise("local")).withColumn("reason", reason)


#: A list of links as links.render_links() writes it.
LINK_LIST = rf"<!-- {C.NAMESPACE}:native-pdf-links page=[1-9][0-9]* -->(?U)\s*{C.LINKS_TITLE_PATTERN}(?:\s*\n- \[[^\n]+\]\(<[^\n]+>\))*"


def page_profiles(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, word_count, has_table, has_formula of pages(content).

    Comments, link lists, headings, callouts, table rules and lines that are an image
    are no content. A formula is between single or double dollar signs.
    """
    text = F.regexp_replace(F.regexp_replace("content", LINK_LIST, ""), r"(?s)<!--.*?-->", "")
    is_rule = lambda x: x.rlike(C.TABLE_SEPARATOR)
    skipped = lambda x: x.rlike(r"(?U)^\s{0,3}#{1,6}\s") | x.rlike(r"(?U)^\s*>") | x.rlike(r"(?Ud)^\s*!\[[^\]]*\]\([^\n]*\)\s*$")
    out = pages.withColumn("_lines", F.filter(X.split_lines(text), lambda x: ~skipped(x)))
    body = F.array_join(F.filter("_lines", lambda x: ~is_rule(x)), "\n")
    return out.select("doc_id", "page_number", F.regexp_count(body, F.lit(C.WORD)).alias("word_count"), F.exists("_lines", is_rule).alias("has_table"), body.rlike(C.ANY_FORMULA).alias("has_formula"))


def completeness(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """doc_id, page_number, problem: cloud pages that are missing, too thin, or lack a table or formula."""
    key = ["doc_id", "page_number"]
    pair = page_profiles(local).select(*key, *(F.col(c).alias(f"l_{c}") for c in ("word_count", "has_table", "has_formula"))).join(page_profiles(cloud), key, "full_outer")
    least = F.least(F.col("l_word_count"), F.greatest(F.lit(1), F.ceil(F.col("l_word_count") / 5)))
    problems = F.array(
        F.when(F.col("word_count").isNull() | F.col("l_word_count").isNull(), "page_list_differs"), F.when((F.col("l_word_count") > 0) & (F.col("word_count") < least), "too_few_words"),
        F.when(F.col("l_has_table") & ~F.col("has_table"), "table_missing"), F.when(F.col("l_has_formula") & ~F.col("has_formula"), "formula_missing"))
    return pair.select(*key, F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def marker_code(markdown: Column, first: Column, count: Column) -> Column:
    """The first rule that page markers break, or null: empty, forbidden output, count, first page, order and form."""
    numbers = F.transform(F.regexp_extract_all(markdown, F.lit(PAGE), F.lit(1)), lambda x: x.cast("int"))
    lines = F.transform(X.split_lines(markdown), X.strip)
    filled = F.filter(lines, lambda x: x != "")
    expected = F.sequence(first, first + count - 1)
    alone = F.filter(lines, lambda x: F.contains(x, F.lit(f"{C.NAMESPACE}:page=")))
    return (
        F.when(F.coalesce(X.strip(markdown), F.lit("")) == "", "CLOUD_MARKDOWN_EMPTY").when(markdown.rlike(C.FORBIDDEN_OUTPUT), "CLOUD_MARKDOWN_FORBIDDEN_OUTPUT")
        .when(F.size(numbers) != count, "CLOUD_MARKDOWN_PAGE_COUNT").when(F.get(filled, F.lit(0)) != X.page_marker(first), "CLOUD_MARKDOWN_FIRST_PAGE")
        .when((numbers != expected) | (alone != F.transform(expected, X.page_marker)), "CLOUD_MARKDOWN_PAGE_MARKERS")
    )


def response_code(response: Column, first: Column, count: Column) -> Column:
    """The first rule that a model's response (JSON) breaks, or null: its status, its text, and then marker_code()."""
    parsed = F.from_json(response, "status string, incomplete_details string")
    text = L.output_text_or_null(response)
    return (
        F.when(parsed["status"] == "incomplete", "CLOUD_RESPONSE_TRUNCATED").when(~F.coalesce(parsed["status"] == "completed", F.lit(False)), "CLOUD_RESPONSE_NOT_COMPLETED")
        .when(parsed["incomplete_details"].isNotNull(), "CLOUD_RESPONSE_INCOMPLETE").when(text.isNull(), "CLOUD_MARKDOWN_MISSING").otherwise(marker_code(text, first, count))
    )


def batch_profiles(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, chapter_start, dense for pages(content)."""
    page = F.col("page_number").cast("string")

    def chapter(line: Column) -> Column:
        title = X.strip(F.regexp_extract(line, r"(?U)^#{1,2}\s+(.+)$", 1))
        letters = F.regexp_count(title, F.lit(r"\p{L}")) >= 3
        running = F.startswith(title, F.concat(page, F.lit(" "))) | F.regexp_like(title, F.concat(F.lit(r"\b"), page, F.lit("$")))
        return line.rlike(r"(?U)^#{1,2}\s+.+$") & letters & ~F.contains(title, F.lit("(cid:")) & ~F.contains(title, F.lit(". . .")) & ~running

    text = F.col("content")
    formulas = F.floor(F.regexp_count(text, F.lit(C.FORMULA_DELIMITER)) / 2)
    tables = F.regexp_count(text, F.lit(TABLE_MARKER)) + F.regexp_count(text, F.lit(r"(?Um)^\s*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*$"))
    return pages.select("doc_id", "page_number", F.exists(X.split_lines(text), chapter).alias("chapter_start"), ((formulas >= 2) | (tables >= 1)).alias("dense"))


def plan_batches(profiles: DataFrame) -> DataFrame:
    """doc_id, batch_no, batch_id, pages, chapter_start_page, dense_pages.

    Pages in order; a batch ends before a chapter, at MAX_BATCH_PAGES pages, or before a
    second dense page. An ordered fold over a document's pages.
    """
    page = "struct<p:int,chapter:boolean,dense:boolean>"
    pages = profiles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("p"), F.col("chapter_start").alias("chapter"), "dense"))).alias("pages"))
    none = F.array().cast(f"array<array<{page}>>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        full = (F.size(last) >= C.MAX_BATCH_PAGES) | x["chapter"] | (x["dense"] & F.exists(last, lambda y: y["dense"]))
        new = F.concat(done, F.array(F.array(x)))
        return F.when(F.size(done) == 0, new).when(full, new).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.array(x)))))

    rows = pages.select("doc_id", F.posexplode(F.aggregate("pages", none, step)).alias("i", "batch"))
    numbers, n = F.transform("batch", lambda x: x["p"]), F.col("i") + 1
    chapter = F.get(F.filter("batch", lambda x: x["chapter"]), F.lit(0))["p"]
    return rows.select("doc_id", n.alias("batch_no"), F.format_string("batch-%03d-pages-%03d-%03d", n, F.element_at(numbers, 1), F.element_at(numbers, -1)).alias("batch_id"), numbers.alias("pages"), chapter.alias("chapter_start_page"), F.transform(F.filter("batch", lambda x: x["dense"]), lambda x: x["p"]).alias("dense_pages"))


FRONT = r"(?s)\A---\n(.*?)\n---\n\n?"


def strip_provenance(markdown: Column) -> Column:
    """Removes a leading block of our own keys; another block stays."""
    own = F.contains(F.regexp_extract(markdown, FRONT, 1), F.lit(f"{C.NAMESPACE}_source:"))
    return F.when(own, F.regexp_replace(markdown, FRONT, "")).otherwise(markdown)


def add_provenance(markdown: Column, source: Column, sha256: Column, kind: Column) -> Column:
    """Puts the source's name, hash and the derivative's kind in front; doing so again changes nothing."""
    name = F.concat(F.lit('"'), F.regexp_replace(source, r'(["\\])', r"\\$1"), F.lit('"'))
    head = F.concat(F.lit(f"---\n{C.NAMESPACE}_source: "), name, F.lit(f"\n{C.NAMESPACE}_sha256: "), sha256, F.lit(f"\n{C.NAMESPACE}_kind: "), kind, F.lit("\n---\n\n"))
    return F.concat(head, F.regexp_replace(strip_provenance(markdown), r"\A\n+", ""))


def insert_at_page(pages: DataFrame, extra: DataFrame, *, at_end: bool) -> DataFrame:
    """doc_id, page_number, content with extra(doc_id, page_number, ord, text) put at the start or end of its page."""
    own = extra.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("extra"))
    joined = pages.join(own, ["doc_id", "page_number"], "left")
    body, text = X.strip(F.col("content")), F.col("extra")
    both = F.concat(body, F.lit("\n\n"), text) if at_end else F.concat(text, F.lit("\n\n"), body)
    return joined.select("doc_id", "page_number", F.when(text.isNull(), body).otherwise(both).alias("content"))


def image_references(markdown: DataFrame) -> DataFrame:
    """doc_id, target of every Markdown and HTML image."""
    found = F.regexp_extract_all("markdown", F.lit(C.IMAGE), F.lit(0))
    one = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, C.IMAGE, 1), F.lit("")), F.regexp_extract(x, C.IMAGE, 2))
    html = F.regexp_extract_all("markdown", F.lit(C.HTML_IMAGE), F.lit(1))
    return markdown.select("doc_id", F.explode(F.concat(F.transform(found, one), html)).alias("target"))


def with_images(markdown: DataFrame) -> DataFrame:
    """doc_id, code of raw model output that refers to an image, which none may."""
    return image_references(markdown).select("doc_id", F.lit("CLOUD_UNAUTHORIZED_IMAGE_REFERENCE").alias("code")).distinct()


def dangling_assets(markdown: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id, asset_id of asset markers in the text whose asset isn't among assets(doc_id, asset_id)."""
    used = markdown.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("markdown", F.lit(C.ASSET_MARKER), F.lit(1)))).alias("asset_id"))
    return used.join(assets.select("doc_id", "asset_id"), ["doc_id", "asset_id"], "left_anti")


def unauthorised_images(markdown: DataFrame, assets: DataFrame) -> DataFrame:
    """Image targets that aren't a relative_path of the document's assets."""
    known = assets.select("doc_id", F.col("relative_path").alias("target"))
    return image_references(markdown).join(known, ["doc_id", "target"], "left_anti")


def occurs_once(markdown: Column, needle: Column) -> Column:
    """Whether the text holds the needle exactly once; an empty needle never."""
    return X.occurrences(markdown, needle) == 1


def orders_broken(pages: DataFrame) -> DataFrame:
    """Rows of pages(doc_id, ord, page_number) whose page doesn't come after the one before."""
    doc = Window.partitionBy("doc_id").orderBy("ord")
    return pages.withColumn("before", F.lag("page_number").over(doc)).where("before >= page_number").drop("before")
