"""Page text to blocks: headings, paragraphs and list items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X

SHY = "­"


def lines_of(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_idx, line for pages(doc_id, page_number, text)."""
    return pages.select("doc_id", "page_number", F.posexplode(X.split_lines(F.col("text"))).alias("line_idx", "line"))


def classify(lines: DataFrame) -> DataFrame:
    """Adds kind (blank, table, formula, heading, list_item, paragraph), heading_level, ordered and content.

    Optional columns of lines: is_table, formula (LaTeX), typographic_level and
    is_bullet, as page geometry gives them.
    """
    has = set(lines.columns)
    line = F.col("line")
    table = F.coalesce(F.col("is_table"), F.lit(False)) if "is_table" in has else F.lit(False)
    formula = F.col("formula") if "formula" in has else F.lit(None).cast("string")
    level = X.heading_level(line, F.col("typographic_level") if "typographic_level" in has else None)
    graphic = F.coalesce(F.col("is_bullet"), F.lit(False)) if "is_bullet" in has else F.lit(False)
    bullet, number = X.bullet_text(line), X.ordered_text(line)
    kind = (
        F.when(X.is_blank(line), "blank").when(table, "table").when(formula.isNotNull(), "formula").when(level.isNotNull(), "heading")
        .when(graphic | bullet.isNotNull() | number.isNotNull(), "list_item").otherwise("paragraph")
    )
    out = lines.withColumn("kind", kind)
    content = F.when(F.col("kind") == "formula", F.concat(F.lit("$$"), formula, F.lit("$$"))).when(F.col("kind") == "list_item", F.when(graphic, line).otherwise(F.coalesce(bullet, number))).otherwise(line)
    return out.withColumn("heading_level", F.when(F.col("kind") == "heading", level)).withColumn("ordered", F.when(F.col("kind") == "list_item", ~graphic & bullet.isNull())).withColumn("content", content)


def build_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, page_number, block_idx, kind, text, heading_level, ordered for classified lines.

    One shuffle, by page. A run of paragraph lines is one block; it belongs to the list
    item before it unless a blank line, or another block, came in between. Lines of a run
    are joined by a space, or at a soft hyphen without it.
    """
    page = Window.partitionBy("doc_id", "page_number").orderBy("line_idx")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    kind, para = F.col("kind"), F.col("kind") == "paragraph"
    out = lines.withColumn("before", F.lag("kind").over(page)).withColumn("after", F.lead("kind").over(page)).withColumn("line_before", F.lag("line").over(page))
    event = F.when(kind == "list_item", "list_item").when(kind.isin("heading", "formula") | (para & (F.col("before") == "blank")), "other")
    out = out.withColumn("owner", F.last(event, ignorenulls=True).over(so_far))
    runs_on = para & F.coalesce(F.col("before") == "paragraph", F.lit(False))
    starts = kind.isin("heading", "formula", "list_item") | (para & ~runs_on & (F.coalesce(F.col("owner"), F.lit("other")) != "list_item"))
    out = out.withColumn("starts", starts).withColumn("block_idx", F.sum(starts.cast("int")).over(so_far) - 1)
    hyphen_before = runs_on & F.endswith(F.col("line_before"), F.lit(SHY))
    hyphen_after = para & F.endswith(F.col("line"), F.lit(SHY)) & F.coalesce(F.col("after") == "paragraph", F.lit(False))
    piece = F.when(hyphen_after, F.expr("left(content, length(content) - 1)")).otherwise(F.col("content"))
    piece = F.when(F.col("starts"), piece).when(hyphen_before, F.regexp_replace(piece, r"(?U)^\s+", "")).otherwise(F.concat(F.lit(" "), piece))
    body = out.where(~kind.isin("blank", "table")).select("doc_id", "page_number", "block_idx", "line_idx", "starts", "heading_level", "ordered", kind.alias("line_kind"), piece.alias("piece"))
    first = lambda c: F.max(F.when(F.col("starts"), F.col(c)))
    blocks = body.groupBy("doc_id", "page_number", "block_idx").agg(
        first("line_kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "piece"))), lambda x: x["piece"]), "").alias("text"), first("heading_level").alias("heading_level"), first("ordered").alias("ordered"))
    return blocks.withColumn("kind", F.when(F.col("kind") == "formula", "paragraph").otherwise(F.col("kind")))


def _with_continuations(blocks: DataFrame) -> DataFrame:
    """Adds continues: a paragraph that begins a page and goes on with the list item that came before.

    Such paragraphs are no end of a list, so whether one continues depends on the last
    block that isn't a page's first paragraph. Pages with layout_html (an optional
    column of blocks) are set as they are: they end a list and continue none.
    """
    doc = Window.partitionBy("doc_id").orderBy("page_number", "block_idx")
    laid_out = F.col("layout_html").isNotNull() if "layout_html" in blocks.columns else F.lit(False)
    first = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("block_idx")) == 1
    rows = blocks.withColumn("_may", first & (F.col("kind") == "paragraph") & ~laid_out)
    state = F.last(F.when(~F.col("_may"), (F.col("kind") == "list_item") & ~laid_out), ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("continues", F.col("_may") & F.coalesce(state, F.lit(False))).drop("_may")


def number_list_items(blocks: DataFrame) -> DataFrame:
    """Adds continues and number: counts ordered items that follow one another, over pages too.

    An unordered item or another block starts over; a paragraph that continues an item doesn't.
    """
    doc = Window.partitionBy("doc_id").orderBy("page_number", "block_idx")
    counts = F.coalesce((F.col("kind") == "list_item") & F.col("ordered"), F.lit(False))
    out = _with_continuations(blocks)
    out = out.withColumn("run", F.sum(F.when(counts | F.col("continues"), 0).otherwise(1)).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("doc_id", "run", counts).orderBy("page_number", "block_idx"))
    return out.withColumn("number", F.when(counts, place)).drop("run")


def list_continuations(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, continues: pages whose first block goes on with a list item."""
    return _with_continuations(blocks).groupBy("doc_id", "page_number").agg(F.max("continues").alias("continues"))


def block_markdown(kind: Column, text: Column, level: Column, number: Column) -> Column:
    item = F.concat(F.coalesce(F.concat(number.cast("string"), F.lit(". ")), F.lit("- ")), text)
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(kind == "list_item", item).otherwise(text)


def render_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, markdown, continues: one newline between list items, a blank line between other blocks.

    The paragraph that continues an item of the page before is indented below its
    page's marker, which is part of the markdown then.
    """
    numbered = number_list_items(blocks)
    page = Window.partitionBy("doc_id", "page_number").orderBy("block_idx")
    before = F.lag("kind").over(page)
    tight = F.lag("continues").over(page) | ((F.col("kind") == "list_item") & (before == "list_item"))
    gap = F.when(before.isNull(), "").when(tight, "\n").otherwise("\n\n")
    marker = X.page_marker(F.col("page_number"))
    body = F.when(F.col("continues"), F.concat(F.lit("  "), marker, F.lit("\n  "), "text")).otherwise(block_markdown(F.col("kind"), F.col("text"), F.col("heading_level"), F.col("number")))
    pieces = numbered.select("doc_id", "page_number", "block_idx", "continues", F.concat(gap, body).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy("doc_id", "page_number").agg(joined.alias("markdown"), F.max("continues").alias("continues"))


def render_pages(pages: DataFrame, body: str = "markdown") -> DataFrame:
    """doc_id, markdown: each page's marker and body, pages joined by a blank line; a page without body is its marker."""
    text = F.coalesce(F.col(body), F.lit(""))
    marker = X.page_marker(F.col("page_number"))
    part = F.when(text == "", marker).otherwise(F.concat(marker, F.lit("\n"), text))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("markdown"))


ORPHAN, REPEATED = "CONTENT_WITHOUT_PAGE", "PAGE_NOT_UNIQUE"


def render_document(pages: DataFrame, blocks: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """doc_id, markdown, code for pages(doc_id, page_number, and layout_html where OCR set one).

    Every page has its marker, its blocks or its layout, and then its parts(doc_id,
    page_number, rank, ord, text): links, figures and tables as Markdown, by rank and
    ord, with blank lines between. A document with a page twice, or with content of a
    page that it hasn't, has no Markdown but a code. Pages are joined with their blocks
    and parts by document and page; nothing else is shuffled but the pages' text.
    """
    key = ["doc_id", "page_number"]
    laid_out = pages.withColumn("layout_html", F.lit(None).cast("string")) if "layout_html" not in pages.columns else pages
    one = laid_out.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.max("layout_html").alias("layout_html"))
    # A laid-out page has a block of its own kind, so that lists end there.
    layouts = one.where(F.col("layout_html").isNotNull()).select(*key, F.lit(-1).cast("long").alias("block_idx"), F.lit("layout").alias("kind"), F.col("layout_html").alias("text"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("boolean").alias("ordered"), "layout_html")
    own = blocks.select(*key, F.col("block_idx").cast("long").alias("block_idx"), "kind", "text", "heading_level", "ordered").join(one.where(F.col("layout_html").isNotNull()).select(*key), key, "left_anti")
    body = render_blocks(own.withColumn("layout_html", F.lit(None).cast("string")).unionByName(layouts))
    rows = one.join(body, key, "full_outer")
    if parts is not None:
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ord", "text"))), lambda x: x["text"]), "\n\n")
        rows = rows.join(parts.where("text <> ''").groupBy(*key).agg(listed.alias("extra")), key, "full_outer")
    else:
        rows = rows.withColumn("extra", F.lit(None).cast("string"))
    text = F.array_join(F.filter(F.array("markdown", "extra"), lambda x: x.isNotNull() & (x != "")), "\n\n")
    marker, goes_on = X.page_marker(F.col("page_number")), F.coalesce("continues", F.lit(False))
    whole = F.when(goes_on, text).when(text == "", marker).otherwise(F.concat(marker, F.lit("\n"), text))
    code = F.when(F.col("times").isNull(), ORPHAN).when(F.col("times") > 1, REPEATED)
    listed = rows.select("doc_id", code.alias("code"), F.struct("page_number", goes_on.alias("continues"), whole.alias("text")).alias("page"))
    docs = listed.groupBy("doc_id").agg(F.min("code").alias("code"), F.array_sort(F.collect_list("page")).alias("pages"))
    joined = F.aggregate("pages", F.lit(""), lambda s, p: F.concat(s, F.when(s == "", "").when(p["continues"], "\n").otherwise("\n\n"), p["text"]))
    return docs.select("doc_id", F.when(F.col("code").isNull(), joined).alias("markdown"), "code")
