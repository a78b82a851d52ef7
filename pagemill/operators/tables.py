"""Raw table cells to document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X


def normalize_tables(raw: DataFrame) -> DataFrame:
    """Adds accepted and cells for raw(doc_id, page_number, table_number, cells).

    Accepted: two rows or more, all with as many cells as the first, two or more, none
    null, empty or with an unreadable glyph.
    """
    rows = raw.withColumn("_clean", F.transform("cells", lambda row: F.transform(row, X.normalize_cell)))
    good = lambda row: (F.size(row) == F.size(F.element_at("_clean", 1))) & (F.size(row) >= 2) & F.forall(row, lambda c: (F.coalesce(c, F.lit("")) != "") & ~F.contains(F.coalesce(c, F.lit("")), F.lit("(cid:")))
    ok = (F.size("_clean") >= 2) & F.forall("_clean", good)
    return rows.withColumn("accepted", F.coalesce(ok, F.lit(False))).withColumn("cells", F.when(F.col("accepted"), F.col("_clean"))).drop("_clean")


def rejected_counts(tables: DataFrame) -> DataFrame:
    return tables.where("not accepted").groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit("UNSUPPORTED_TABLE_STRUCTURE"))


def merge_adjacent(tables: DataFrame) -> DataFrame:
    """doc_id, table_id, page_number, headers, rows: a table with the headers of the accepted one before, on the page before, goes on with it."""
    doc = Window.partitionBy("doc_id").orderBy("page_number", "table_number")
    good = tables.where("accepted").withColumn("headers", F.element_at("cells", 1)).withColumn("body", F.slice("cells", 2, F.size("cells")))
    goes_on = (F.lag("page_number").over(doc) == F.col("page_number") - 1) & (F.lag("headers").over(doc) == F.col("headers"))
    out = good.withColumn("table", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "table_number", "body")))
    merged = out.groupBy("doc_id", "table").agg(parts.alias("parts"), F.min_by("headers", F.struct("page_number", "table_number")).alias("headers"))
    first = F.element_at("parts", 1)
    return merged.select("doc_id", F.format_string("page-%03d-table-%02d", first["page_number"], first["table_number"]).alias("table_id"), first["page_number"].alias("page_number"), "headers", F.flatten(F.transform("parts", lambda p: p["body"])).alias("rows"))


def render(tables: DataFrame) -> DataFrame:
    return tables.withColumn("markdown", X.table_markdown(F.col("headers"), F.col("rows")))
