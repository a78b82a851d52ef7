"""Citations, footnotes, figure and table references with their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill import constants as C
from pagemill.functions import text as X


def references(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, page_number, block_idx, kind, label, target_page, target_id, resolved.

    blocks(doc_id, page_number, block_idx, text); targets(doc_id, kind, ord, id,
    page_number): figures and tables in order. A citation goes to the first page that
    defines its number, a figure or table to the target of that number. Definitions
    don't refer to themselves.
    """
    at = ["doc_id", "page_number", "block_idx", "text"]

    def numbers(pattern: str, kind: str, rows: DataFrame) -> DataFrame:
        return rows.select(*at[:3], F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("found"))

    entry, note = X.capture(F.col("text"), C.BIBLIOGRAPHY_ENTRY), X.capture(F.col("text"), C.FOOTNOTE_DEFINITION)
    rows = blocks.select(*at, entry.alias("entry"), note.alias("note"))
    cited = numbers(C.CITATION, "citation", rows.where("entry is null")).withColumn("found", F.explode(F.split("found", r"\s*,\s*")))
    noted = numbers(C.FOOTNOTE, "footnote", rows.where("note is null"))
    found = cited.unionByName(noted).unionByName(numbers(C.FIGURE, "figure", rows)).unionByName(numbers(C.TABLE, "table", rows)).withColumn("n", F.col("found").cast("long")).drop("found")
    first = F.min(F.struct("page_number", "block_idx"))["page_number"].alias("target_page")
    defined = rows.where("entry is not null").groupBy("doc_id", F.lit("citation").alias("kind"), F.col("entry").cast("long").alias("n")).agg(first)
    defined = defined.unionByName(rows.where("note is not null").groupBy("doc_id", F.lit("footnote").alias("kind"), F.col("note").cast("long").alias("n")).agg(first)).withColumn("target_id", F.lit(None).cast("string"))
    place = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ord")).cast("long")
    ordered = targets.select("doc_id", "kind", place.alias("n"), F.col("page_number").alias("target_page"), F.col("id").alias("target_id"))
    out = found.join(defined.unionByName(ordered.select(*defined.columns)), ["doc_id", "kind", "n"], "left")
    return out.select("doc_id", "page_number", "block_idx", "kind", F.col("n").cast("string").alias("label"), "target_page", "target_id", F.col("target_page").isNotNull().alias("resolved"))
