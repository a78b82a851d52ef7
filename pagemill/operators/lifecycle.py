"""Sources, conflicts, freshness, resume, telemetry, reviews, paths and validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X


def fingerprint(texts: DataFrame, column: str = "text") -> DataFrame:
    """Adds sha256 and size_bytes of a string or binary column."""
    return texts.withColumn("sha256", F.sha2(F.col(column).cast("binary"), 256)).withColumn("size_bytes", F.octet_length(F.col(column)).cast("long"))


def fresh(sources: DataFrame, saved: DataFrame) -> DataFrame:
    """sources with fresh: the saved record has the same path, size, hash and time."""
    key = ["path", "size_bytes", "sha256", "modified_at"]
    old = saved.select("doc_id", *(F.col(k).alias(f"_{k}") for k in key))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return sources.join(old, "doc_id", "left").withColumn("fresh", F.coalesce(same, F.lit(False))).drop(*(f"_{k}" for k in key))


def conflict_action(mode: Column, exists: Column, complete: Column, is_fresh: Column) -> Column:
    """create, reuse, replace or error for a mode of error, overwrite or update."""
    return (
        F.when(~mode.isin("error", "overwrite", "update"), "error").when(~exists, "create").when(mode == "error", "error")
        .when(mode == "overwrite", "replace").when(~complete, "error").when(is_fresh, "reuse").otherwise("replace")
    )


def resume_actions(plan: DataFrame, state: DataFrame) -> DataFrame:
    """doc_id, batch_id, action of each planned batch.

    state(doc_id, batch_id, pages, response_id, markdown, valid): start without state or
    with other pages; reuse a stored result that is still valid, retry one that isn't;
    resume an open response.
    """
    s = state.select("doc_id", "batch_id", F.col("pages").alias("_pages"), "response_id", "markdown", "valid")
    out = plan.join(s, ["doc_id", "batch_id"], "left")
    bound = F.coalesce(F.col("_pages") == F.col("pages"), F.lit(False))
    done = F.col("markdown").isNotNull()
    action = F.when(~bound, "start").when(done & F.col("valid"), "reuse").when(done, "retry").when(F.col("response_id").isNotNull(), "resume").otherwise("start")
    return out.select("doc_id", "batch_id", action.alias("action"))


def merge_batches(parts: DataFrame) -> DataFrame:
    """doc_id, markdown: stripped parts in batch order, a blank line between and a newline at the end."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch_no", X.strip(F.col("markdown")).alias("m")))), lambda x: x["m"]), "\n\n")
    return parts.groupBy("doc_id").agg(F.concat(body, F.lit("\n")).alias("markdown"))


def telemetry(runs: DataFrame) -> DataFrame:
    """doc_id, batches, total_ms, min_ms, max_ms (these two only of several), tokens; negative durations count as 0, broken ones not."""
    took = F.unix_millis(F.col("completed_at")) - F.unix_millis(F.col("started_at"))
    ms = F.when(took.isNotNull(), F.greatest(F.lit(0), took))  # greatest() passes over nulls
    rows = runs.withColumn("_ms", ms).withColumn("_tokens", F.when(F.col("total_tokens") >= 0, F.col("total_tokens")))
    several = F.count("_ms") > 1
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("batches"), F.sum("_ms").alias("total_ms"), F.when(several, F.min("_ms")).alias("min_ms"), F.when(several, F.max("_ms")).alias("max_ms"), F.sum("_tokens").alias("tokens"))


def parse_timestamp(value: Column) -> Column:
    """ISO 8601 with a zone, or null."""
    return F.when(value.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(value))


def safe_path(path: Column) -> Column:
    """A relative path that stays below its root."""
    return (path != "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def artifact_paths(source: Column) -> Column:
    """Struct of the paths that belong to a source, by its base name."""
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/]*)$", 1), r"\.[^.]*$", "")
    of = lambda end, name: F.concat(stem, F.lit(end)).alias(name)
    return F.struct(of(".md", "markdown"), of(".assets", "assets"), of(".manifest.json", "manifest"), of(".vision", "vision_proposals"), of(".vision.md", "vision_markdown"), of(".vision-review.md", "vision_review"), of(".cloud.md", "cloud_markdown"), of(".cloud-run.json", "cloud_run_state"), of(".review.md", "review"))


def review_table(warnings: DataFrame) -> DataFrame:
    """doc_id, code, line: a Markdown table row with the count and pages of each code."""
    counted = warnings.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("page_number")).alias("pages"))
    return counted.select("doc_id", "code", F.concat_ws(" | ", F.lit("|"), "code", F.col("n").cast("string"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit("|")).alias("line"))


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, json: all other columns as one JSON object, nulls left out."""
    columns = sorted(c for c in documents.columns if c != "doc_id")
    return documents.select("doc_id", F.to_json(F.struct(*columns)).alias("json"))


def output_text(response: Column) -> Column:
    """The text of a model response: output_text, or the text parts of its output; empty without any."""
    return F.coalesce(output_text_or_null(response), F.lit(""))


def output_text_or_null(response: Column) -> Column:
    schema = "struct<output_text:string,output:array<struct<content:array<struct<type:string,text:string>>>>>"
    parsed = F.from_json(response, schema)
    parts = F.filter(F.flatten(F.transform(parsed["output"], lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>")))), lambda c: c["type"] == "output_text")
    texts = F.filter(F.transform(parts, lambda c: c["text"]), lambda t: t.isNotNull())
    return F.coalesce(parsed["output_text"], F.when(F.size(texts) > 0, F.array_join(texts, "")))


def exit_code(has_error: Column, warnings: Column) -> Column:
    return F.when(has_error, 2).when(warnings > 0, 1).otherwise(0)


def invalid_pages(pages: DataFrame) -> DataFrame:
    """Rows that break a page's rules: numbers from 1, words from 0, one or two columns."""
    return pages.where(~((F.col("page_number") >= 1) & (F.col("word_count") >= 0) & F.col("column_count").isin(1, 2)))


def expected_pages(pages: DataFrame) -> DataFrame:
    """doc_id, complete: the pages are 1 to n without gaps or repeats."""
    return pages.groupBy("doc_id").agg((F.array_sort(F.collect_list("page_number")) == F.sequence(F.lit(1), F.count(F.lit(1)).cast("int"))).alias("complete"))


def concat_in_order(*sources: DataFrame) -> DataFrame:
    """Warnings of several sources with ord: the sources' order, then their own."""
    out = None
    for rank, rows in enumerate(sources):
        ranked = rows.withColumn("_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("_rank", F.col("page_number").asc_nulls_last(), "code")
    return out.withColumn("ord", F.row_number().over(order)).drop("_rank")
