"""Proposals of a vision model: validation and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X

ITEM = "confidence:double,page:struct<page_number:int>"
SCHEMA = (
    f"struct<schema_version:string,page:struct<page_number:int>,paragraphs:array<struct<text:string,{ITEM}>>,formulas:array<struct<source_text:string,latex:string,{ITEM}>>,"
    f"tables:array<struct<title:string,headers:array<string>,rows:array<array<string>>,{ITEM}>>,captions:array<struct<text:string,target_hint:string,{ITEM}>>>"
)
#: Fixed values of the proposal format.
KEYS = ("captions", "formulas", "page", "paragraphs", "schema_version", "tables")
ITEM_KEYS = {"paragraphs": ("confidence", "page", "text"), "formulas": ("confidence", "latex", "page", "source_text"), "tables": ("confidence", "headers", "page", "rows"), "captions": ("confidence", "page", "text")}
OPTIONAL_KEYS = {"paragraphs": (), "formulas": (), "tables": ("title",), "captions": ("target_hint",)}
#: The same JSON with each object's own keys.
RAW = "struct<page:map<string,string>," + ",".join(f"{k}:array<map<string,string>>" for k in ITEM_KEYS) + ">"
LEAST_CONFIDENCE = 0.85
FORBIDDEN_LATEX = ("$$", "\\[", "\\]", "\\begin", "\\end", "\\input", "\\include", "\\write")
INVALID, LOW, UNVERIFIABLE = "VISION_INVALID_JSON", "VISION_LOW_CONFIDENCE", "VISION_UNVERIFIABLE_CONTENT"


def validate(proposals: DataFrame, pages: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """proposals(doc_id, page_number, json) with proposal and code (null: accepted).

    The JSON's keys, version and page come first; then the first item that fails
    decides, paragraphs before formulas, tables and captions: its keys, its page, its
    confidence, and whether its content has the right form and is found in the page's text.
    """
    rows = proposals.join(pages.select("doc_id", "page_number", F.col("text").alias("page_text")), ["doc_id", "page_number"], "left").withColumn("proposal", F.from_json("json", SCHEMA)).withColumn("_raw", F.from_json("json", RAW))
    p, raw = F.col("proposal"), F.col("_raw")
    sorted_keys = lambda m: F.array_sort(F.map_keys(m))
    listed = lambda keys: F.array(*map(F.lit, keys)).cast("array<string>")
    lists = ("paragraphs", "formulas", "tables", "captions")
    shape = (F.array_sort(F.json_object_keys("json")) == F.array(*map(F.lit, KEYS))) & (p["schema_version"] == "1.0") & (p["page"]["page_number"] == F.col("page_number")) & (sorted_keys(raw["page"]) == listed(["page_number"]))
    for kind in lists:
        shape = shape & p[kind].isNotNull()
    flat = lambda c: X.strip(F.regexp_replace(c, r"(?U)\s+", " "))
    empty = lambda c: F.coalesce(X.strip(c), F.lit("")) == ""
    full = lambda cells: F.forall(cells, lambda c: ~empty(c))

    def common(kind: str, x: Column, i: Column, own: Column) -> Column:
        sure, m = x["confidence"], F.get(raw[kind], i)
        keyed = F.array_sort(F.array_except(F.map_keys(m), listed(OPTIONAL_KEYS[kind]))) == listed(ITEM_KEYS[kind])
        there = (x["page"]["page_number"] == F.col("page_number")) & (F.json_object_keys(m["page"]) == listed(["page_number"]))
        return F.when(~F.coalesce(keyed, F.lit(False)), INVALID).when(~F.coalesce(there, F.lit(False)), UNVERIFIABLE).when(~F.coalesce(sure.between(0, 1), F.lit(False)), INVALID).when(sure < least, LOW).otherwise(own)

    forbidden = lambda c: F.exists(F.array(*map(F.lit, FORBIDDEN_LATEX)), lambda t: F.contains(c, t))
    text = lambda kind: lambda x, i: common(kind, x, i, F.when(empty(x["text"]), INVALID))
    formula = lambda x, i: common("formulas", x, i, F.when(empty(x["source_text"]) | empty(x["latex"]), INVALID).when(~F.contains(flat(F.coalesce("page_text", F.lit(""))), flat(x["source_text"])) | forbidden(x["latex"]), UNVERIFIABLE))
    header = lambda x: F.coalesce((F.size(x["headers"]) >= 2) & full(x["headers"]), F.lit(False))
    good_row = lambda x: lambda r: F.coalesce((F.size(r) == F.size(x["headers"])) & full(r), F.lit(False))
    titled = lambda i: F.map_contains_key(F.get(raw["tables"], i), "title")
    table = lambda x, i: common("tables", x, i, F.when(~header(x) | (F.coalesce(F.size(x["rows"]), F.lit(0)) < 1), INVALID).when(~F.forall(x["rows"], good_row(x)), UNVERIFIABLE).when(titled(i) & empty(x["title"]), INVALID))
    codes = F.concat(F.transform(p["paragraphs"], text("paragraphs")), F.transform(p["formulas"], formula), F.transform(p["tables"], table), F.transform(p["captions"], text("captions")))
    first = F.get(F.filter(codes, lambda c: c.isNotNull()), F.lit(0))
    return rows.withColumn("code", F.when(~F.coalesce(shape, F.lit(False)), INVALID).otherwise(first)).drop("page_text", "_raw")


def merge_formulas(text: Column, formulas: Column) -> Column:
    """text with each formula's source replaced by its LaTeX, one after another, where it occurs exactly once."""

    def step(acc: Column, f: Column) -> Column:
        source = f["source_text"]
        at = F.position(source, acc)
        new = F.concat(F.substring(acc, F.lit(1), at - 1), F.lit("$$ "), f["latex"], F.lit(" $$"), F.substring(acc, at + F.length(source), F.length(acc)))
        return F.when(X.occurrences(acc, source) == 1, new).otherwise(acc)

    return F.aggregate(formulas, text, step)


def merge_tables(text: Column, tables: Column) -> Column:
    """text with each table(title, headers, rows) as Markdown behind it, under its title if it has one."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.regexp_replace(c, r"\|", r"\\|")), " | "), F.lit(" |"))
    rule = lambda t: F.concat(F.lit("| "), F.array_join(F.transform(t["headers"], lambda _: F.lit("---")), " | "), F.lit(" |"))
    one = lambda t: F.concat(F.coalesce(F.concat(F.lit("**"), t["title"], F.lit("**\n\n")), F.lit("")), row(t["headers"]), F.lit("\n"), rule(t), F.lit("\n"), F.array_join(F.transform(t["rows"], row), "\n"))
    return F.array_join(F.concat(F.array(text), F.coalesce(F.transform(tables, one), F.array().cast("array<string>"))), "\n\n")


def accepted_pages(selected: DataFrame, validated: DataFrame) -> DataFrame:
    """selected(doc_id, page_number) with accepted: a proposal of the page has no code."""
    good = validated.where("code is null and proposal is not null").select("doc_id", "page_number").distinct().withColumn("_ok", F.lit(True))
    return selected.join(good, ["doc_id", "page_number"], "left").withColumn("accepted", F.col("_ok").isNotNull()).drop("_ok")


def review(validated: DataFrame) -> DataFrame:
    """doc_id, markdown: a line for each page with what became of its proposal."""
    line = F.concat(F.lit("- page "), F.col("page_number").cast("string"), F.lit(": "), F.coalesce("code", F.lit("accepted")))
    listed = F.array_sort(F.collect_list(F.struct("page_number", line.alias("line"))))
    return validated.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("markdown"))
