"""Run results, configuration, saved state and what is re-checked when a result is used again."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import derivatives as D
from pagemill.operators import lifecycle as L

PAGE = ["doc_id", "page_number"]


# --- results


def run_status(documents: DataFrame, warnings: DataFrame) -> DataFrame:
    """doc_id, status: success, or partial where there is any finding, of whatever severity."""
    some = warnings.select("doc_id").distinct().withColumn("_any", F.lit(True))
    return documents.select("doc_id").join(some, "doc_id", "left").select("doc_id", F.when(F.col("_any"), "partial").otherwise("success").alias("status"))


def without_drawn(warnings: DataFrame, assets: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Findings on drawn figures, less those of pages that got a drawn figure, unless a caption there is still without one."""
    solved = assets.select(*PAGE).join(unresolved.select(*PAGE), PAGE, "left_anti")
    return warnings.join(solved, PAGE, "left_anti")


def of_pages(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of the pages from first to last; rows without a page are left out."""
    return rows.where(F.col("page_number").between(first, last))


def page_subset(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, content, complete: the wanted pages in order, and whether all of them are there."""
    found = wanted.select(*PAGE).join(pages.select(*PAGE, "content"), PAGE, "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "content"))), lambda x: x["content"])
    return found.groupBy("doc_id").agg(listed.alias("content"), (F.count("content") == F.count(F.lit(1))).alias("complete"))


def without_scans(assets: DataFrame, pages: DataFrame) -> DataFrame:
    """Assets, less those of pages that OCR laid out: their image is the whole page."""
    return assets.join(pages.where(F.col("layout_html").isNotNull()).select(*PAGE), PAGE, "left_anti")


def all_assets(raster: DataFrame, drawn: DataFrame) -> DataFrame:
    return raster.unionByName(drawn, allowMissingColumns=True)


def all_findings(warnings: DataFrame, errors: DataFrame) -> DataFrame:
    """Findings as they were before they were dealt into warnings and errors."""
    plain = warnings if "severity" in warnings.columns else warnings.withColumn("severity", F.lit("warning"))
    return plain.unionByName(errors.withColumn("severity", F.lit("error")), allowMissingColumns=True)


def finding_json(code: Column, message: Column, severity: Column, page: Column) -> Column:
    """A finding as JSON; an error has no severity, and a finding of the whole document no page."""
    return F.to_json(F.struct(code.alias("code"), message.alias("message"), F.when(severity != "error", severity).alias("severity"), F.when(page.isNotNull(), F.struct(page.alias("page_number"))).alias("page")))


def run_json(run: DataFrame) -> DataFrame:
    """doc_id, json of run(doc_id, conversion_status, paths, reused, vision_pages, and optional sections)."""
    return L.manifest(run)


def contract_json(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with json: the named columns as one object, nulls left out."""
    return rows.withColumn("json", F.to_json(F.struct(*columns)))


def status_message(status: Column) -> Column:
    known = F.create_map(F.lit("queued"), F.lit("The request is waiting."), F.lit("in_progress"), F.lit("The model is at work."), F.lit("completed"), F.lit("The answer is here and is being checked."))
    return F.coalesce(F.element_at(known, status), F.concat(F.lit("Request: "), status, F.lit(".")))


def instructions(first: Column, last: Column, count: Column) -> Column:
    """What a model is asked to do with a batch of pages."""
    return F.format_string("Write pages %d to %d of a document of %d pages as Markdown. Begin each page with its marker <!-- srcmap:page=N --> on a line of its own. Add nothing, leave nothing out, and refer to no images.", first, last, count)


# --- configuration


def endpoint_ok(url: Column) -> Column:
    """An absolute http or https address without a path."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#\s]+/?([?#].*)?$"), F.lit(False))


def confidence_ok(value: Column) -> Column:
    return F.coalesce(value.between(0, 100), F.lit(False))


def vision_config_code(config: DataFrame) -> DataFrame:
    """config(provider, mode, model_id, endpoint, render_dpi, timeout_seconds) with code: the first rule it breaks, or null."""
    c = F.col
    active = c("mode") != "off"
    code = (
        F.when(~c("render_dpi").between(72, 600), "RENDER_DPI").when(~c("timeout_seconds").between(1, 3600), "TIMEOUT")
        .when((c("provider") == "none") & active, "MODE_WITHOUT_PROVIDER").when((c("provider") == "none") & (c("model_id").isNotNull() | c("endpoint").isNotNull()), "OPTIONS_WITHOUT_PROVIDER")
        .when(c("provider") == "none", None).when(active & (F.coalesce("model_id", F.lit("")) == ""), "MODEL_MISSING")
        .when((c("provider") == "local") & active & (F.coalesce("endpoint", F.lit("")) == ""), "ENDPOINT_MISSING")
        .when((c("provider") == "local") & c("endpoint").isNotNull() & ~endpoint_ok(c("endpoint")), "ENDPOINT_INVALID")
        .when((c("provider") != "local") & c("endpoint").isNotNull(), "ENDPOINT_NOT_ALLOWED")
    )
    return config.withColumn("code", code)


def cloud_config_code(config: DataFrame) -> DataFrame:
    """config(mode, model_id, timeout_seconds, max_output_tokens) with code, as above."""
    c = F.col
    code = F.when(~c("timeout_seconds").between(1, 3600), "TIMEOUT").when(~c("max_output_tokens").between(1024, 32768), "MAX_OUTPUT_TOKENS").when((c("mode") == "off") & c("model_id").isNotNull(), "OPTIONS_WITHOUT_MODE").when((c("mode") != "off") & (F.coalesce("model_id", F.lit("")) == ""), "MODEL_MISSING")
    return config.withColumn("code", code)


PUBLIC = ("provider", "mode", "model_id", "render_dpi", "timeout_seconds", "max_output_tokens")


def public_options(config: DataFrame) -> DataFrame:
    """Only columns without secrets; the endpoint of a local provider alone."""
    shown = [c for c in PUBLIC if c in config.columns]
    endpoint = [F.when(F.col("provider") == "local", F.col("endpoint")).alias("endpoint")] if {"provider", "endpoint"} <= set(config.columns) else []
    return config.select(*shown, *endpoint)


# --- saved state

STATE = "struct<schema_version:string,source_sha256:string,local_markdown_sha256:string,model_id:string,prompt_version:string,started_at:string,plan:array<struct<batch_id:string,page_numbers:array<int>>>,entries:array<struct<batch_id:string,page_numbers:array<int>,response_id:string,markdown:string,telemetry:map<string,string>>>>"


def saved_state(states: DataFrame, version: str = "1.0") -> DataFrame:
    """states(json, ...) with state: the saved state of a run, or null where it is broken.

    A plan has batches with ids and pages from 1 on; entries are those batches, in that
    order with those pages; a finished one has Markdown and telemetry; no response id is empty.
    """
    s = F.from_json("json", STATE)
    rows = states.withColumn("state", s)
    s = F.col("state")
    pages_ok = lambda p: (F.size(p) > 0) & F.forall(p, lambda n: F.coalesce(n >= 1, F.lit(False)))
    plan_ok = (F.size(s["plan"]) > 0) & F.forall(s["plan"], lambda b: F.coalesce((b["batch_id"] != "") & pages_ok(b["page_numbers"]), F.lit(False)))
    bare = lambda a: F.transform(a, lambda b: F.struct(b["batch_id"].alias("batch_id"), b["page_numbers"].alias("page_numbers")))
    entry_ok = F.forall(s["entries"], lambda e: (e["markdown"].isNull() == e["telemetry"].isNull()) & F.coalesce(e["response_id"] != "", F.lit(True)))
    times = L.parse_timestamp(s["started_at"]).isNotNull()
    good = plan_ok & (bare(s["plan"]) == bare(s["entries"])) & entry_ok & times & (s["schema_version"] == version)
    return rows.withColumn("state", F.when(F.coalesce(good, F.lit(False)), s))


def matching_state(states: DataFrame, runs: DataFrame) -> DataFrame:
    """runs(doc_id, source_sha256, local_markdown_sha256, model_id, prompt_version, plan) with the saved state of the same run, or null."""
    keys = ("source_sha256", "local_markdown_sha256", "model_id", "prompt_version")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"state.{k}") == F.col(k))
    joined = runs.join(saved_state(states).select("doc_id", "state"), "doc_id", "left")
    return joined.withColumn("state", F.when(F.coalesce(same & (F.col("state.plan") == F.col("plan")), F.lit(False)), F.col("state")))


def merge_in_plan_order(plan: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, markdown, code: parts in the plan's order; a part that the plan lacks, or that is missing, is a code.

    plan(doc_id, batch_no, batch_id), parts(doc_id, batch_id, markdown).
    """
    both = plan.join(parts, ["doc_id", "batch_id"], "full_outer")
    wrong = both.groupBy("doc_id").agg(F.max(F.col("batch_no").isNull() | F.col("markdown").isNull()).alias("wrong"))
    merged = L.merge_batches(both.where("batch_no is not null and markdown is not null"))
    return wrong.join(merged, "doc_id", "left").select("doc_id", F.when(~F.col("wrong"), F.col("markdown")).alias("markdown"), F.when(F.col("wrong"), "BATCHES_DIFFER_FROM_PLAN").alias("code"))


# --- re-checking a manifest


def marker_pages(markdown: Column) -> Column:
    """The pages of Markdown whose markers run from 1 without gaps, each on a line of its own; else null."""
    text = D.strip_provenance(markdown)
    n = F.size(F.regexp_extract_all(text, F.lit(D.PAGE), F.lit(1)))
    return F.when((n > 0) & D.marker_code(text, F.lit(1), n).isNull(), F.sequence(F.lit(1), n))


def reuse_code(manifests: DataFrame, version: str = "1.0") -> DataFrame:
    """doc_id, code of manifests(doc_id, schema_version, markdown, markdown_sha256, page_numbers, assets, references, quality).

    The first rule that a stored result breaks, or null: version, hash, page markers,
    assets (ids unique, paths safe, pages there), references to unknown assets or pages,
    and a quality status that doesn't follow from its findings.
    """
    m = F.col
    pages = m("page_numbers")
    known = lambda p: F.coalesce(F.array_contains(pages, p), F.lit(False))
    ids = F.transform("assets", lambda a: a["asset_id"])
    worst = F.when(F.size("quality.errors") > 0, "error").when(F.exists("quality.warnings", lambda w: w["severity"] != "info"), "warning").otherwise("ok")
    findings = F.concat("quality.warnings", "quality.errors")
    code = (
        F.when(~F.coalesce(m("schema_version") == version, F.lit(False)), "VERSION").when(~F.coalesce(m("markdown_sha256") == F.sha2("markdown", 256), F.lit(False)), "MARKDOWN_CHANGED")
        .when(~F.coalesce(marker_pages(m("markdown")) == pages, F.lit(False)), "PAGE_MARKERS").when(F.size(F.array_distinct(ids)) != F.size(ids), "ASSET_NOT_UNIQUE")
        .when(~F.forall("assets", lambda a: F.coalesce(L.safe_path(a["path"]), F.lit(False)) & known(a["page_number"])), "ASSET_INVALID")
        .when(~F.forall("references", lambda r: r["kind"].isin("text", "table", "asset") & known(r["page_number"])), "REFERENCE_INVALID")
        .when(F.exists("references", lambda r: (r["kind"] == "asset") & ~F.coalesce(F.array_contains(ids, r["asset_id"]), F.lit(False))), "REFERENCE_UNKNOWN_ASSET")
        .when(~F.forall(findings, lambda f: f["page_number"].isNull() | known(f["page_number"])), "FINDING_INVALID").when(~F.coalesce(m("quality.status") == worst, F.lit(False)), "QUALITY_STATUS")
    )
    return manifests.select("doc_id", code.alias("code"))


def path_code(paths: DataFrame) -> DataFrame:
    """paths(source, output_dir, target) with code: a target that is the source, or lies outside the output folder."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), r"/+", "/"), r"(/\.)+(?=/|$)|/$", "")
    inside = F.startswith(plain("target"), F.concat(plain("output_dir"), F.lit("/"))) & ~F.col("target").rlike(r"(^|/)\.\.(/|$)")
    return paths.withColumn("code", F.when(plain("target") == plain("source"), "TARGET_IS_SOURCE").when(~inside, "TARGET_OUTSIDE"))


# --- progress


class Progress:
    """Says on stderr what a run is doing: not at all, for people, or as JSON lines; or to a callback of one's own."""

    def __init__(self, mode: str = "none", stream=None, callback: Callable[[str, str, str], None] | None = None):
        if mode not in ("none", "human", "jsonl"):
            raise ValueError("mode is none, human or jsonl")
        self.mode, self.stream, self.callback, self.began = mode, stream or sys.stderr, callback, time.perf_counter()

    def __call__(self, phase: str, status: str, message: str) -> None:
        if self.callback:
            self.callback(phase, status, message)
        ms = int((time.perf_counter() - self.began) * 1000)
        if self.mode == "human":
            print(f"[{ms / 1000:.1f}s] {message}", file=self.stream, flush=True)
        elif self.mode == "jsonl":
            print(json.dumps({"event": "progress", "phase": phase, "status": status, "message": message, "elapsed_ms": ms}), file=self.stream, flush=True)
