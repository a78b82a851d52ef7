"""Queries over links, sources, conflicts, resume, telemetry and validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import derivatives as D
from pagemill.operators import lifecycle as L
from pagemill.operators import links as K
from pagemill.operators import vision as V
from pagemill.functions import text as X
from pagemill.plans.inputs import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls as annotations, some of them local, padded or with credentials."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id")
    uri = F.when(k % 11 == 1, "https://localhost/x").when(k % 11 == 2, "https://127.0.0.1:8080/").when(k % 11 == 3, "https://user@host/").when(k % 11 == 4, F.concat(F.lit(" "), F.col("url"))).when(k % 11 == 5, "https://8.8.8.8/a").when(k % 11 == 6, "https://a.localhost:99999/").when(k % 11 == 7, "https://[fe80::1]/").when(k % 11 == 8, F.lit(None)).otherwise(F.replace("url", F.lit("http://"), F.lit("https://")))
    return p.select(F.floor(k / 10).alias("doc_id"), (k % 3 + 1).cast("int").alias("page_number"), k.alias("link_idx"), uri.alias("uri"))


def link_classify(spark, sf_dir):
    return K.target_kind(_links(spark, sf_dir)).select("link_idx", "uri", "target")


def link_reject_counts(spark, sf_dir):
    return K.rejected_counts(K.target_kind(_links(spark, sf_dir)))


def link_render(spark, sf_dir):
    ok = K.target_kind(_links(spark, sf_dir)).where("target = 'ok'").withColumn("visible_title", F.when(F.col("link_idx") % 2 == 0, F.concat(F.lit("a [title] \\ "), F.col("link_idx").cast("string"))))
    return K.render_links(ok)


def link_title_assign(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"))
    links = p.select("*", F.lit(0).alias("link_idx"), F.lit(100.0).alias("left"), F.lit(680.0).alias("bottom"), F.lit(200.0).alias("right"), F.lit(700.0).alias("top"))
    rows = [(0, "Big ti-", 105.0, 180.0, 125.0, 135.0), (1, "tle here", 105.0, 180.0, 138.0, 148.0), (2, "Other", 110.0, 150.0, 127.0, 137.0), (3, "Beside", 210.0, 250.0, 85.0, 95.0)]
    seen = spark.createDataFrame(rows, "line_id int, text string, x0 double, x1 double, top double, bottom double")
    k, i = F.col("doc_id"), F.col("line_id")
    visible = p.join(F.broadcast(seen), (i < 2) & (k % 3 != 2) | (i == 2) & (k % 3 == 1) | (i == 3) & (k % 2 == 0))  # four rows
    geometry = p.withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))
    return K.titles(links, visible, geometry).select("doc_id", "visible_title")


def fingerprint_text(spark, sf_dir):
    return L.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "sha256", "size_bytes")


def freshness_decision(spark, sf_dir):
    d = L.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"))).withColumn("modified_at", F.timestamp_seconds(F.col("doc_id")))
    saved = d.where("doc_id % 4 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 4 == 1, F.lit("old")).otherwise(F.col("sha256")))
    return L.fresh(d, saved).select("doc_id", "fresh")


def conflict_matrix(spark, sf_dir):
    modes = spark.createDataFrame([("error",), ("overwrite",), ("update",), ("other",)], "mode string")
    flags = spark.range(8).select((F.col("id") % 2 == 1).alias("present"), (F.floor(F.col("id") / 2) % 2 == 1).alias("complete"), (F.col("id") >= 4).alias("fresh"))
    return modes.join(F.broadcast(flags), F.lit(True)).withColumn("action", L.conflict_action(F.col("mode"), F.col("present"), F.col("complete"), F.col("fresh")))  # 4 by 8 rows


def resume_todo(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("doc_id"), F.col("o_orderkey").alias("k"))
    plan = o.select("doc_id", F.concat(F.lit("batch-"), F.col("k").cast("string")).alias("batch_id"), F.array(F.col("k") % 8).alias("pages"), "k")
    k = F.col("k")
    state = plan.where(k % 5 != 0).select("doc_id", "batch_id", F.when(k % 7 == 0, F.array(F.lit(99).cast("long"))).otherwise(F.col("pages")).alias("pages"), F.when(k % 2 == 0, "resp").alias("response_id"), F.when(k % 3 == 0, "text").alias("markdown"), (k % 4 != 0).alias("valid"))
    return L.resume_actions(plan.drop("k"), state)


def telemetry_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 9 != 0, F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 50 - 5) * 1000000)).alias("completed_at"), (F.col("event_id") % 100 - 10).alias("total_tokens"))
    t = L.telemetry(e.withColumn("started_at", F.col("started_at").cast("timestamp")))
    return t.withColumn("total", X.duration_text(F.col("total_ms")))


def path_safety(spark, sf_dir):
    s = spark.createDataFrame([("a/b.png",), ("/a",), ("../a",), ("a/../b",), ("C:/x",), ("a..b/c",), ("",), ("a\\..\\b",), ("..",)], "path string")
    return s.select("path", L.safe_path(F.col("path")).alias("safe"))


def artifact_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/doc."), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("p"))
    return d.select("doc_id", L.artifact_paths(F.col("p")).alias("a")).select("doc_id", "a.markdown", "a.manifest", "a.cloud_markdown")


def asset_anti_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x ![a](assets/"), (F.col("doc_id") % 3).cast("string"), F.lit(".png) and ![b](<other "), (F.col("doc_id") % 2).cast("string"), F.lit(".png>) <IMG alt='x' src=\"h"), (F.col("doc_id") % 5).cast("string"), F.lit('.gif">')).alias("markdown"))
    assets = d.select("doc_id", F.explode(F.array(F.lit("assets/0.png"), F.lit("assets/1.png"), F.lit("other 0.png"), F.lit("h3.gif"))).alias("relative_path"))
    return D.unauthorised_images(d, assets)


def vision_validate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")
    k = F.col("doc_id")
    source = F.when(k % 5 == 4, "not there").otherwise(F.regexp_replace(F.substring("text", 1, 8), r'["\\\s]+', " "))
    json = F.concat(F.lit('{"schema_version":"1.0","page":{"page_number":'), F.when(k % 5 == 1, "2").otherwise("1"), F.lit('},"paragraphs":[{"text":"p","page":{"page_number":1},"confidence":'), F.when(k % 5 == 2, "0.5").otherwise("0.9"), F.lit('}],"formulas":[{"source_text":"'), source, F.lit('","latex":"x","page":{"page_number":1},"confidence":0.95}],"tables":[],"captions":[]'), F.when(k % 5 == 3, ',"more":1}').otherwise("}"))
    return V.validate(d.select("doc_id", "page_number", json.alias("json")), d).select("doc_id", "code")


def response_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("source").alias("output_text")))).otherwise(F.concat(F.lit('{"output":[{"content":[{"type":"output_text","text":"'), F.col("lang"), F.lit('"},{"type":"other","text":"x"}]},{"content":[{"type":"output_text","text":"!"}]}]}'))).alias("r"))
    return d.select("doc_id", L.output_text(F.col("r")).alias("text"))


def html_blocks(spark, sf_dir):
    """An addition: headings, paragraphs and items of raw pages."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.coalesce("html", F.lit("")).alias("html"))
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(h[1-6]|p|li)\b"), F.lit(1))
    return p.select("doc_id", F.explode(tags).alias("tag")).groupBy("doc_id", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (link_classify, link_reject_counts, link_render, link_title_assign, fingerprint_text, freshness_decision, conflict_matrix, resume_todo, telemetry_rollup, path_safety, artifact_paths, asset_anti_join, vision_validate, response_text, html_blocks)}

_LINKS = r"""WITH l AS (
  SELECT page_id // 10 AS doc_id, CAST(page_id % 3 + 1 AS INTEGER) AS page_number, page_id AS link_idx, CASE page_id % 11 WHEN 1 THEN 'https://localhost/x' WHEN 2 THEN 'https://127.0.0.1:8080/' WHEN 3 THEN 'https://user@host/' WHEN 4 THEN ' ' || url
    WHEN 5 THEN 'https://8.8.8.8/a' WHEN 6 THEN 'https://a.localhost:99999/' WHEN 7 THEN 'https://[fe80::1]/' WHEN 8 THEN NULL ELSE replace(url, 'http://', 'https://') END AS uri FROM pages
), k AS (SELECT *, CASE WHEN link_idx % 11 IN (3, 4, 6, 8) THEN 'unsafe' WHEN link_idx % 11 IN (1, 2, 7) THEN 'local' ELSE 'ok' END AS target FROM l)"""

ORACLES = {
    "link_classify": _LINKS + " SELECT link_idx, uri, target FROM k",
    "link_reject_counts": _LINKS + " SELECT doc_id, page_number, CASE target WHEN 'unsafe' THEN 'NATIVE_PDF_LINK_UNSAFE_URL' ELSE 'NATIVE_PDF_LINK_LOCAL_TARGET' END AS code, count(*) AS n FROM k WHERE target <> 'ok' GROUP BY ALL",
    "link_render": _LINKS + r""" SELECT doc_id, page_number, '<!-- srcmap:native-pdf-links page=' || page_number || ' -->' || chr(10) || '**Native PDF links**' || chr(10) || string_agg('- [' || CASE WHEN link_idx % 2 = 0 THEN 'a \[title\] \\ ' || link_idx ELSE 'Link' END || '](<' || uri || '>)', chr(10) ORDER BY link_idx) AS markdown FROM k WHERE target = 'ok' GROUP BY doc_id, page_number""",
    "link_title_assign": "SELECT page_id AS doc_id, CASE WHEN page_id % 3 = 0 THEN 'Big title here' WHEN page_id % 2 = 0 THEN 'Beside' END AS visible_title FROM pages",
    "fingerprint_text": "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes FROM documents",
    "freshness_decision": "SELECT doc_id, doc_id % 4 IN (2, 3) AS fresh FROM documents",
    "conflict_matrix": """SELECT mode, present, complete, fresh, CASE WHEN mode = 'other' THEN 'error' WHEN NOT present THEN 'create' WHEN mode = 'error' THEN 'error' WHEN mode = 'overwrite' THEN 'replace' WHEN NOT complete THEN 'error' WHEN fresh THEN 'reuse' ELSE 'replace' END AS action
FROM (VALUES ('error'), ('overwrite'), ('update'), ('other')) AS a(mode), (VALUES (true), (false)) AS b(present), (VALUES (true), (false)) AS c(complete), (VALUES (true), (false)) AS d(fresh)""",
    "resume_todo": """SELECT o_orderkey // 8 AS doc_id, 'batch-' || o_orderkey AS batch_id, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'start' WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'reuse' WHEN o_orderkey % 3 = 0 THEN 'retry' WHEN o_orderkey % 2 = 0 THEN 'resume' ELSE 'start' END AS action FROM orders""",
    "telemetry_rollup": """WITH e AS (SELECT user_id AS doc_id, CASE WHEN event_id % 9 <> 0 THEN greatest(0, (event_id % 50 - 5) * 1000) END AS ms, CASE WHEN event_id % 100 >= 10 THEN event_id % 100 - 10 END AS tok FROM events),
a AS (SELECT doc_id, count(*) AS batches, CAST(sum(ms) AS BIGINT) AS total_ms, CASE WHEN count(ms) > 1 THEN min(ms) END AS min_ms, CASE WHEN count(ms) > 1 THEN max(ms) END AS max_ms, CAST(sum(tok) AS BIGINT) AS tokens FROM e GROUP BY doc_id)
SELECT *, CASE WHEN total_ms >= 3600000 THEN (total_ms // 3600000) || ' h ' || (total_ms // 60000 % 60) || ' min ' WHEN total_ms >= 60000 THEN (total_ms // 60000 % 60) || ' min ' ELSE '' END || printf('%d,%03d s', total_ms // 1000 % 60, total_ms % 1000) AS total FROM a""",
    "path_safety": r"SELECT * FROM (VALUES ('a/b.png', true), ('/a', false), ('../a', false), ('a/../b', false), ('C:/x', false), ('a..b/c', true), ('', false), ('a\..\b', false), ('..', false)) AS v(path, safe)",
    "artifact_paths": "SELECT doc_id, 'doc.' || doc_id || '.md' AS markdown, 'doc.' || doc_id || '.manifest.json' AS manifest, 'doc.' || doc_id || '.cloud.md' AS cloud_markdown FROM documents",
    "asset_anti_join": "SELECT doc_id, 'assets/2.png' AS target FROM documents WHERE doc_id % 3 = 2 UNION ALL SELECT doc_id, 'other 1.png' FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 'h' || (doc_id % 5) || '.gif' FROM documents WHERE doc_id % 5 <> 3",
    "vision_validate": "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'VISION_INVALID_JSON' WHEN 3 THEN 'VISION_INVALID_JSON' WHEN 2 THEN 'VISION_LOW_CONFIDENCE' WHEN 4 THEN 'VISION_UNVERIFIABLE_CONTENT' END AS code FROM documents",
    "response_text": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang || '!' END AS text FROM documents",
    "html_blocks": "SELECT doc_id, tag, count(*) AS n FROM (SELECT page_id AS doc_id, lower(unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(h[1-6]|p|li)\\b', 1))) AS tag FROM pages) GROUP BY ALL".replace("\\\\", "\\"),
}
