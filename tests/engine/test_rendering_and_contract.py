"""Whole documents, page extraction, proposals, and what is re-checked when a result is used again."""

import hashlib
import io
import json
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.operators import blocks as B
from pagemill.operators import contract as C
from pagemill.operators import derivatives as D
from pagemill.operators import extract as E
from pagemill.operators import figures as G
from pagemill.operators import findings as W
from pagemill.operators import layout as Y
from pagemill.operators import lifecycle as L
from pagemill.operators import links as K
from pagemill.operators import ocr as O
from pagemill.operators import vision as V

PAGES = "doc_id string, page_number int, layout_html string"
PARTS = "doc_id string, page_number int, rank int, ord int, text string"


def marker(n):
    return f"<!-- srcmap:page={n} -->"


def document(spark, texts, layouts=None, parts=()):
    pages = spark.createDataFrame([("d", n, (layouts or {}).get(n)) for n in texts], PAGES)
    lines = spark.createDataFrame([("d", n, t) for n, t in texts.items()], "doc_id string, page_number int, text string")
    return B.render_document(pages, B.build_blocks(B.classify(B.lines_of(lines))), spark.createDataFrame([("d", *p) for p in parts], PARTS)).first()


def test_a_list_goes_on_over_pages(spark):
    got = document(spark, {1: "1. a\n2. b", 2: "goes on\n3. c", 3: "and on", 4: "and on still\n\nthen not"})["markdown"]
    want = f"{marker(1)}\n1. a\n2. b\n  {marker(2)}\n  goes on\n3. c\n  {marker(3)}\n  and on\n  {marker(4)}\n  and on still\nthen not"
    assert got == want
    assert [r["page_number"] for r in D.split_pages(spark.createDataFrame([("d", got)], "doc_id string, markdown string")).collect()] == [1, 2, 3, 4]


def test_pages_without_blocks_and_layouts(spark):
    got = document(spark, {1: "- a", 2: "", 3: "text", 4: "lost", 5: "text"}, {4: "<pre>x</pre>"})["markdown"]
    assert got == f"{marker(1)}\n- a\n\n{marker(2)}\n  {marker(3)}\n  text\n\n{marker(4)}\n<pre>x</pre>\n\n{marker(5)}\ntext"


def test_parts_and_strays(spark):
    parts = [(1, 2, 0, "table"), (1, 0, 0, "links"), (2, 1, 1, "second"), (2, 1, 0, "first")]
    assert document(spark, {1: "a", 2: ""}, parts=parts)["markdown"] == f"{marker(1)}\na\n\nlinks\n\ntable\n\n{marker(2)}\nfirst\n\nsecond"
    stray = document(spark, {1: "a"}, parts=[(7, 0, 0, "x")])
    assert stray["markdown"] is None and stray["code"] == B.ORPHAN
    twice = spark.createDataFrame([("d", 1, None), ("d", 1, None)], PAGES)
    blocks = B.build_blocks(B.classify(B.lines_of(spark.createDataFrame([("d", 1, "a")], "doc_id string, page_number int, text string"))))
    assert B.render_document(twice, blocks).first()["code"] == B.REPEATED
    assert B.render_document(twice.where("false"), blocks.where("false")).count() == 0


def profile(spark, text):
    r = D.page_profiles(spark.createDataFrame([("d", 1, text)], "doc_id string, page_number int, content string")).first()
    return r["word_count"], r["has_table"], r["has_formula"]


def test_profiles(spark):
    links = f"<!-- srcmap:native-pdf-links page=1 -->\n**Native PDF links**\n- [a](<https://x/>)\n- [b](<https://y/>)"
    assert profile(spark, f"one two\n\n{links}\n\nafter the list") == (5, False, False)
    assert profile(spark, "inline $x+y$ here") == (4, False, True)
    assert profile(spark, r"costs \$5 and \$6") == (4, False, False)
    assert profile(spark, "![a](b) kept words\n![gone](c)\n  > no\n    # four blanks") == (6, False, False)


def proposal(spark, change=lambda p: None):
    page = {"page_number": 1}
    p = {"schema_version": "1.0", "page": page, "paragraphs": [{"text": "p", "page": page, "confidence": 0.9}], "formulas": [{"source_text": "a  b", "latex": "ab", "page": page, "confidence": 1}], "tables": [{"title": "t", "headers": ["h", "i"], "rows": [["1", "2"]], "page": page, "confidence": 0.9}], "captions": [{"text": "c", "target_hint": "x", "page": page, "confidence": 0.9}]}
    p = json.loads(json.dumps(p))
    change(p)
    rows = spark.createDataFrame([("d", 1, json.dumps(p))], "doc_id string, page_number int, json string")
    return V.validate(rows, spark.createDataFrame([("d", 1, "x a b y")], "doc_id string, page_number int, text string"))


def test_proposals(spark):
    code = lambda change: proposal(spark, change).first()["code"]
    assert proposal(spark).first()["code"] is None
    assert code(lambda p: p["paragraphs"][0].update(more=1)) == V.INVALID
    assert code(lambda p: p["captions"][0].pop("target_hint")) is None and code(lambda p: p["captions"][0].pop("text")) == V.INVALID
    assert code(lambda p: p["tables"][0].update(title=" ")) == V.INVALID and code(lambda p: p["tables"][0].pop("title")) is None
    assert code(lambda p: p["page"].update(more=2)) == V.INVALID and code(lambda p: p["formulas"][0]["page"].update(more=2)) == V.UNVERIFIABLE
    assert code(lambda p: p["tables"][0].update(rows=[["1"]])) == V.UNVERIFIABLE and code(lambda p: p["formulas"][0].update(source_text="z")) == V.UNVERIFIABLE
    assert code(lambda p: p["paragraphs"][0].update(confidence=0.5)) == V.LOW and code(lambda p: p["paragraphs"][0].update(confidence=True)) == V.INVALID
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page_number int")
    assert [(r["page_number"], r["accepted"]) for r in V.accepted_pages(pages, proposal(spark)).orderBy("page_number").collect()] == [(1, True), (2, False)]
    assert V.review(proposal(spark)).first()["markdown"] == "- page 1: accepted"
    tables = proposal(spark).select(V.merge_tables(F.lit("text"), F.col("proposal.tables"))).first()[0]
    assert tables == "text\n\n**t**\n\n| h | i |\n| --- | --- |\n| 1 | 2 |"


def test_needles_that_look_like_patterns(spark):
    df = spark.createDataFrame([("so \\E[X] = \\Q1", "\\E[X]", "m")], "t string, source string, latex string")
    got = df.select(D.occurs_once(F.col("t"), F.col("source")).alias("one"), V.merge_formulas(F.col("t"), F.array(F.struct(F.col("source").alias("source_text"), "latex"))).alias("text")).first()
    assert got["one"] and got["text"] == "so $$ m $$ = \\Q1"
    assert not df.select(D.occurs_once(F.col("t"), F.lit(""))).first()[0]


def test_links(spark):
    rows = [(0, "https://a/x", 0.0, 0.0, 1.0, 1.0), (1, "https://a/x", 1.0, 0.0, 1.0, 1.0), (2, "https://10.0.0.1/", 0.0, 0.0, 1.0, 1.0), (3, "ftp://a", None, 0.0, 1.0, 1.0), (4, "https://a/)", 0.0, 0.0, 1.0, float("nan"))]
    links = spark.createDataFrame([("d", 1, *r) for r in rows], "doc_id string, page_number int, link_idx int, uri string, left double, bottom double, right double, top double")
    got = K.target_kind(links)
    assert [r["target"] for r in got.orderBy("link_idx").collect()] == ["ok", "invalid", "local", "unsafe", "invalid"]
    assert {r["code"]: r["n"] for r in K.rejected_counts(got).collect()}["NATIVE_PDF_LINK_INVALID_ANNOTATION"] == 2
    assert "](<https://a/)>)" in K.render_links(links.where("link_idx = 4").withColumn("visible_title", F.lit("t"))).first()["markdown"]
    kinds = spark.createDataFrame([("/Link", None), ("Text", "u"), ("Text", None)], "subtype string, uri string")
    assert [r[0] for r in kinds.select(K.is_link(F.col("subtype"), F.col("uri"))).collect()] == [True, True, False]


WORDS = "doc_id string, page_number int, word_idx int, text string, x0 double, x1 double, top double, bottom double, font_size double"


def words(spark, items):
    return spark.createDataFrame([("d", 1, i, t, float(x), float(x + 20), float(y), float(y + s), float(s)) for i, (t, x, y, s) in enumerate(items)], WORDS)


def page(spark):
    return spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc_id string, page_number int, width double, height double")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


FORMULA = [("P(s", 215, 300, 10), ("t+1", 236, 302, 7), ("|", 257, 300, 10), ("h", 278, 300, 10), ("0", 299, 302, 7), (",…,s", 320, 300, 10), ("t", 341, 302, 7), (")", 362, 300, 10)]


def test_display_formulas(spark):
    find = lambda items: [r["latex"] for r in E.display_formulas(Y.group_lines(words(spark, items)), page(spark)).collect()]
    assert find(FORMULA) == ["P(s^{t+1} \\mid h_{0}, \\ldots, s_{t})"]
    assert find([(t, x - 200, y, s) for t, x, y, s in FORMULA]) == []  # not centred
    assert find([(t, x, y, 10) for t, x, y, s in FORMULA]) == []  # scripts as large as their bases
    assert find([("P(1", 215, 300, 10), *FORMULA[1:]]) == []
    seen = spark.createDataFrame([("d", 1, 0, "a → b", 280.0, 320.0), ("d", 1, 1, "a → b", 0.0, 40.0), ("d", 1, 2, "a b", 280.0, 320.0)], "doc_id string, page_number int, line_idx int, text string, x0 double, x1 double")
    assert [r["line_idx"] for r in Y.formula_candidates(seen, page(spark)).collect()] == [0]


def test_captions(spark):
    w = words(spark, [("Fig.", 50, 500, 10), ("1:", 75, 500, 10), ("left", 97, 500, 10), ("Fig.", 300, 500, 10), ("2:", 325, 500, 10), ("no", 50, 600, 10), ("caption", 75, 600, 10), ("Figure", 50, 700, 10), ("3", 75, 700, 10), ("below", 97, 700.04, 10)])
    got = E.caption_lines(Y.group_lines(w)).orderBy("caption_idx").collect()
    assert [(r["caption"], r["x0"]) for r in got] == [("Fig. 1: left", 50.0), ("Fig. 2:", 300.0)]
    images = spark.createDataFrame([("d", 1, 0, 680.0), ("d", 1, 1, 100.0), ("d", 1, 2, None)], "doc_id string, page_number int, image_idx int, bottom double")
    assert [(r["image_idx"], r["caption"]) for r in E.raster_captions(images, w).collect()] == [(0, "Figure 3 below")]
    assert [r["text"] for r in E.visible_lines(w).orderBy("line_id").collect()][:2] == ["Fig. 1: left", "Fig. 2:"]


def test_page_blocks(spark):
    items = [("Big", 50, 60, 20), ("one", 50, 100, 10), ("two", 75, 100, 10), ("three", 50, 112, 10), ("cell", 50, 150, 10), ("point", 50, 170, 10), *FORMULA, ("far", 50, 400, 10)]
    box = spark.createDataFrame([("d", 1, 0.0, 145.0, 600.0, 165.0)], "doc_id string, page_number int, x0 double, top double, x1 double, bottom double")
    shape = spark.createDataFrame([("d", 1, 0, 40.0, 44.0, 173.0, 177.0, True)], "doc_id string, page_number int, prim_idx int, x0 double, x1 double, top double, bottom double, fill boolean")
    got = E.page_blocks(words(spark, items), page(spark), box, shape).orderBy("block_idx").collect()
    assert [(r["kind"], r["text"], r["heading_level"]) for r in got] == [("heading", "Big", 1), ("paragraph", "one two three", None), ("list_item", "point", None), ("paragraph", "$$P(s^{t+1} \\mid h_{0}, \\ldots, s_{t})$$", None), ("paragraph", "far", None)]
    none = E.page_blocks(empty(spark, WORDS), page(spark).where("false"), box.where("false"), shape.where("false"))
    assert none.count() == 0


def test_ocr_lines(spark):
    rows = [("a", 0, 0, 20), ("b", 50, 9, 22), ("c", 0, 12, 24), ("d", 60, 21, 9)]
    df = spark.createDataFrame([("d", 1, i, t, x, y, 5, h, 90.0) for i, (t, x, y, h) in enumerate(rows)], "doc_id string, page_number int, word_idx int, text string, left int, top int, width int, height int, conf double")
    got = {r["text"]: r["line_idx"] for r in O.line_groups(df).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1}  # the upper median of the heights is 22, so a line holds 11 units


def test_figures_behind_their_captions(spark):
    pages = spark.createDataFrame([("d", 1, "x\n**Figure 2:** two\nlast"), ("d", 2, "Figure 1\nFigure 1"), ("d", 3, "as is\n")], "doc_id string, page_number int, content string")
    assets = spark.createDataFrame([("d", 1, 0, "Figure 2: two", "A"), ("d", 1, 1, "Figure 2: more", "B"), ("d", 1, 2, "last", "C"), ("d", 1, 3, None, "D"), ("d", 2, 0, "Fig. 1", "E")], "doc_id string, page_number int, ord int, caption string, markdown string")
    got = {r["page_number"]: r["content"] for r in E.insert_assets(pages, assets).collect()}
    assert got == {1: "x\n**Figure 2:** two\n\nB\n\nA\nlast\n\nC\n\nD\n", 2: "Figure 1\nFigure 1\n\nE\n", 3: "as is\n"}
    lists = spark.createDataFrame([("d", 1, "L"), ("d", 9, "L")], "doc_id string, page_number int, markdown string")
    got = {r["page_number"]: (r["content"], r["code"]) for r in E.insert_links(pages, lists).collect()}
    assert got[1][0].endswith("last\n\nL\n") and got[9] == (None, "CONTENT_WITHOUT_PAGE") and got[3] == ("as is\n", None)
    again = spark.createDataFrame([("d", 1, "<!-- srcmap:native-pdf-links page=1 -->")], "doc_id string, page_number int, content string")
    assert E.insert_links(again, lists.where("page_number = 1")).first()["code"] == "LINK_LIST_IN_MODEL_OUTPUT"


def test_image_references(spark):
    md = spark.createDataFrame([("d", "![a](x.png) <img class='b' SRC=\"y.png\"/> <!-- srcmap:asset=page-1 page=1 --><!-- srcmap:asset=gone page=2 -->")], "doc_id string, markdown string")
    assets = spark.createDataFrame([("d", "page-1", "x.png")], "doc_id string, asset_id string, relative_path string")
    assert [r["target"] for r in D.unauthorised_images(md, assets).collect()] == ["y.png"]
    assert [r["asset_id"] for r in D.dangling_assets(md, assets).collect()] == ["gone"]
    assert D.with_images(md).count() == 1 and D.with_images(md.withColumn("markdown", F.lit("none"))).count() == 0


def test_palettes(spark):
    schema = "doc_id string, page_number int, image_idx int, width int, height int, bits int, color_space string, filter string, raw binary, decoded binary, palette binary"
    n = 250 * 200
    rows = [("Indexed", bytes([0, 1, 2, 9]) + b"\1" * (n - 4), bytes([1, 2, 3, 4, 5, 6, 7, 8, 9])), ("Indexed", b"\0" * n, None), ("Indexed", b"\0" * n, b"12"), ("DeviceGray", b"\7" * n, None)]
    images = spark.createDataFrame([("d", 1, i, 250, 200, 8, space, "FlateDecode", b"", pixels, palette) for i, (space, pixels, palette) in enumerate(rows)], schema)
    kinds = G.image_kind(images)
    assert [r["kind"] for r in kinds.orderBy("image_idx").collect()] == ["png", "unsupported", "unsupported", "png"]
    files = {r["image_idx"]: bytes(r["file"]) for r in G.png_files(kinds).collect()}
    body = lambda f: zlib.decompress(f[f.index(b"IDAT") + 4 : f.index(b"IEND") - 8])
    assert body(files[0])[:13] == bytes([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 0, 0]) and len(body(files[0])) == 200 * (1 + 750)
    assert body(files[3]) == (b"\0" + b"\7" * 250) * 200


def test_responses(spark):
    good = {"status": "completed", "output_text": f"{marker(1)}\na"}
    cases = [(good, None), ({**good, "status": "incomplete"}, "CLOUD_RESPONSE_TRUNCATED"), ({**good, "status": "failed"}, "CLOUD_RESPONSE_NOT_COMPLETED"), ({**good, "incomplete_details": {"reason": "x"}}, "CLOUD_RESPONSE_INCOMPLETE"), ({"status": "completed"}, "CLOUD_MARKDOWN_MISSING"), ({**good, "output_text": " "}, "CLOUD_MARKDOWN_EMPTY")]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(cases)], "i int, r string")
    assert [r["c"] for r in df.select("i", D.response_code(F.col("r"), F.lit(1), F.lit(1)).alias("c")).orderBy("i").collect()] == [c for _, c in cases]


def test_results(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    w = spark.createDataFrame([("a", 1, "X", "info", "m"), ("a", 2, "Y", "error", "n"), ("a", None, "Z", "warning", "o")], "doc_id string, page_number int, code string, severity string, message string")
    assert {r["doc_id"]: r["status"] for r in C.run_status(docs, w).collect()} == {"a": "partial", "b": "success"}
    p = lambda *n: spark.createDataFrame([("a", x) for x in n], "doc_id string, page_number int")
    assert {r["page_number"] for r in C.without_drawn(w, p(1, 2), p(2)).collect()} == {2, None}
    assert C.of_pages(w, 1, 1).count() == 1
    pages = spark.createDataFrame([("a", 1, "one", None), ("a", 2, "two", "<pre/>")], "doc_id string, page_number int, content string, layout_html string")
    subset = lambda *n: tuple(C.page_subset(pages, p(*n)).first())[1:]
    assert subset(2, 1) == (["one", "two"], True) and subset(1, 3)[1] is False
    assert [r["page_number"] for r in C.without_scans(p(1, 2), pages).collect()] == [1]
    assert C.all_assets(p(1), p(2)).count() == 2
    assert sorted(r["severity"] for r in C.all_findings(w.where("severity <> 'error'"), w.where("severity = 'error'").drop("severity")).collect()) == ["error", "info", "warning"]
    found = {json.loads(r[0])["code"]: json.loads(r[0]) for r in w.select(C.finding_json(F.col("code"), F.col("message"), F.col("severity"), F.col("page_number"))).collect()}
    assert found["Y"] == {"code": "Y", "message": "n", "page": {"page_number": 2}} and found["Z"] == {"code": "Z", "message": "o", "severity": "warning"}
    run = spark.createDataFrame([("a", "success", None, True)], "doc_id string, conversion_status string, cloud_markdown_path string, reused boolean")
    assert json.loads(C.run_json(run).first()["json"]) == {"conversion_status": "success", "reused": True}
    assert json.loads(C.contract_json(run, "reused").first()["json"]) == {"reused": True}
    said = spark.createDataFrame([("queued",), ("odd",)], "s string").select(C.status_message(F.col("s"))).collect()
    assert said[0][0].startswith("The request") and said[1][0] == "Request: odd."
    assert "pages 3 to 5" in spark.range(1).select(C.instructions(F.lit(3), F.lit(5), F.lit(9))).first()[0]
    glyphs = spark.createDataFrame([("a", 1, "UNREADABLE_PDF_GLYPHS", "warning"), ("a", 2, "UNREADABLE_PDF_GLYPHS", "warning"), ("a", 3, "OCR_LOW_CONFIDENCE", "warning"), ("a", 3, "SOFT_HYPHEN_PRESERVED", "info")], "doc_id string, page_number int, code string, severity string")
    assert sorted(r["page_number"] for r in W.reader_warnings(glyphs, p(2)).collect()) == [2, 3]
    heads = p(1)
    assert [r["page_number"] for r in W.ocr_layout(pages, heads, p(1)).collect()] == [2]
    ordered = L.concat_in_order(glyphs.where("page_number = 3"), glyphs.where("page_number < 3")).orderBy("ord").collect()
    assert [r["page_number"] for r in ordered] == [3, 3, 1, 2]
    codes = spark.createDataFrame([(True, 0), (False, 2), (False, 0)], "e boolean, w int").select(L.exit_code(F.col("e"), F.col("w"))).collect()
    assert [r[0] for r in codes] == [2, 1, 0]
    counts = spark.createDataFrame([("a", 1, 5, 1), ("a", 2, -1, 1), ("a", 0, 1, 2), ("a", 3, 0, 3)], "doc_id string, page_number int, word_count int, column_count int")
    assert L.invalid_pages(counts).count() == 3
    assert [r["complete"] for r in L.expected_pages(p(1, 2)).collect()] == [True] and [r["complete"] for r in L.expected_pages(p(1, 3)).collect()] == [False]
    at = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05",), ("x+00:00",)], "t string").select(L.parse_timestamp(F.col("t")).isNotNull()).collect()
    assert [r[0] for r in at] == [True, False, False]


def test_configuration(spark):
    schema = "provider string, mode string, model_id string, endpoint string, render_dpi int, timeout_seconds int"
    cases = [(("none", "off", None, None, 144, 60), None), (("none", "auto", None, None, 144, 60), "MODE_WITHOUT_PROVIDER"), (("none", "off", "m", None, 144, 60), "OPTIONS_WITHOUT_PROVIDER"), (("local", "auto", "m", "http://h:1/", 144, 60), None), (("local", "auto", "m", "http://h/v1", 144, 60), "ENDPOINT_INVALID"), (("local", "auto", "m", None, 144, 60), "ENDPOINT_MISSING"), (("remote", "auto", None, None, 144, 60), "MODEL_MISSING"), (("remote", "auto", "m", "http://h", 144, 60), "ENDPOINT_NOT_ALLOWED"), (("none", "off", None, None, 71, 60), "RENDER_DPI"), (("none", "off", None, None, 600, 3601), "TIMEOUT")]
    rows = spark.createDataFrame([c for c, _ in cases], schema).coalesce(1)
    assert [r["code"] for r in C.vision_config_code(rows).collect()] == [code for _, code in cases]
    assert C.public_options(rows.withColumn("api_key", F.lit("s"))).columns == ["provider", "mode", "model_id", "render_dpi", "timeout_seconds", "endpoint"]
    cloud = [(("off", None, 900, 32768), None), (("off", "m", 900, 32768), "OPTIONS_WITHOUT_MODE"), (("on", "", 900, 32768), "MODEL_MISSING"), (("on", "m", 0, 32768), "TIMEOUT"), (("on", "m", 900, 1000), "MAX_OUTPUT_TOKENS")]
    rows = spark.createDataFrame([c for c, _ in cloud], "mode string, model_id string, timeout_seconds int, max_output_tokens int").coalesce(1)
    assert [r["code"] for r in C.cloud_config_code(rows).collect()] == [code for _, code in cloud]
    checks = spark.createDataFrame([(0.0,), (100.0,), (101.0,), (None,)], "c double").select(C.confidence_ok(F.col("c"))).collect()
    assert [r[0] for r in checks] == [True, True, False, False]
    paths = spark.createDataFrame([("/in/a.pdf", "/out", "/out/a.md"), ("/in/a.pdf", "/in", "/in//a.pdf"), ("/in/a", "/out", "/out/../x"), ("/in/a", "/out", "/else/x")], "source string, output_dir string, target string").coalesce(1)
    assert [r["code"] for r in C.path_code(paths).collect()] == [None, "TARGET_IS_SOURCE", "TARGET_OUTSIDE", "TARGET_OUTSIDE"]


def test_saved_state(spark):
    plan = [{"batch_id": "b1", "page_numbers": [1, 2]}, {"batch_id": "b2", "page_numbers": [3]}]
    good = {"schema_version": "1.0", "source_sha256": "s", "local_markdown_sha256": "l", "model_id": "m", "prompt_version": "p", "started_at": "2024-01-01T00:00:00+00:00", "plan": plan, "entries": [{**plan[0], "response_id": "r", "markdown": "x", "telemetry": {"t": 1}}, plan[1]]}

    def state(change):
        s = json.loads(json.dumps(good))
        change(s)
        return json.dumps(s)

    cases = [(state(lambda s: None), True), (state(lambda s: s["entries"].pop()), False), (state(lambda s: s["entries"].reverse()), False), (state(lambda s: s["entries"][0].pop("telemetry")), False), (state(lambda s: s["entries"][0].update(response_id="")), False), (state(lambda s: s.update(started_at="x")), False), (state(lambda s: s["plan"][0].update(page_numbers=[0])), False), ("{", False), (state(lambda s: s.update(schema_version="2")), False)]
    rows = spark.createDataFrame([(f"d{i}", t) for i, (t, _) in enumerate(cases)], "doc_id string, json string")
    got = {r["doc_id"]: r["state"] is not None for r in C.saved_state(rows).collect()}
    assert got == {f"d{i}": ok for i, (_, ok) in enumerate(cases)}
    runs = spark.createDataFrame([("d0", "s", "l", "m", "p", [("b1", [1, 2]), ("b2", [3])]), ("d0", "s", "l", "m", "p2", [("b1", [1, 2]), ("b2", [3])]), ("d9", "s", "l", "m", "p", [("b1", [1])])], "doc_id string, source_sha256 string, local_markdown_sha256 string, model_id string, prompt_version string, plan array<struct<batch_id:string,page_numbers:array<int>>>")
    assert [r["state"] is not None for r in C.matching_state(rows, runs).orderBy("doc_id", "prompt_version").collect()] == [True, False, False]
    order = spark.createDataFrame([("d", 1, "b1"), ("d", 2, "b2"), ("e", 1, "b1")], "doc_id string, batch_no int, batch_id string")
    parts = spark.createDataFrame([("d", "b2", "two"), ("d", "b1", "one"), ("e", "bx", "?")], "doc_id string, batch_id string, markdown string")
    got = {r["doc_id"]: (r["markdown"], r["code"]) for r in C.merge_in_plan_order(order, parts).collect()}
    assert got == {"d": ("one\n\ntwo\n", None), "e": (None, "BATCHES_DIFFER_FROM_PLAN")}


def test_reuse(spark):
    md = f"{marker(1)}\na\n\n{marker(2)}\nb"
    base = {"schema_version": "1.0", "markdown": md, "markdown_sha256": hashlib.sha256(md.encode()).hexdigest(), "page_numbers": [1, 2], "assets": [("f", "assets/f.png", 1)], "references": [("asset", 2, "f"), ("text", 1, None)], "quality": ("warning", [("W", "warning", 1)], [])}
    other = f"{marker(1)}\na\n\n{marker(3)}\nb"
    cases = [({}, None), ({"schema_version": "2"}, "VERSION"), ({"markdown": md + " "}, "MARKDOWN_CHANGED"), ({"markdown": other, "markdown_sha256": hashlib.sha256(other.encode()).hexdigest()}, "PAGE_MARKERS"), ({"assets": base["assets"] * 2}, "ASSET_NOT_UNIQUE"), ({"assets": [("f", "../f.png", 1)]}, "ASSET_INVALID"), ({"references": [("other", 1, None)]}, "REFERENCE_INVALID"), ({"references": [("asset", 1, "g")]}, "REFERENCE_UNKNOWN_ASSET"), ({"quality": ("ok", [("W", "warning", 1)], [])}, "QUALITY_STATUS"), ({"quality": ("warning", [("W", "warning", 9)], [])}, "FINDING_INVALID")]
    finding = "struct<code:string,severity:string,page_number:int>"
    schema = f"doc_id int, schema_version string, markdown string, markdown_sha256 string, page_numbers array<int>, assets array<struct<asset_id:string,path:string,page_number:int>>, references array<struct<kind:string,page_number:int,asset_id:string>>, quality struct<status:string,warnings:array<{finding}>,errors:array<{finding}>>"
    rows = spark.createDataFrame([(i, *{**base, **change}.values()) for i, (change, _) in enumerate(cases)], schema)
    assert {r["doc_id"]: r["code"] for r in C.reuse_code(rows).collect()} == {i: code for i, (_, code) in enumerate(cases)}


def test_progress():
    out, said = io.StringIO(), []
    C.Progress("human", out)("read", "started", "Reading.")
    C.Progress("jsonl", out, callback=lambda *x: said.append(x))("read", "completed", "Read.")
    C.Progress("none", out)("read", "x", "silent")
    first, second = out.getvalue().splitlines()
    assert first.endswith("Reading.") and json.loads(second)["phase"] == "read" and said == [("read", "completed", "Read.")]
    with pytest.raises(ValueError):
        C.Progress("loud")
