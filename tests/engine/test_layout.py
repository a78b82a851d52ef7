import random

import pytest

from pagemill.operators import figures as G
from pagemill.operators import layout as Y
from pagemill.operators import lifecycle as L
from pagemill.operators import links as K
from pagemill.operators import ocr as O
from pagemill.operators import tables as T
from pagemill.operators import vision as V

WORDS = "doc_id string, page_number int, word_idx int, text string, x0 double, x1 double, top double, bottom double, font_size double"


def words(spark, items, page=1):
    return spark.createDataFrame([("d", page, i, t, float(x), float(x + w), float(top), float(top + 10), size) for i, (t, x, top, w, size) in enumerate(items)], WORDS)


def geometry(spark, w=600.0, h=800.0):
    return spark.createDataFrame([("d", 1, w, h)], "doc_id string, page_number int, width double, height double")


def boxes(spark, *items):
    return spark.createDataFrame([("d", 1, *map(float, b)) for b in items], "doc_id string, page_number int, x0 double, top double, x1 double, bottom double")


def order(spark, items, *b):
    lined = Y.group_lines(words(spark, items))
    got = Y.reading_order(lined, geometry(spark), boxes(spark, *b)).orderBy("ord").collect()
    return [r["text"] for r in got], got[0]["column_count"]


def test_anchored_lines(spark):
    items = [("w", 10 * i, top, 5, None) for i, top in enumerate((1.0, 1.8, 2.6, 3.4))]
    got = Y.group_lines(words(spark, items), tolerance=1).orderBy("word_idx").collect()
    assert [r["line_idx"] for r in got] == [0, 0, 1, 1]


def test_two_columns(spark):
    items = [("title", 280, 20, 40, None)] + [(f"L{i}", 70, 80 + 20 * i, 20, None) for i in (1, 2, 3)] + [(f"R{i}", 370, 80 + 20 * i, 20, None) for i in (1, 2, 3)]
    random.Random(0).shuffle(items)
    assert order(spark, items) == (["title", "L1", "L2", "L3", "R1", "R2", "R3"], 2)


def test_prose_over_the_middle_stays(spark):
    items = [(f"w{i}{j}", 200 + 30 * j, 100 + 20 * i, 28, None) for i in range(3) for j in range(7)]
    texts, n = order(spark, items)
    assert n == 1 and texts == [" ".join(f"w{i}{j}" for j in range(7)) for i in range(3)]


def test_header_and_footer(spark):
    items = [("h1", 70, 20, 20, None), ("h2", 370, 55, 20, None), ("foot", 70, 760, 20, None)] + [(f"{s}{i}", x, 120 + 20 * i, 20, None) for s, x in (("L", 70), ("R", 370)) for i in range(3)]
    assert order(spark, items) == (["h1", "h2", "L0", "L1", "L2", "R0", "R1", "R2", "foot"], 2)


def test_table_rows_are_no_columns(spark):
    items = [(f"{s}{i}", x, 140 + 20 * i, 20, None) for s, x in (("a", 70), ("b", 370)) for i in range(3)]
    assert order(spark, items, (50, 130, 550, 190)) == (["a0 b0", "a1 b1", "a2 b2"], 1)


def test_headings_by_size(spark):
    items = [("Title", 10, 10, 30, 18.0), ("Sub", 10, 40, 30, 14.0)] + [(f"t{i}", 10, 60 + 20 * i, 20, 10.0) for i in range(5)] + [("a=b", 10, 300, 20, 18.0)]
    got = Y.typographic_headings(Y.lines(Y.group_lines(words(spark, items)))).collect()
    assert {r["text"]: r["level"] for r in got} == {"Title": 1, "Sub": 2}


def test_bullets_and_gaps(spark):
    rows = Y.lines(Y.group_lines(words(spark, [("one", 60, 100, 30, None), ("two", 60, 120, 30, None), ("far", 60, 160, 30, None)])))
    shapes = spark.createDataFrame([("d", 1, 0, 50.0, 103.0, 54.0, 107.0, True), ("d", 1, 1, 50.0, 123.0, 54.0, 127.0, False), ("d", 1, 2, 50.0, 140.0, 54.0, 144.0, True)], "doc_id string, page_number int, prim_idx int, x0 double, top double, x1 double, bottom double, fill boolean")
    assert [r["line_idx"] for r in Y.graphic_bullets(shapes, rows).collect()] == [0]
    assert [r["text"] for r in Y.paragraph_gaps(rows).where("gap_before").collect()] == ["far"]


def test_tables(spark):
    good = [["a", "b"], ["1", " x \n\n y "]]
    raw = [("d", 1, 1, good), ("d", 2, 1, [["a", "b"], ["3", "4"]]), ("d", 2, 2, [["a", "b"], ["5", "6"]]), ("d", 3, 1, [["a"], ["1"]]), ("d", 4, 1, [["a", "b"], ["1", None]]), ("d", 4, 2, [["a", "b"], ["(cid:1)", "2"]]), ("d", 5, 1, [["a", "b"], ["1"]])]
    t = T.normalize_tables(spark.createDataFrame(raw, "doc_id string, page_number int, table_number int, cells array<array<string>>"))
    assert {(r["page_number"], r["n"]) for r in T.rejected_counts(t).collect()} == {(3, 1), (4, 2), (5, 1)}
    got = {r["table_id"]: (r["headers"], r["rows"]) for r in T.merge_adjacent(t).collect()}
    assert got == {"page-001-table-01": (["a", "b"], [["1", "x<br>y"], ["3", "4"]]), "page-002-table-02": (["a", "b"], [["5", "6"]])}


def test_links(spark):
    urls = {"http://a/": "unsafe", "file:///a": "unsafe", "https://localhost/": "local", "https://127.0.0.1/": "local", "https://a b/": "unsafe", "https://ok.org/x": "ok", "https://10.1.2.3:80/": "local", "https://[::1]/": "local", "https://u:p@h/": "unsafe", "https://h:abc/": "unsafe", "https:///x": "unsafe", "https://h.:443/": "ok", None: "unsafe"}
    got = K.target_kind(spark.createDataFrame([(u,) for u in urls], "uri string")).collect()
    assert {r["uri"]: r["target"] for r in got} == urls


def strokes(spark, *groups):
    rows = [("d", 1, i, float(x0 + (x1 - x0) * (i % 5) / 5), 250.0 + 45 * (i % 5), float(x0 + (x1 - x0) * (i % 5 + 1) / 5), 300.0 + 45 * (i % 5)) for g, (x0, x1) in enumerate(groups) for i in range(5 * g, 5 * g + 5)]
    return G.components(G.boxes(spark.createDataFrame(rows, "doc_id string, page_number int, prim_idx int, x0 double, top double, x1 double, bottom double")))


def captions(spark, *items):
    return spark.createDataFrame([("d", 1, i, t, float(x), float(x + 180), float(top), float(top + 10)) for i, (t, x, top) in enumerate(items)], "doc_id string, page_number int, caption_idx int, caption string, x0 double, x1 double, top double, bottom double")


@pytest.mark.parametrize("groups,caps,want", [([(72, 430)], [("Fig. 1: a", 72, 500)], ["Fig. 1: a"]), ([(72, 430)], [("Fig. 1: a", 72, 500), ("Fig. 2: b", 72, 200)], ["Fig. 1: a"]), ([(72, 270), (340, 540)], [("Fig. 1: a", 72, 500), ("Fig. 2: b", 340, 500)], ["Fig. 1: a", "Fig. 2: b"]), ([(72, 270), (340, 540)], [("Fig. 1: a", 200, 500)], []), ([(72, 430)], [("Fig. 1: a", 72, 500), ("Fig. 2: b", 240, 500)], [])])
def test_vector_figures(spark, groups, caps, want):
    c = captions(spark, *caps)
    got = G.figure_candidates(strokes(spark, *groups), c, c.select("doc_id", "page_number", "x0", "x1", "top", "bottom"), geometry(spark, 612.0, 792.0)).collect()
    assert sorted(r["caption"] for r in got) == want


def test_png(spark):
    import struct
    import zlib

    raw = bytes(range(12))
    out = bytes(spark.createDataFrame([(2, 2, 3, raw)], "w int, h int, c int, p binary").select(G.png("w", "h", "c", "p")).first()[0])
    assert out.startswith(b"\x89PNG") and struct.unpack(">II", out[16:24]) == (2, 2)
    at = out.index(b"IDAT")
    assert zlib.decompress(out[at + 4 : at + 4 + struct.unpack(">I", out[at - 4 : at])[0]]) == b"\0" + raw[:6] + b"\0" + raw[6:]


def test_ocr(spark):
    tsv = "head\n" + "\n".join("\t".join(x) for x in (["5", *"11111", "0", "0", "30", "10", "95", "Hello"], ["5", *"11111", "60", "0", "30", "10", "92", "world"], ["4", *"11111", "0", "0", "1", "1", "-1", ""], ["5", *"11111", "0", "0", "x", "10", "9", "bad"]))
    pages = spark.createDataFrame([("d", 1, tsv), ("d", 2, "head")], "doc_id string, page_number int, tsv string")
    w = O.parse_tsv(pages)
    assert [(r["text"], r["conf"]) for r in w.orderBy("word_idx").collect()] == [("Hello", 95.0), ("world", 92.0)]
    got = {r["page_number"]: (r["word_count"], r["confidence"], r["code"]) for r in O.confidence(w, pages, 94.0).collect()}
    assert got == {1: (2, 93.5, "OCR_LOW_CONFIDENCE"), 2: (0, None, None)}
    assert O.positioned_text(w.withColumn("line_idx", w["top"])).first()["text"] == "Hello     world"
    p = spark.createDataFrame([("a", 1, "", 0), ("a", 2, "x", 1), ("b", 1, "", 0)], "doc_id string, page_number int, text string, word_count int")
    o = spark.createDataFrame([(d, 1, "new text") for d in "ab"], "doc_id string, page_number int, text string")
    assert {(r["doc_id"], r["page_number"]): r["word_count"] for r in O.fallback(p, o, "auto").collect()} == {("a", 1): 0, ("a", 2): 1, ("b", 1): 2}
    assert O.fallback(p, o, "off") is p and sum(r["word_count"] for r in O.fallback(p, o, "force").collect()) == 5


def test_resume_and_conflicts(spark):
    plan = spark.createDataFrame([("d", b, [1]) for b in ("done", "open", "none", "bad", "moved")], "doc_id string, batch_id string, pages array<int>")
    state = spark.createDataFrame([("d", "done", [1], "r", "m", True), ("d", "open", [1], "r", None, None), ("d", "bad", [1], "r", "m", False), ("d", "moved", [2], "r", "m", True)], "doc_id string, batch_id string, pages array<int>, response_id string, markdown string, valid boolean")
    assert {r["batch_id"]: r["action"] for r in L.resume_actions(plan, state).collect()} == {"done": "reuse", "open": "resume", "none": "start", "bad": "retry", "moved": "start"}
    parts = spark.createDataFrame([("d", 2, " b\n"), ("d", 1, "a")], "doc_id string, batch_no int, markdown string")
    assert L.merge_batches(parts).first()["markdown"] == "a\n\nb\n"


def test_vision(spark):
    text = "the sum  of parts"
    item = '"page":{"page_number":1},"confidence":%s'
    base = '{"schema_version":"1.0","page":{"page_number":1},"paragraphs":[%s],"formulas":[%s],"tables":[%s],"captions":[]}'
    formula = lambda s, l="x", c="0.9": f'{{"source_text":"{s}","latex":"{l}",{item % c}}}'  # noqa: E731, E741
    cases = {
        base % ("", formula("sum of"), ""): None, base % ("", formula("nowhere"), ""): "VISION_UNVERIFIABLE_CONTENT", base % ("", formula("sum of", "\\\\input x"), ""): "VISION_UNVERIFIABLE_CONTENT",
        base % ("", formula("sum of", c="0.5"), ""): "VISION_LOW_CONFIDENCE", base % (f'{{"text":" ",{item % "1"}}}', "", ""): "VISION_INVALID_JSON", "[]": "VISION_INVALID_JSON", "not json": "VISION_INVALID_JSON",
        base % ("", "", f'{{"headers":["a","b"],"rows":[["1"]],{item % "1"}}}'): "VISION_UNVERIFIABLE_CONTENT", base % ("", "", f'{{"headers":["a","b"],"rows":[["1","2"]],{item % "1"}}}'): None,
    }
    p = spark.createDataFrame([("d", 1, j) for j in cases], "doc_id string, page_number int, json string")
    pages = spark.createDataFrame([("d", 1, text)], "doc_id string, page_number int, text string")
    assert {r["json"]: r["code"] for r in V.validate(p, pages).collect()} == cases
    m = spark.createDataFrame([("a b a", [("b", "\\beta"), ("a", "y")])], "t string, f array<struct<source_text:string,latex:string>>")
    assert m.select(V.merge_formulas(m["t"], m["f"])).first()[0] == "a $$ \\beta $$ a"


def test_ocr_text_holds_all_words(spark, tmp_path):
    from pagemill.plans import layout

    words = [f"w{i}" for i in range(150)]
    spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["page_number"]): " ".join(str(x) for x in r) for r in layout.ocr_positioned_text(spark, str(tmp_path)).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (3, 1)]
    for i, w in enumerate(words):
        k = i % 60
        assert (k % 9 == 8 or k % 13 == 12 or k % 7 == 6) != (w in got[1, i // 60 + 1].replace("<", " ").replace(">", " ").split())


def test_broken_durations_do_not_count(spark, tmp_path):
    import duckdb

    from pagemill.plans import lifecycle

    rows = [(9, 1), (56, 1), (57, 1), (18, 2), (27, 2), (58, 3), (36, 3), (54, 4), (8, 5), (7, 5), (51, 5)]  # each ninth one has no end
    spark.createDataFrame(rows, "event_id long, user_id long").selectExpr("event_id", "user_id", "timestamp_seconds(event_id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in lifecycle.telemetry_rollup(spark, str(tmp_path)).collect()]
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = db.sql(lifecycle.ORACLES["telemetry_rollup"]).fetchall()
    assert sorted(got) == sorted(want)
    assert {r[0]: r[2:5] for r in got} == {1: (3000, 1000, 2000), 2: (None, None, None), 3: (3000, None, None), 4: (None, None, None), 5: (5000, 0, 3000)}


def test_layouts_in_one_pass(spark):
    rng = random.Random(4)
    number = lambda: rng.choice([str(rng.randint(0, 90)), str(rng.randint(-9, 9)), " 7 ", "+3", "x", "1.5", "", "9999999999", "21474"] if rng.random() < 0.15 else [str(rng.randint(0, 600))])
    conf = lambda: rng.choice(["95", "9.5", "1e2", "nan", " inf", "-1", "n/a", "", ".", "5d", "0x1p3", "1_0"] if rng.random() < 0.3 else ["96.5"])
    text = lambda: rng.choice(["a", "<b>", "&", " two words ", " ", "\U0001f600x", "", "tab\tin", "end　", "\x1fz"] if rng.random() < 0.3 else ["word" * rng.randint(1, 3)])
    row = lambda: "\t".join([rng.choice("55555554"), *"11111", number(), number(), number(), rng.choice(["10", "12", "30", number()]), conf(), text()][: rng.choice([12] * 15 + [11])])
    rows = [(f"d{d}", p, "head" + "".join(rng.choice(["\n", "\r\n", " "]) + row() for _ in range(rng.randint(0, 60)))) for d in range(12) for p in range(5)]
    pages = spark.createDataFrame([*rows, ("e", 1, None), ("e", 2, ""), ("e", 3, "head\n")], "doc_id string, page_number int, tsv string")
    words = O.parse_tsv(pages).localCheckpoint()
    want = sorted(tuple(r) for r in O.layout_html(O.positioned_text(O.line_groups(words))).collect())
    assert sorted(tuple(r) for r in O.page_layouts(pages).collect()) == want
    assert len(want) > 45


def test_ocr_layout_parses_its_pages_once(spark, tmp_path):
    from pagemill.plans import layout

    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = layout.ocr_positioned_text(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
