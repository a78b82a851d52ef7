from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import blocks as B
from pagemill.operators import derivatives as D
from pagemill.operators import findings as W
from pagemill.operators import references as R


def blocks_of(spark, pages):
    df = spark.createDataFrame([("d", n, t) for n, t in pages], "doc_id string, page_number int, text string")
    return B.build_blocks(B.classify(B.lines_of(df)))


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("page_number", "block_idx").select(*cols).collect()]


def test_mixed_blocks(spark):
    b = blocks_of(spark, [(4, "1 Title\nText one\nText two\n- item\n2. item\n2.1 Sub\ntext")])
    assert rows(b, "kind", "text", "heading_level", "ordered") == [
        ("heading", "1 Title", 1, None), ("paragraph", "Text one Text two", None, None), ("list_item", "item", None, False),
        ("list_item", "item", None, True), ("heading", "2.1 Sub", 2, None), ("paragraph", "text", None, None),
    ]


def test_wrapped_list_items(spark):
    b = blocks_of(spark, [(1, "1. a\nb\n2. c\nd")])
    assert rows(b, "text") == [("a b",), ("c d",)]
    assert B.render_blocks(b).first()["markdown"] == "1. a b\n2. c d"


def test_gap_ends_a_list(spark):
    assert rows(blocks_of(spark, [(1, "1. a\n\ntext")]), "kind") == [("list_item",), ("paragraph",)]


def test_table_lines_are_no_gap(spark):
    lines = [(0, "1. a", False), (1, "", False), (2, "| x |", True), (3, "goes on", False), (4, "| y |", True), (5, "and on", False)]
    df = spark.createDataFrame([("d", 1, *x) for x in lines], "doc_id string, page_number int, line_idx int, line string, is_table boolean")
    assert rows(B.build_blocks(B.classify(df)), "text") == [("a goes on and on",)]


def test_unmerged_run_stays_unmerged(spark):
    lines = [(0, "1. a", False), (1, "", False), (2, "para", False), (3, "| y |", True), (4, "more", False)]
    df = spark.createDataFrame([("d", 1, *x) for x in lines], "doc_id string, page_number int, line_idx int, line string, is_table boolean")
    assert rows(B.build_blocks(B.classify(df)), "kind", "text") == [("list_item", "a"), ("paragraph", "para"), ("paragraph", "more")]


def test_soft_hyphen(spark):
    assert rows(blocks_of(spark, [(1, "foo­\n  bar\nbaz")]), "text") == [("foobar baz",)]


def test_geometry_wins(spark):
    df = spark.createDataFrame([("d", 1, 0, "Big", 3, None, None), ("d", 1, 1, "E = x", None, "E = x", None), ("d", 1, 2, "point", None, None, True)], "doc_id string, page_number int, line_idx int, line string, typographic_level int, formula string, is_bullet boolean")
    assert rows(B.build_blocks(B.classify(df)), "kind", "text", "heading_level", "ordered") == [("heading", "Big", 3, None), ("paragraph", "$$E = x$$", None, None), ("list_item", "point", None, False)]


def test_numbers_run_over_pages(spark):
    b = blocks_of(spark, [(1, "1. a\n2. b"), (2, "9. c\n- x\n4. d")])
    assert [r[0] for r in rows(B.number_list_items(b), "number")] == [1, 2, 3, None, 1]
    cont = blocks_of(spark, [(1, "- a"), (2, "text\n- b")])
    assert {r["page_number"]: r["continues"] for r in B.list_continuations(cont).collect()} == {1: False, 2: True}


def test_split_is_the_inverse_of_render(spark):
    pages = spark.createDataFrame([("d", n, f"body {n}\n\ntext") for n in (1, 2, 3)], "doc_id string, page_number int, markdown string")
    back = D.split_pages(B.render_pages(pages)).orderBy("page_number").collect()
    assert [(r["page_number"], r["content"].strip()) for r in back] == [(n, f"body {n}\n\ntext") for n in (1, 2, 3)]


def test_formula(spark):
    df = spark.createDataFrame([("d", 1, 0, "paragraph", "mean_a(k) = sum_t q * v_t / size"), ("d", 1, 1, "paragraph", "y = a + b"), ("d", 1, 2, "heading", "y = a")], "doc_id string, page_number int, block_idx int, kind string, text string")
    got = rows(W.render_formulas(df), "rendered", "code")
    assert got == [("$$mean_a(k) = \\frac{\\sum_t q v_t}{size}$$", None), ("y = a + b", "FORMULA_NOT_RECONSTRUCTED"), ("y = a", None)]


def test_normalisation(spark):
    texts = ["a\r\nb\rc", "é", "x�", "a­b", "word- break", "a - b", "a -- b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: (r["normalized"], r["transformations"], r["codes"]) for r in W.normalize(df).collect()}
    assert got[0] == ("a\nb\nc", ["line_endings_to_lf"], []) and got[1] == ("é", ["unicode_nfc"], [])
    assert [got[i][2] for i in range(2, 7)] == [["TEXT_REPLACEMENT_CHARACTER"], ["SOFT_HYPHEN_PRESERVED"], ["POSSIBLE_HYPHENATION_PRESERVED"], [], []]


def test_references(spark):
    b = spark.createDataFrame([("d", 1, 0, "see [1] and [^2], Figure 1, Table 1"), ("d", 3, 0, "[^2]: note"), ("d", 4, 0, "[1] Entry"), ("d", 5, 0, "Figure 2 and [7]")], "doc_id string, page_number int, block_idx int, text string")
    t = spark.createDataFrame([("d", "figure", 0, "f", 3), ("d", "table", 0, "t", 4)], "doc_id string, kind string, ord int, id string, page_number int")
    got = {(r["page_number"], r["kind"], r["label"]): (r["target_page"], r["target_id"]) for r in R.references(b, t).collect()}
    assert got == {(1, "citation", "1"): (4, None), (1, "footnote", "2"): (3, None), (1, "figure", "1"): (3, "f"), (1, "table", "1"): (4, "t"), (5, "figure", "2"): (None, None), (5, "citation", "7"): (None, None)}


def plan(spark, pages):
    return D.plan_batches(spark.createDataFrame([("d", n, c, x) for n, c, x in pages], "doc_id string, page_number int, chapter_start boolean, dense boolean")).orderBy("batch_no").collect()


def test_batches(spark):
    got = plan(spark, [(n, False, False) for n in range(1, 14)])
    assert [r["pages"] for r in got] == [list(range(1, 7)), list(range(7, 13)), [13]] and got[0]["batch_id"] == "batch-001-pages-001-006"
    assert [r["pages"] for r in plan(spark, [(n, n in (1, 4), False) for n in range(1, 6)])] == [[1, 2, 3], [4, 5]]
    got = plan(spark, [(n, False, n in (2, 3)) for n in range(1, 5)])
    assert [r["pages"] for r in got] == [[1, 2], [3, 4]] and [r["dense_pages"] for r in got] == [[2], [3]]


def test_chapter_headings(spark):
    texts = ["# Chapter", "# Running 2", "# 3 Head", "# A . . . 9", "# ab", "### Deep", "# (cid:1) bad", "x $$a$$ $$b$$", "| --- | --- |"]
    p = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_number int, content string")
    got = D.batch_profiles(p).orderBy("page_number").collect()
    assert [r["chapter_start"] for r in got] == [True, *[False] * 8] and [r["dense"] for r in got] == [*[False] * 7, True, True]


def profile(spark, local, cloud):
    one = lambda t: spark.createDataFrame([("d", 1, t)], "doc_id string, page_number int, content string")
    return [r["problem"] for r in D.completeness(one(local), one(cloud)).collect()]


def test_completeness(spark):
    assert profile(spark, "one two three four five six", "# one two three\n> callout here") == ["too_few_words"]
    assert profile(spark, "| a | b |\n| --- | --- |\n| 1 | 2 |", "a b 1 2") == ["table_missing"]
    assert profile(spark, "$$x$$", "x") == ["formula_missing"]
    assert profile(spark, "", "> callout") == [] and profile(spark, "a b", "a b") == []


def test_table_count_pairs_markers(spark):
    t = "<!-- srcmap:table=page-001-table-01 page=1 -->\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n| c | d |\n| --- | --- |\n\n<!-- srcmap:table=page-001-table-02 page=1 -->\nno table"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(D.table_count(F.col("t"))).first()[0] == 3


def test_choice_and_readiness(spark):
    md = lambda t: spark.createDataFrame([("d", t)], "doc_id string, markdown string")
    assert D.choose(md("text"), md("$$x$$")).first()["selected"] == "cloud"
    assert D.choose(md("# a"), md("# b")).first()["reason"] == "local_structure_is_equal_or_better"
    docs = spark.createDataFrame([("a", "local"), ("b", "local"), ("c", "cloud"), ("e", "local")], "doc_id string, selected string")
    w = spark.createDataFrame([("b", "MULTI_COLUMN_LAYOUT", 1), ("c", "MULTI_COLUMN_LAYOUT", 1), ("e", "UNREADABLE_PDF_GLYPHS", None), ("a", "SOFT_HYPHEN_PRESERVED", 1)], "doc_id string, code string, page_number int")
    got = {r["doc_id"]: (r["status"], r["next_step"], r["steps"]) for r in W.readiness(docs, w).collect()}
    assert got == {"a": ("ready", "none", []), "b": ("local_not_suitable", "cloud_document", ["cloud_document"]), "c": ("review_required", "review_recommended_derivative", ["review_recommended_derivative"]), "e": ("local_not_suitable", "cloud_document", ["force_ocr", "cloud_document"])}
    steps = spark.createDataFrame([(["force_ocr"],)], "s array<string>")
    assert steps.select(W.next_step(F.lit("local_not_suitable"), F.col("s"))).first()[0] == "force_ocr"


def test_markers(spark):
    good = "<!-- srcmap:page=1 -->\na\n\n<!-- srcmap:page=2 -->\nb"
    cases = {"": "CLOUD_MARKDOWN_EMPTY", good + "<iframe>": "CLOUD_MARKDOWN_FORBIDDEN_OUTPUT", good.replace("=2", "=3"): "CLOUD_MARKDOWN_PAGE_MARKERS", "x\n" + good: "CLOUD_MARKDOWN_FIRST_PAGE", "<!-- srcmap:page=1 -->": "CLOUD_MARKDOWN_PAGE_COUNT", good: None, good.replace("\nb", " b"): "CLOUD_MARKDOWN_PAGE_MARKERS"}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r["m"]: r["c"] for r in df.select("m", D.marker_code(F.col("m"), F.lit(1), F.lit(2)).alias("c")).collect()} == cases


def test_page_extras_and_links_once(spark):
    pages = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "doc_id string, page_number int, content string")
    extra = spark.createDataFrame([("d", 2, 1, "y"), ("d", 2, 0, "x")], "doc_id string, page_number int, ord int, text string")
    assert [r["content"] for r in D.insert_at_page(pages, extra, at_end=True).orderBy("page_number").collect()] == ["a", "b\n\nx\n\ny"]
    one = spark.createDataFrame([("a.b a+b", "a.b"), ("xx", "x"), ("y", "x")], "m string, n string")
    assert [r[0] for r in one.select(D.occurs_once(F.col("m"), F.col("n"))).collect()] == [True, False, False]
    broken = spark.createDataFrame([("d", 0, 1), ("d", 1, 3), ("d", 2, 2)], "doc_id string, ord int, page_number int")
    assert [r["ord"] for r in D.orders_broken(broken).collect()] == [2]


def test_small_functions(spark):
    df = spark.createDataFrame([(0,), (61_001,), (3_600_000,), (7_325_040,)], "ms long")
    assert [r[0] for r in df.select(X.duration_text(F.col("ms"))).collect()] == ["0,000 s", "1 min 1,001 s", "1 h 0 min 0,000 s", "2 h 2 min 5,040 s"]
    secret = spark.createDataFrame([("a  Bearer abc.def\nsk-123 x" + "y" * 600,)], "t string").select(X.redact(F.col("t"))).first()[0]
    assert secret.startswith("a Bearer [redacted] [redacted] x") and len(secret) == 500
    lines = spark.createDataFrame([("a\r\nb c\x0bd\n",), ("",), ("\n",)], "t string").select(X.split_lines(F.col("t"))).collect()
    assert [r[0] for r in lines] == ["a\r\nb c\x0bd\n".splitlines(), [], [""]]
