"""Decontamination, chat formatting, language, toxicity, URL and WARC operators."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pagemill.llm import chat, decontaminate, language, toxicity, url_reputation, warc

DOCS = "doc_id long, text string, lang string, source string, th long, _key string, n_words int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", 2) for i, t in rows], DOCS)


# --- decontamination


def hits(text, items, window):
    w = decontaminate.words(text)
    cover, found = set(), set()
    for name, item in items:
        for p in decontaminate.phrases(decontaminate.words(item), window):
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    cover |= set(range(i, i + len(p)))
                    found.add(str(name))
    return len(w), len(cover), sorted(found)


def contamination_case():
    rng = random.Random(1)
    some = lambda n: [rng.choice(["a", "b", "c", "dé", "e1"]) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(1, 9)))) for i in range(12)] + [(5, "B b"), (40, ""), (41, None), (42, "...")]
    texts = [(i, " ".join(some(rng.randint(0, 60))).upper() if i % 2 else "-".join(some(rng.randint(0, 60)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "a " * 5000), (7, texts[7][1]), (7, "e1 e1"), (None, texts[3][1])]
    return texts, items


@pytest.mark.parametrize("block", [10**6, 15])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 50)
    monkeypatch.setattr(decontaminate, "SHARD", 300)
    texts, items = contamination_case()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(docs(spark, texts), bench, window=4).collect()
    key = lambda x: (x[0] is not None, x)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=lambda x: (x[0] or -1, x[1:]))
    want = sorted(((i, *hits(t, items, 4)) for i, t in texts), key=lambda x: (x[0] or -1, x[1:]))
    assert got == want and key
    assert any(x[2] for x in got)
    kept = decontaminate.keep_clean(docs(spark, texts), bench, window=4)
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(x[0] or -1 for x in want if not x[2])


def test_spans_and_proximity(spark):
    d = docs(spark, [(1, "x one two three y one gap two three"), (2, "three two one")])
    bench = spark.createDataFrame([("q", "one two three")], "item_id string, text string")
    exact = {r["doc_id"]: r for r in decontaminate.contamination(d, bench).collect()}
    assert [tuple(s) for s in exact[1]["spans"]] == [(1, 4)] and not exact[2]["spans"]
    near = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(d, bench, slop=1).collect()}
    assert near[1] > exact[1]["n_hit"] and near[2] == 0
    assert decontaminate.contamination(d, bench, slop=4).where("n_hit > 0").count() == 2


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    d = docs(spark, [(1, "a b"), (2, None)])
    assert sorted((r["n_words"], r["n_hit"]) for r in decontaminate.contamination(d, empty).collect()) == [(0, 0), (2, 0)]
    assert decontaminate.contamination(d.where("false"), d.selectExpr("doc_id item_id", "text")).count() == 0


# --- chat


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<turn>", "</turn>", "<says>", "\\", "<\\turn>", "é", "漢字", "\n", "\r\n", "<<turn>>", " ", "assistant", "<", "/turn>", "🙂", "\u0000"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a<says>b"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "assistant", "x"), (5, 2, "assistant", "again"), (5, 2, "assistant", "again"), (7, None, "user", "no turn"), (900, 0, "assistant", "word " * 30000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, h int, ids int")
    tokenizer = chat.load_tokenizer(spark)
    formatted = chat.format_conversations(df, tokenizer).cache()
    got = {r["conv_id"]: r for r in chat.digests(formatted, tokenizer).collect()}
    first = lambda x: (x is not None, x if x is not None else 0)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (first(r[1]), (r[2] is not None, r[2] or ""), hashlib.sha256((r[3] or "").encode()).hexdigest()))
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        rendered = "".join(f"<turn>{chat.escape(r[2] or '')}<says>{chat.escape(r[3] or '')}</turn>" for r in own)
        want = (len(own), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(rendered))
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == want
    codec = chat.Codec(tokenizer.value)
    for r in formatted.collect():
        text = codec.render(list(r["ids"]))
        assert text.count("<turn>") == text.count("<says>") == text.count("</turn>") == r["n_turns"]
    assert chat.digests(chat.format_conversations(df.where("false"), tokenizer), tokenizer).count() == 0


def test_parts_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 50)
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} says something") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tokenizer = chat.load_tokenizer(spark)
    formatted = chat.format_conversations(df, tokenizer)
    assert formatted.count() > 5
    got = chat.digests(formatted, tokenizer).collect()
    assert len(got) == 1 and got[0]["n_turns"] == 40


def test_texts_are_encoded_whole(spark):
    text = "word by word, " * 3000 + "x" * 20000 + " é漢字" * 3000
    tokenizer = chat.load_tokenizer(spark)
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    codec = chat.Codec(tokenizer.value)
    want = [codec.turn, *codec.encoding.encode_ordinary("assistant"), codec.says, *codec.encoding.encode_ordinary(text), codec.end]
    (row,) = chat.format_conversations(df, tokenizer).collect()
    assert list(row["ids"]) == want and sum(row["loss"]) == len(codec.encoding.encode_ordinary(text))


def test_escape_is_reversible():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["<turn>", "<says>", "</turn>", "\\", "<", "t", "turn>", "/"]) for _ in range(rng.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


# --- language


def test_language(spark):
    rng = random.Random(4)
    words = {"aa": ["bli", "plo", "gru", "sta", "er"], "bb": ["zar", "ki", "zo", "rek", "er"], "cc": ["mo", "na", "mu", "ri", "er"]}
    some = lambda g, n: " ".join("".join(rng.choice(words[g]) for _ in range(rng.randint(2, 4))) for _ in range(n))
    rows = [(i, some(g, rng.randint(4, 200)), g) for i, g in enumerate(rng.choices(list(words), k=150))]
    odd = [(500, None, "aa"), (501, "12 !?", "aa"), (502, "bliplo " * 20000, None), (503, "", None), (503, some("bb", 30).upper(), None), (None, some("cc", 30), None)]
    df = spark.createDataFrame([(i, t, g, 1) for i, t, g in rows + odd], "doc_id long, text string, lang string, score int")
    model = language.learn(df.where(~language.held_out(df["doc_id"], 3, 1)))
    assert {n for n, _ in model} == set(words)
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in language.classify(df, model).collect()]
    truth = {i: g for i, _, g in rows}
    out = [(truth[i], p) for i, p, _, _ in got if i in truth and zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) > 20 and sum(a == b for a, b in out) >= 0.95 * len(out)
    by = sorted((i or -1, p) for i, p, _, _ in got if i not in truth)
    assert by == [(-1, "cc"), (500, "und"), (501, "und"), (502, "aa"), (503, "bb"), (503, "und")]
    assert all(0 <= s <= 1 for _, _, s, _ in got)
    assert language.learn(df.where("false")) == []
    assert {r["lang_pred"] for r in language.classify(df, []).collect()} == {"und"}
    assert language.classify(df.where("false"), model).count() == 0


def test_language_against_a_plain_loop(spark, monkeypatch):
    import zstandard as Z

    rng = random.Random(9)
    names = [f"l{i}" for i in range(5)]
    parts = {n: ["".join(rng.choice("abcdefghijkmnoprstuvz") for _ in range(rng.randint(2, 4))) for _ in range(9)] for n in names}
    some = lambda n, k: " ".join("".join(rng.choice(parts[n]) for _ in range(rng.randint(1, 3))) for _ in range(k))
    model = [(n, some(n, 300).encode()) for n in names[:4]] + [(names[4], b"tiny")]
    texts = [some(rng.choice(names), rng.choice([1, 3, 40, 2000])) for _ in range(60)] + ["Ab1cd " * 30000, "é", None, "42"]
    rows = [(i // 2, t, None, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, best string")

    def size(own, text):
        raw = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        d = Z.ZstdCompressionDict(own, dict_type=Z.DICT_TYPE_RAWCONTENT) if len(own) >= 8 else None
        c = Z.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048))

    want = []
    for i, t, _, _ in rows:
        if t is None or not any(map(str.isalpha, t)):
            want.append((i, "und", 0.0))
            continue
        sizes = [size(own, t) for _, own in model]
        few = sorted(sizes)
        want.append((i, names[sizes.index(few[0])], (few[1] - few[0]) / few[1]))
    for block in (256, 2):
        monkeypatch.setattr(language, "LANGUAGES", block)
        got = [(r["doc_id"], r["lang_pred"], r["margin"]) for r in language.classify(df, model).collect()]
        assert sorted((i, n, round(m, 9)) for i, n, m in got) == sorted((i, n, round(m, 9)) for i, n, m in want)
        scores = {round(r["score"], 9) for r in language.classify(df.where("doc_id = 3"), model).collect()}
        assert block == 256 or scores == seen
        seen = scores
    learned = language.learn(spark.createDataFrame([(i, some(n, 5), n) for i, n in enumerate(names * 3)], "doc_id long, text string, lang string"))
    assert [n for n, _ in learned] == names


# --- toxicity


def toxic_rows(n, seed):
    rng = random.Random(seed)
    clean = ["lorem", "ipsum", "dolor", "sit", "amet", "magna", "aliqua", "tempor", "veniam"]
    rows = []
    for i in range(n):
        text, bad = [rng.choice(clean) for _ in range(rng.randint(1, 90))], rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text) + 1), "snarg" + rng.choice(["", "el", "iff", "ous", str(rng.randrange(99))]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(500, 5)
    net = toxicity.fit([(t, y) for _, t, y in rows[:300]], epochs=4)
    odd = [(900, None), (901, ""), (902, "?!"), (903, "lorem " * 20000 + "snargle " + "ipsum " * 300), (904, "lorem"), (904, "snarg")]
    d = docs(spark, [(i, t) for i, t, _ in rows[300:]] + odd)
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score(d, net).collect()]
    truth = {i: y for i, _, y in rows}
    out = [(truth[i], p) for i, _, p in got if i in truth]
    assert sum(a == b for a, b in out) >= 0.95 * len(out)
    assert sorted((i, p) for i, _, p in got if i not in truth) == [(900, 0), (901, 0), (902, 0), (903, 1), (904, 0), (904, 1)]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got)
    kept = toxicity.keep_clean(d, net)
    assert kept.columns == d.columns and kept.count() == sum(1 for _, _, p in got if not p)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:50]] + [(0, None), (None, 1), (900, 1)], "doc_id long, label int")
    some = toxicity.sample(docs(spark, [(i, t) for i, t, _ in rows[:50]] + [(rows[1][0], "again")] + odd), labels, toxic=5, clean=7)
    assert sorted(y for _, y in some) == [0] * 7 + [1] * 5
    assert toxicity.sample(d.where("false"), labels) == toxicity.sample(d, labels.where("false")) == []
    assert toxicity.fit([]) is None and toxicity.fit([("a", 1)]) is None
    assert {r["score"] for r in toxicity.score(d, None).collect()} == {0.0}


def test_scores_against_a_plain_loop(spark):
    rows = toxic_rows(200, 6)
    net = toxicity.fit([(t, y) for _, t, y in rows], epochs=2)
    texts = [t for _, t, _ in rows[:40]] + ["one", "", None, "new words " * 700 + "snarg", " ".join(str(i) for i in range(23)), " ".join(str(i) for i in range(25))]
    df = spark.createDataFrame([(7, t, "x") for t in texts], "doc_id long, text string, score string")

    def plain(text):
        w = decontaminate.words(text)
        vocabulary = [b"", *sorted(set(w))]
        number = {x: i for i, x in enumerate(vocabulary)}
        projected = net.project(net.inputs(vocabulary))
        starts = [*range(0, max(1, len(w) - toxicity.WINDOW), toxicity.STRIDE), max(0, len(w) - toxicity.WINDOW)]
        best = max((float(net.forward(projected, np.array([[number[x] for x in w[s : s + toxicity.WINDOW]] + [0] * (toxicity.WINDOW - len(w[s : s + toxicity.WINDOW]))]))[0]) for s in starts), default=0) if w else None
        return 0.0 if best is None else 1 / (1 + np.exp(net.shift - best))

    got = sorted(r["score"] for r in toxicity.score(df, net).collect())
    assert np.allclose(got, sorted(plain(t) for t in texts), atol=1e-4)
    assert toxicity.score(df.where("false"), net).count() == 0 and toxicity.keep_clean(df.where("false"), net).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network({b"a": 1, b"b": 2}, {g: i + 1 for i, g in enumerate({x for w in (b"a", b"b") for x in toxicity.grams(w)})}, (np.zeros(3), np.zeros(3)))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, y = np.array([[1, 2, 1, 0], [2, 2, 0, 0], [1, 1, 2, 2]]), np.array([1.0, 0.0, 1.0])
    vectors = rng.normal(size=(3, 2 * toxicity.DIM))
    loss = lambda v: float(np.mean(np.logaddexp(0, (1 - 2 * y) * net.forward(net.project(v), ids))))
    g, dv, _ = net.gradients(ids, vectors, y)
    for k in ("wx", "wh", "b", "wa", "va", "out", "bias"):
        at = tuple(rng.integers(s) for s in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-4
        up = loss(vectors)
        net.p[k][at] = old - 1e-4
        down = loss(vectors)
        net.p[k][at] = old
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-4, k
    v = vectors.copy()
    v[1, 3] += 1e-4
    assert abs((loss(v) - loss(vectors)) / 1e-4 - dv[1, 3]) < 1e-3


# --- URLs

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_urls(spark):
    urls = [
        ("http://WWW.Example.com/en/7x?a#b", "www.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", "block"),
        ("http://x.net/de/", "x.net", "/de/", "net/de/", "allow"),
        ("http://x.net?/de/", "x.net", "", None, "allow"),
        ("http://x.net#/de/", "x.net", "", None, "allow"),
        ("no scheme /en/", "", "", None, "allow"),
        ("a://b://c/en/", "b:", "//c/en/", None, "allow"),
        (None, "", "", None, "allow"),
        ("http:///en/", "", "/en/", None, "allow"),
        ("HTTP://ÄB.ORG/es/\nx", "Äb.org", "/es/\nx", "org/es/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], 1, 2.0) for i, u in enumerate(urls)] + [(50, None, 1, 2.0), (50, None, 1, 2.0)], "page_id long, url string, host int, low double")
    outcomes = spark.createDataFrame([(0, None), (1, 0), (1, 1)], "page_id long, bad int")
    got = sorted(tuple(r) for r in url_reputation.filter_urls(pages, outcomes, RULES).collect() if r["page_id"] < 50)
    assert got == sorted((i, *u[1:]) for i, u in enumerate(urls))
    assert url_reputation.filter_urls(pages.where("false"), outcomes, RULES).count() == 0


def test_many_rules(spark, monkeypatch):
    urls = ["http://a.b.com/x/y", "http://b.com/x", "http://c.com/", "http://com/x/", "no", None, "http://a..com/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("block", "com/x"), ("allow", "b.com/x/"), ("block", "a.b.com/x/yz"), ("block", "c.com/")] + [("block", f"h{i}.com/") for i in range(20)]
    none = spark.createDataFrame([], "page_id long, bad int")
    few = sorted(map(tuple, url_reputation.filter_urls(pages, none, rules).collect()))
    monkeypatch.setattr(url_reputation, "MAX_RULES", 3)
    assert sorted(map(tuple, url_reputation.filter_urls(pages, none, rules).collect())) == few
    assert [r[3] for r in few] == ["b.com/x/", "com/x", "c.com/", "com/x", None, None, "com/x"]


def test_reputation_shrinks_and_blocks(spark):
    rows = [(f"bad{i % 3}.evil.com", 1) for i in range(300)] + [(f"h{i % 20}.fine{i % 5}.org", int(i % 50 == 0)) for i in range(600)] + [("new.evil.com", None), ("one.fine1.org", 1)]
    rep = {r["host"]: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert rep["bad0.evil.com"]["low"] > 0.5
    assert rep["new.evil.com"]["mean"] > 0.5 > rep["one.fine1.org"]["low"]  # no labels: the domain's; one bad page: still the domain's
    assert all(0 <= r["low"] <= r["mean"] <= r["high"] <= 1 for r in rep.values())


# --- WARC


@pytest.mark.parametrize("sent", [2_000_000, 10])
def test_warc_round_trip(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT", sent)
    rng = random.Random(6)
    same = "<p>" + "same é " * 40
    html = [same if i % 4 == 0 else "x" * rng.randint(0, 300) + str(i) if i % 3 else "tiny" for i in range(60)] + [None, "", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9, "\u0000" * 200, "<" * 500000]
    rows = [(len(html) - i, f"http://h/{i}" if i % 5 else None, h) for i, h in enumerate(html)] + [(None, "u\r\nX: y", same), (3, "twice", "tiny"), (3, "twice", same)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    got = warc.round_trip(df).collect()
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, u, h in rows:
        own = first.get(h)
        revisit = own is not None and own != i and sum(1 for r in rows if r[2] == h) > 1
        raw = (h or "").encode()
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", own if revisit else None, None if revisit else raw))
    key = lambda x: tuple((y is not None, y) for y in x)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=key) == sorted(want, key=key)
    assert {r["url"] for r in got if r["page_id"] is None} == {"u%0D%0AX: y"}
    assert warc.round_trip(df.where("false")).count() == 0


def test_normaliser_makes_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://h/", f"<p>{i}" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    at = f"file://{tmp_path}"
    warc.write_monolithic(warc.with_revisits(pages), f"{at}/one")
    warc.normalise(spark, f"{at}/one", f"{at}/many")
    warc.write_index(spark, f"{at}/many", f"{at}/index")
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "one").glob("*.gz")))
    files = sorted((tmp_path / "many").rglob("*.txt"))
    assert b"".join(gzip.decompress(p.read_bytes()) for p in files) == whole
    for r in spark.read.parquet(f"{at}/index").collect():
        raw = next(p for p in files if r["file"].endswith(p.name)).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert zlib.decompress(raw, 31).startswith(b"WARC/1.1\r\nWARC-Type: response")
    one = spark.read.parquet(f"{at}/index").where("page_id = 7")
    assert warc.read_records(spark, f"{at}/many", spark.read.parquet(f"{at}/index")).drop("payload").exceptAll(warc.read_archives(spark, f"{at}/many").drop("payload")).count() == 0
    assert [bytes(r["payload"]) for r in warc.read_records(spark, f"{at}/many", one).collect()] == [b"<p>7" * 50]


def test_index_made_while_normalising(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://h/" if i % 3 else None, f"<p>{i}" * (i % 50)) for i in range(90)], "page_id long, url string, html string").repartition(3)
    at = f"file://{tmp_path}"
    warc.write_monolithic(warc.with_revisits(pages), f"{at}/one")
    warc.normalise(spark, f"{at}/one", f"{at}/many", f"{at}/index")
    warc.write_index(spark, f"{at}/many", f"{at}/again")
    rows = lambda name: sorted(tuple(r) for r in spark.read.parquet(f"{at}/{name}").select("file", "seq", "offset", "length", "record_type", "page_id").collect())
    assert rows("index") == rows("again") and len(rows("index")) == 90


def test_members_end_with_zero(monkeypatch):
    assert warc.member(b"abc")[-1] == 0
    monkeypatch.setattr(warc, "EMPTY_MEMBER_AT", 2)
    assert warc.member(b"abc")[-1] == 0 and b"".join(warc.inflated(warc.member(b"abc"))) == b"abc"
    for cut in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records_of(iter([cut])))
    with pytest.raises(ValueError):
        list(warc.inflated(gzip.compress(b"abc" * 99)[:-4]))
