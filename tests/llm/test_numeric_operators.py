"""Mixing, the permutation index and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pagemill.llm import mixing, permutation

DOCS = "doc_id long, text string, source string, size int, base int, copies int, _size int"


def mix_rows(n, seed):
    rng = random.Random(seed)
    size = lambda: rng.choice([0, 1, 5, 20, 20, 50, 3000 if rng.random() < 0.02 else 30])
    return [(i, "w " * size(), rng.choice(["hot", "hot", "a", "B", "ä", None])) for i in range(n)]


def targets(size, weights=(1, 2, 3), most=3):
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left, share = total - sum(most * size[s] for s in capped), sum(w[s] for s in order if s not in capped)
        t = {s: most * size[s] if s in capped else left * w[s] / share for s in order}
        over = {s for s in order if s not in capped and t[s] > most * size[s]}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("bucket,long", [(512, 2048), (8, 2048), (8, 1), (64, 20)])
def test_mix(spark, monkeypatch, bucket, long):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "LONG", long)
    monkeypatch.setattr(mixing, "RANGE", 64)
    rows = mix_rows(1500, 1) + [(2000, None, "tiny"), (2001, "one", "tiny"), (2002, " \t ", None), (3, "w " * 7, "a"), (None, "w w", "a")] + [(5000, "w " * 11, "a")] * 300
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DOCS).repartition(5)
    got = [tuple(r) for r in mixing.mix(df).collect()]
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((i, len((t or "").split()), s) for i, t, s in rows)
    size, taken, most = Counter(), Counter(), Counter()
    for _, n, s, _, _, _, k in got:
        size[s] += n
        taken[s] += k
        most[s] = max(most[s], n)
    want = targets({s: size[s] for s in size})
    for _, n, s, source_size, target, copies, k in got:
        assert source_size == size[s] and abs(target - want[s]) < 1e-6 and 0 <= copies <= 3 and k == n * copies
    for s in size:
        assert abs(taken[s] - want[s]) <= most[s]
    again = mixing.mix(df.repartition(2)).collect()
    assert Counter(tuple(r) for r in again) == Counter(got)
    kept = mixing.take(df)
    assert sum(r["taken"] for r in kept.collect()) == sum(taken.values())
    assert kept.count() == sum(1 for r in got if r[5])
    assert mixing.mix(df.where("false")).count() == 0


def test_rounding_is_unbiased(spark):
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    due = {r["doc_id"]: r["target"] / r["source_size"] for r in mixing.mix(df).collect()}
    total = Counter()
    for seed in range(12):
        for r in mixing.mix(df, seed=seed).collect():
            total[r["doc_id"]] += r["copies"] / 12
    assert abs(np.mean([total[i] - due[i] for i in due])) < 0.05
    assert np.mean([abs(total[i] - due[i]) for i in due]) < 0.25


@pytest.mark.parametrize("bucket,long", [(512, 2048), (4, 1), (4, 6)])
def test_every_document_keeps_its_expected_copies(spark, monkeypatch, bucket, long):
    """Sources of documents of the same sizes; a place's mean over 400 sources has a deviation of 0.024 at most."""
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "LONG", long)
    sizes = [1, 2, 3, 5, 8, 40, 90, 200, 3, 3]
    rows = [(s * 100 + i, "w " * n, f"s{s:04d}") for s in range(800) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1, 2)).select("doc_id", "copies", "target", "source_size").collect()
    assert len(got) == len(rows)
    for weight in (0, 1):
        total = Counter()
        for r in got:
            if (r["doc_id"] // 100) % 2 == weight:
                due = r["target"] / r["source_size"]
                total[r["doc_id"] % 100] += r["copies"] / 400
        assert all(abs(total[i] - due) < 0.1 for i in range(len(sizes))), (due, total)


def test_a_long_document_is_not_left_to_the_end(spark):
    rows = [(s * 1000 + i, "w " * (2000 if i == 0 else i % 30 + 1), f"s{s:02d}") for s in range(20) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 20 and all(abs(r["sum(taken)"] - r["max(target)"]) <= 30 for r in got)


def search_case(n, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(12, 16))[rng.integers(0, 12, n)] + rng.normal(size=(n, 16))) * rng.uniform(0.5, 2, (n, 1))


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        score = x @ x[q]
        order = np.lexsort((ids, -score))
        out[int(ids[q])] = [int(ids[i]) for i in order if ids[i] != ids[q]][:k]
    return out


def test_recall_and_scores(spark):
    x = search_case(3000)
    df = spark.createDataFrame([(i, v.tolist(), 1, 2.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int, score double").repartition(3)
    got = permutation.nearest(df, df.where("vec_id % 20 = 0")).collect()
    want = brute(np.arange(3000), x, range(0, 3000, 20), 20)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    recall = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(abs(s - x[q] @ x[v]) < 1e-9 for _, v, s in rows)
        recall += len({v for _, v, _ in rows} & set(want[q]))
    assert recall >= 0.9 * 20 * len(want)


def test_vectors_that_take_no_part(spark):
    x = search_case(30, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(100, None), (120, [0.0] * 16), (140, [1.0] * 15 + [None]), (160, [float("nan")] * 16), (180, [float("inf")] + [0.0] * 15), (200, [1.0]), (None, [1.0] * 16)]
    rows += [(1000 + i, x[3].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in permutation.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    ids = np.array([*range(30), *range(1000, 1060)])
    all_x = np.concatenate([x, np.repeat(x[3:4], 60, 0)])
    want = brute(ids, all_x, [i for i, v in enumerate(ids) if v % 20 == 0], 20)
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == want
    assert permutation.nearest(df.where("false"), df.where("false")).count() == 0
    few = df.where("vec_id < 3")
    assert permutation.nearest(few, few).count() == 6


def test_split_files(spark, monkeypatch):
    monkeypatch.setattr(permutation, "QUERIES", 7)
    monkeypatch.setattr(permutation, "LIST", 20)
    x = search_case(500, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in permutation.nearest(df, df.where("vec_id % 5 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == brute(np.arange(500), x, range(0, 500, 5), 20)


def test_batches_and_partitions_change_nothing(spark):
    x = search_case(4000, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, got = spark.conf.get(name), []
    for rows, parts in ((1000, 2), (37, 9)):
        spark.conf.set(name, str(rows))
        some = df.repartition(parts)
        got.append(sorted(tuple(r) for r in permutation.nearest(some, some.where("vec_id % 20 = 0")).collect()))
    spark.conf.set(name, before)
    assert got[0] == got[1] and len(got[0]) == 4000


def test_repeated_ids(spark):
    x = search_case(40, 4)
    rows = [(i % 30, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 30 + [(7, x[9].tolist())] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = {}
    for i, v in rows:
        asked[i] = min(v, asked.get(i, v))
    got = {}
    for r in permutation.nearest(df, df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], round(r["score"], 9), r["vec_id"]))
    assert set(got) == set(range(30))
    for q, found in got.items():
        want = sorted((-round(float(np.array(asked[q]) @ np.array(v)), 9), i) for i, v in rows if i != q)[:20]
        assert [(-s, i) for _, s, i in sorted(found)] == want


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, question = text(80), text(14)
    docs = [(i, text(rng.randint(60, 120))) for i in range(120)]
    docs += [(200 + i, docs[0][1]) for i in range(5)]  # copies
    docs += [(300 + i, f"{text(50)} {passage} {text(50)}") for i in range(4)]
    docs += [(400 + i, f"{text(50)} {question} {text(50)}") for i in range(3)]
    docs += [(500 + i, f"{text(9)} snarg{word()} {text(9)} snarg {text(5)} snarg") for i in range(60)] + [(600, None), (601, "")]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, len(t) if t else 0) for i, t in docs]
    at = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(500 <= i < 600)) for i, _ in docs if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, question)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "mix_sources"]
    out, ids = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        nxt = stage(spark, out, at)
        assert nxt.columns == list(corpus_pipeline.COLUMNS)
        nxt.write.parquet(f"{at}/{k}")
        out = spark.read.parquet(f"{at}/{k}")
        ids.append({r["doc_id"]: r["text"] for r in out.collect()})
    clean = set(range(120)) | set(range(300, 304)) | set(range(400, 403))
    assert clean <= set(ids[0]) and len(set(ids[0]) & set(range(500, 560))) <= 2
    assert clean <= set(ids[1]) and not set(ids[1]) & set(range(200, 205)) and (600 in ids[1]) != (601 in ids[1])
    assert not any(passage in (t or "") for t in ids[2].values()) and set(ids[2]) == set(ids[1])
    assert all(ids[2][i] == ids[1][i] for i in range(120))
    # The question itself repeats too, so what is left of it is shorter than a phrase or gone with its document.
    assert set(range(120)) <= set(ids[3])
    mixed = corpus_pipeline.run(spark, at)
    assert 0 < mixed.count() <= len(ids[3]) and {"copies", "taken"} <= set(mixed.columns)
