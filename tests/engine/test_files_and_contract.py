import os
import subprocess
import sys

from pagemill.sources import files as S
from pagemill.streaming import incremental as I

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"abc")
    (tmp_path / "in/b.txt").write_bytes(b"  \n")
    s = S.sources(spark, f"{tmp_path}/in")
    assert {(r["size_bytes"], r["sha256"][:8]) for r in s.collect()} >= {(3, "ba7816bf")}
    assert S.uploadable(s).count() == 1 and S.unstable(s, s).count() == 0
    assert [r["markdown"] for r in S.markdown(spark, f"{tmp_path}/in").collect()] == ["abc"]
    a = spark.createDataFrame([("d", 1)], "doc_id string, x int")
    S.publish(a, a, f"{tmp_path}/out")
    S.publish(a, a, f"{tmp_path}/out", on_conflict="overwrite")
    assert spark.read.parquet(f"{tmp_path}/out/manifest").count() == 1
    S.save_state(a, f"{tmp_path}/state")
    S.save_state(spark.createDataFrame([("e", 2)], "doc_id string, x int"), f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/state").count() == 2
    assert S.add_missing(a, a, ["doc_id"]).count() == 0


def test_stream_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "1 Title\ntext"), ("d", 2, "- a")], "doc_id string, page_number int, text string")
    pages.write.parquet(f"{tmp_path}/in")
    stream = I.page_stream(spark, f"{tmp_path}/in", "doc_id string, page_number int, text string")
    I.write_blocks(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_entry_works_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "pagemill"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else None
    code = "import sys\nclass No:\n  def find_spec(self, n, p=None, t=None):\n    if n.startswith('pagemill.llm') or n == 'corpus_pipeline': raise ModuleNotFoundError(f'No module named {n!r}', name=n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q\nassert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_vision_proposals_are_held_against_whole_pages(spark, tmp_path):
    from pagemill.plans import lifecycle

    spark.createDataFrame([(4, "word " * 60 + "not there"), (9, "word " * 60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    codes = {r["doc_id"]: r["code"] for r in lifecycle.vision_validate(spark, str(tmp_path)).collect()}
    assert codes.get(9) and codes.get(4) != codes[9]
