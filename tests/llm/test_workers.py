"""Workers need not be able to import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from pagemill.llm import chat, decontaminate, language, permutation, simhash, suffix, toxicity, warc
d = spark.createDataFrame([(i, "one two three " * (i + 1)) for i in range(4)], "doc_id long, text string")
b = spark.createDataFrame([(0, "two three one")], "item_id long, text string")
assert decontaminate.contamination(d, b).where("n_hit > 0").count() == 3
net = toxicity.fit([("good day", 0), ("bad bad day", 1)] * 4, epochs=1)
assert toxicity.score(d, net).count() == toxicity.score(d, None).count() == 4
v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
assert permutation.nearest(v, v).count() == 20
assert language.classify(d, [("a", b"one two three" * 9)]).count() == 4
assert simhash.near_duplicates(d).count() == suffix.remove_repeats(d).count() == 4
c = d.selectExpr("doc_id conv_id", "0 turn", "'user' role", "text")
t = chat.load_tokenizer(spark)
assert chat.digests(chat.format_conversations(c, t), t).count() == 4
assert warc.round_trip(d.selectExpr("doc_id page_id", "'u' url", "text html")).count() == 4
"""


def test_by_value(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, check=True, timeout=300)
