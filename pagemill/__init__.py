"""Pagemill: document analytics at corpus scale on PySpark.

Decoded pages (text lines, positioned words, vector primitives, tables, links,
images) come in as DataFrames; blocks, references, Markdown, findings, scores and
verdicts come out as DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no copy of
# this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
