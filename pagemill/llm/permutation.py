"""Approximate nearest neighbours by a permutation index.

Pivots are vectors drawn from the table by hash. A vector is represented by its
PREFIX nearest pivots in order, and posted in the inverted files of the first POST of
them. A query visits the files of its VISIT nearest pivots. In each file the vectors
are ranked by footrule distance (the sum of rank differences, an absent pivot
counting as the rank past the last), and the KEEP nearest of them are ranked again by
their inner products.

There are PER_ROOT * sqrt(n) pivots for n vectors, so files grow with the root of n,
and so does what a query looks at; a file of more than LIST vectors or QUERIES
queries is dealt over several tasks, each with a bounded part. What meets in a task
is decided by ids and counts alone, so neither batches nor partitions change a result.

Equal vectors are one entry of the index, with the least of their ids, so copies
neither crowd others out nor meet in one task.

Inner products order vectors of any lengths: vectors are lifted onto a sphere of the
largest norm's radius by one more component, where the nearest to a query are those
of the largest inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import hash_sample, received, shipped, stored

#: Pivots for the root of the number of vectors, and the most that are drawn (they are broadcast).
PER_ROOT, MOST_PIVOTS = 4, 8192
#: Pivots that represent a vector, files that hold it, and files that a query visits.
PREFIX, POST, VISIT = 64, 4, 128
#: Vectors of each part of a file that are ranked again for a query.
KEEP = 64
#: Vectors and queries of a part of a file, on average.
LIST, QUERIES = 2048, 1024

KEY = ["h1", "h2"]


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """vec_id, vec, h1, h2 of rows with an id and a finite vector that isn't zero; equal vectors agree in both hashes."""
    x = F.col(vec)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(fine & F.exists(x, lambda v: v != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x.cast("array<double>"), lambda v: v + F.lit(0.0)).alias("vec"))  # no -0.0
    return rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Pivots:
    def __init__(self, points: np.ndarray, radius: float, prefix: int = PREFIX, visit: int = VISIT):
        self.radius = radius
        self.points = self.lift(points)
        self.prefix, self.visit = min(prefix, len(points)), min(visit, len(points))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.radius**2 - (x * x).sum(1)))[:, None]], 1)

    def nearest(self, x: np.ndarray, n: int, *, query: bool) -> np.ndarray:
        """Numbers of each row's n nearest pivots in order; the lift of a query is 0."""
        near = -(x @ self.points[:, :-1].T if query else self.lift(x) @ self.points.T)
        if n < near.shape[1]:
            edge = np.partition(near, n - 1, axis=1)[:, n - 1 : n]
            near = np.where(near <= edge, near, np.inf)
        return np.argsort(near, axis=1, kind="stable")[:, :n].astype(np.int16)


def _with_pivots(shared, dim: int, *, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Pivots = received(shared)
        n = known.visit if query else known.prefix
        for batch in batches:
            own = known.nearest(matrix(batch.column("vec"), dim), n, query=query)
            lists = pa.ListArray.from_arrays(np.arange(0, own.size + 1, n, dtype=np.int32), own.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), lists], [*COLUMNS, "pivots"])

    return run


COLUMNS = [*KEY, "least", "vec"]
INDEX = "h1 long, h2 long, least long, vec array<double>, pivots array<smallint>"


def _distinct(rows: DataFrame) -> DataFrame:
    """h1, h2, least, vec: each distinct vector, with its least id."""
    return rows.groupBy(*KEY).agg(F.min("vec_id").alias("least"), F.first("vec").alias("vec"))


def _members(rows: DataFrame, k: int) -> DataFrame:
    """h1, h2, ids: the k + 1 least ids of each distinct vector, with the number of rows that repeat one (k at most).

    Rows are counted, and cut at k + 1, before they are dealt, so no vector's rows meet in one task.
    """
    counts = rows.groupBy(*KEY, "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    few = counts.withColumn("i", F.row_number().over(Window.partitionBy(*KEY).orderBy("vec_id"))).where(F.col("i") <= k + 1)
    return few.groupBy(*KEY).agg(F.collect_list(F.struct("vec_id", "n")).alias("ids"))


def build_index(vectors: DataFrame, *, vec: str = "embedding") -> tuple[DataFrame, Pivots | None, int]:
    """The stored index (h1, h2, least, vec, pivots) over every distinct usable vector, its pivots and the dimension.

    The pivots are the distinct vectors with the least hashes, MOST_PIVOTS at most.
    Vectors of another length than most of the pivots' take no part.
    """
    distinct = stored(_distinct(usable(vectors, vec)), "vectors")
    n = distinct.count()
    most = min(MOST_PIVOTS, math.ceil(PER_ROOT * math.sqrt(n)) + 16)
    sample = [r["vec"] for r in hash_sample(distinct, "h1", n, most).collect()]
    if not sample:
        return distinct.withColumn("pivots", F.array().cast("array<smallint>")), None, 0
    sizes = [len(x) for x in sample]
    dim = max(sorted(set(sizes)), key=sizes.count)
    rows = distinct.where(F.size("vec") == dim)
    square = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    pivots = Pivots(np.array([x for x in sample if len(x) == dim]), float(square) ** 0.5)
    return stored(rows.mapInArrow(_with_pivots(shipped(rows.sparkSession, pivots), dim, query=False), INDEX), "index"), pivots, dim


def _posts(index: DataFrame, first: int, name: str) -> DataFrame:
    """A row for each vector and each of the first pivots that represent it."""
    return index.select(*COLUMNS, "pivots", F.explode(F.slice("pivots", 1, first)).alias(name))


def _dealt(posts: DataFrame, sizes: DataFrame, own: str, other: str, parts: str, others: str) -> DataFrame:
    """Posts with the part of the file they are in, one row for each part of the other side that they meet."""
    part = F.pmod(F.xxhash64(F.lit(3), *KEY), F.col(parts)).cast("int")
    return posts.join(F.broadcast(sizes), "pivot").withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).select("pivot", "e", "q", *COLUMNS, "pivots")


FOUND = "q1 long, q2 long, h1 long, h2 long, least long, score double"
FOUND_ARROW = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("least", pa.int64()), ("score", pa.float64())])


def _search(cut: int, dim: int, prefix: int, post: int, visit: int, keep: int):
    """Rank a part of a file for its queries by footrule, and the `keep` nearest again by inner product; the `cut` best go on."""

    def run(key, entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return FOUND_ARROW.empty_table()
        at = key[0].as_py()
        e1, e2 = (entries.column(c).to_numpy() for c in KEY)
        order = np.lexsort((e2, e1))
        e1, e2, least, x = e1[order], e2[order], entries.column("least").to_numpy()[order], matrix(entries.column("vec"), dim)[order]
        lists = matrix(entries.column("pivots"), prefix)[order]
        q1, q2 = (queries.column(c).to_numpy() for c in KEY)
        order = np.lexsort((q2, q1))
        q1, q2, asked = q1[order], q2[order], matrix(queries.column("vec"), dim)[order]
        own = matrix(queries.column("pivots"), visit)[order]
        n, m, some = len(e1), len(q1), int(max(lists.max(), own.max())) + 1
        # By pivot and query: its rank in the query's prefix, and its place among the files that the query visits.
        rank, place = np.full((some, m), prefix, np.int16), np.full((some, m), 1 << 14, np.int16)
        each = np.arange(m)
        for j in range(own.shape[1]):
            if j < prefix:
                rank[own[:, j], each] = j
            place[own[:, j], each] = j
        # The footrule distance but for a constant of the query: a shared pivot of ranks a and b
        # adds |a - b| and saves prefix - a; one that only the entry has adds prefix - b.
        far = np.zeros((n, m), np.int32)
        rank *= 2
        for j in range(prefix):
            step = rank[lists[:, j]]
            step -= np.int16(j)
            np.maximum(step, np.int16(j), out=step)
            far += step
        # An entry is judged once, in the first of its files that the query visits.
        first = place[lists[:, 0]]
        for j in range(1, min(post, prefix)):
            np.minimum(first, place[lists[:, j]], out=first)
        ours = first == place[at]
        far = far * n + np.arange(n, dtype=np.int32)[:, None] if prefix * prefix * 2 * n < 1 << 31 else far.astype(np.int64) * n + np.arange(n)[:, None]  # ties go to the lesser hash
        far[~ours] = np.iinfo(far.dtype).max
        if n > keep:
            ours &= far <= np.partition(far, keep - 1, axis=0)[keep - 1]
        score = np.where(ours, x @ asked.T, -np.inf)
        if n > cut:
            edge = np.partition(score, n - cut, axis=0)[n - cut]
            ours &= score >= edge - 1e-9 * np.abs(edge, where=np.isfinite(edge), out=np.zeros(m))
        who, whose = np.nonzero(ours)
        exact = (x[who] * asked[whose]).sum(1)  # the same sum whatever else is in the file
        return pa.table([q1[whose], q2[whose], e1[who], e2[who], least[who], exact], schema=FOUND_ARROW)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, *, vec: str = "embedding", k: int = 20, keep: int = KEEP, post: int = POST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by inner product, ties to the smaller vec_id.

    A query doesn't find rows with its own id. Null, zero and non-finite vectors, rows
    without id and vectors of another dimension take no part. Of queries with equal
    ids the least vector counts; other repeated rows are candidates of their own. An
    empty table of either kind gives no rows; other columns are not read. Up to 784
    distinct vectors all files are visited.
    """
    spark = vectors.sparkSession
    index, pivots, dim = build_index(vectors, vec=vec)
    if pivots is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    one = usable(queries, vec).where(F.size("vec") == dim).groupBy("vec_id").agg(F.min(F.struct("vec", *KEY)).alias("x"))
    asked = stored(one.select("vec_id", "x.*"), "asked")
    visits = stored(_distinct(asked).mapInArrow(_with_pivots(shipped(spark, pivots), dim, query=True), INDEX), "queries")

    entries, seekers = _posts(index, post, "pivot"), _posts(visits, pivots.visit, "pivot")
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = entries.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).join(seekers.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")), "pivot")
    sizes = stored(sizes.select("pivot", parts("n", LIST).alias("parts"), parts("m", QUERIES).alias("blocks")), "files")  # a row a pivot, MOST_PIVOTS at most
    left = _dealt(entries, sizes, "e", "q", "parts", "blocks")
    right = _dealt(seekers, sizes, "q", "e", "blocks", "parts")
    file = ["pivot", "e", "q"]
    rows = usable(vectors, vec).where(F.size("vec") == dim)
    # Entries that hold the k best rows besides those with a query's id: k, and as many as an id has vectors.
    own = rows.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.count_distinct(*KEY).alias("n"))
    cut = k + (own.agg(F.max("n")).first()[0] or 0)
    found = left.groupBy(*file).cogroup(right.groupBy(*file)).applyInArrow(_search(cut, dim, pivots.prefix, post, pivots.visit, keep), FOUND)

    nth = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least"))
    best = stored(found.withColumn("i", nth).where(F.col("i") <= cut).drop("i", "least"), "found")
    # From vectors to rows: lists of a few ids, so a vector that many rows or queries have is no more than its pair.
    members = _members(rows, k)
    hit = F.explode("ids").alias("id")
    hits = best.join(members, KEY).select("q1", "q2", "score", hit).groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id.vec_id", "id.n", "score"))).alias("hits"))
    hits = stored(hits, "hits")
    others = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    nearest_rows = F.slice(F.flatten(F.transform(others, lambda h: F.array_repeat(h, h["n"]))), 1, k)
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).join(hits, ["q1", "q2"])
    return answers.select("query_id", F.posexplode(nearest_rows).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score")
