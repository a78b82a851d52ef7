"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at Hamming distance t or less. The bits are grouped
into partitions, correlated bits together, and partition i gets a threshold t_i
with sum(t_i) = t - partitions + 1: any linked pair is within t_i in at least one
partition, and -1 leaves a partition out. Thresholds come from dynamic programming
on candidate counts estimated from a sample of fingerprints. Fingerprints that
meet in a partition are candidates and are verified on all bits.

A value that more than BUCKET distinct fingerprints share isn't paired up there:
its members go to their exact neighbourhoods. For t = 2, two fingerprints link
exactly when some 64-bit value is within one bit of both; every member is listed
under its 65 such values, where at most 65 fingerprints can meet, and all that
meet link to the smallest. No pair is lost and no group grows with its copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import SEED, checkpointed, fresh, hash_sample, stored
from pagemill.llm.graph import components

#: Distinct fingerprints under one partition value that are still paired there.
BUCKET = 64
#: Fingerprints from which correlations and candidate counts are estimated.
SAMPLE = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles.

    A-Z lower-cased, words between ASCII white space, shingles of `width` words
    joined by spaces with repeats; fewer words make one shingle, none gives 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    width = min(width, len(words))
    spans = zip([0, *ends], ends[width - 1 :], strict=False)
    hashes = np.fromiter((xxh64_intdigest(flat[a : b - 1], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        some = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp for each row; see fingerprint()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into equal groups, putting bits together that correlate in the sample."""
    bits = np.unpackbits(sample.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    with np.errstate(all="ignore"):
        near = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(sample) > 1 else np.zeros((64, 64))
    np.fill_diagonal(near, 0)
    left, groups = set(range(64)), []
    for g in range(parts):
        size = 64 // parts + (g < 64 % parts)
        own = [max(left, key=lambda b: (near[b, sorted(left)].sum(), -b))]
        left -= set(own)
        while len(own) < size:
            own.append(max(left, key=lambda b: (near[b, own].sum(), -b)))
            left.discard(own[-1])
        groups.append(sorted(own))
    return groups


def allocate(counts: list[list[float]], total: int) -> tuple[list[int], float]:
    """Thresholds (-1 and up) with the given sum and the least sum of counts[i][t + 1], by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in counts:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, picked) in best.items():
            for t, c in enumerate(row, -1):
                if have + t not in nxt or cost + c < nxt[have + t][0]:
                    nxt[have + t] = (cost + c, [*picked, t])
        best = nxt
    return best[total][1], best[total][0]


def plan(sample: np.ndarray, n: int, t: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the partitions that are probed.

    Costs are estimated candidate pairs among n fingerprints plus the signatures
    that probing them takes, for each number of partitions up to t + 1.
    """
    sample = sample.astype(np.uint64)
    best: tuple[float, list[tuple[int, int]]] | None = None
    for parts in range(1, t + 2):
        groups = group_bits(sample, parts)
        masks = [sum(1 << b for b in g) for g in groups]
        rows = []
        for g, mask in zip(groups, masks, strict=True):
            near = np.zeros(t + 1)
            for i in range(0, len(sample), 256):
                d = np.bitwise_count((sample[i : i + 256, None] ^ sample[None, :]) & np.uint64(mask))
                near += [(d <= k).sum() for k in range(t + 1)]
            # Pairs with itself don't count; a floor keeps the estimate above what chance gives.
            s = max(2, len(sample))
            chance = np.array([sum(_choose(len(g), j) for j in range(k + 1)) / 2.0 ** len(g) for k in range(t + 1)])
            pairs = np.maximum((near - len(sample)) / (s * (s - 1)), chance) * n * n / 2
            signatures = n * np.array([sum(_choose(len(g), j) for j in range(k + 1)) for k in range(t + 1)])
            rows.append([0.0, *(pairs + signatures)])
        thresholds, cost = allocate(rows, t - parts + 1)
        if best is None or cost < best[0]:
            best = cost, [(m, x) for m, x in zip(masks, thresholds, strict=True) if x >= 0]
    return best[1]


def _choose(n: int, k: int) -> int:
    return 0 if k > n else 1 if k == 0 else _choose(n, k - 1) * (n - k + 1) // k


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(mask: int, t: int) -> Column:
    """All values with up to t bits of the mask."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return F.array(*(F.lit(_signed(sum(c))).cast("long") for k in range(t + 1) for c in combinations(bits, k)))


def links(fps: DataFrame, t: int = 2) -> DataFrame:
    """a, b: fingerprints of fps(fp), distinct and not null, whose graph has the components of all links at t bits or less.

    Under values of up to BUCKET members every linked pair is given; beyond, for
    t = 2, a star for each exact neighbourhood. Other t pair up all candidates.
    """
    n = fps.count()
    sample = np.array([r[0] for r in hash_sample(fps, "fp", n, SAMPLE).collect()], np.int64).view(np.uint64)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= t
    parts, crowds = [], []
    for mask, own in plan(sample, n, t):
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        index = fps.select(value.alias("v"), "fp")
        crowd = index.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        if own == 0:  # a value with one member links nobody
            index = index.join(crowd.where("n > 1"), "v")
        else:
            index = index.join(crowd, "v")
        if t == 2:
            crowds.append(index.where(F.col("n") > BUCKET).select("fp"))
            index = index.where(F.col("n") <= BUCKET)
        probe = index.select("v", F.col("fp").alias("a"))
        if own:
            # Values that were crowded are probed by their members' neighbours too.
            probe = fps.select(F.explode(F.transform(_flips(mask, own), lambda x: x.bitwiseXOR(value))).alias("v"), F.col("fp").alias("a"))
            if t == 2:
                reached = probe.join(crowd.where(F.col("n") > BUCKET), "v").select(F.col("a").alias("fp"))
                crowds.append(reached)
            parts.append(probe.join(index.select("v", F.col("fp").alias("b")), "v").where(F.col("a") != F.col("b")).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        else:
            parts.append(probe.join(index.select("v", F.col("fp").alias("b")), "v").where((F.col("a") < F.col("b")) & near).select("a", "b"))
    if crowds:
        one_bit = F.array(*(F.lit(_signed(x)).cast("long") for x in [0, *(1 << b for b in range(64))]))
        members = reduce(DataFrame.unionByName, crowds).distinct()
        around = members.select("fp", F.explode(F.transform(one_bit, lambda x: x.bitwiseXOR(F.col("fp")))).alias("z"))
        met = around.groupBy("z").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1).withColumn("a", F.array_min("all"))
        parts.append(met.select("a", F.explode("all").alias("b")).where("a <> b"))
    return reduce(DataFrame.unionByName, parts).distinct()


def near_duplicates(documents: DataFrame, *, width: int = 3, t: int = 2) -> DataFrame:
    """doc_id, fp, component_id for each row of documents.

    component_id: the smallest doc_id reachable over links, the row's own included.
    Null and empty texts have fingerprint 0, linked like any other. Rows with equal
    ids are judged row by row. Equal texts meet as one fingerprint before anything
    is paired. An empty table gives an empty result.
    """
    rows = stored(fingerprints(documents, width), "fingerprints")
    by_fp = classes(rows.select("fp", "doc_id"), t).withColumnRenamed("fp", "_fp")
    return rows.join(by_fp, F.col("fp") == F.col("_fp")).select("doc_id", "fp", F.col("least").alias("component_id"))


def classes(rows: DataFrame, t: int) -> DataFrame:
    """fp, least: for each fingerprint of rows(fp, x) the least x of all that are reachable from it over links."""
    return least_of(rows, lambda fps: links(fps, t))


def least_of(rows: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """classes() by the links(a, b) that `linked` gives for fps(fp)."""
    x = next(c for c in rows.columns if c != "fp")
    fps = checkpointed(rows.groupBy("fp").agg(F.min(x).alias("least")))
    found = components(linked(fps.select("fp")))
    roots = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("least"))
    return roots.select("fp", "root").join(least, "root").select("fp", "least")


def keep_one(documents: DataFrame, *, width: int = 3, t: int = 2) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id, as it is.

    Rows with equal doc_id go by their text's hash; of equal rows one stays. Null ids
    come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), width) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["d", "t", "fp"])

    rows = stored(documents.select(row_key().alias("key"), "text").select("key.*", "text").mapInArrow(run, "d long, t long, fp long"), "fingerprints")
    return keep_least(documents, rows, classes(rows.select("fp", F.struct("d", "t").alias("key")), t))


def row_key() -> Column:
    """What tells rows apart: doc_id, and the text's hash."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))


def keep_least(documents: DataFrame, rows: DataFrame, by_fp: DataFrame) -> DataFrame:
    """The documents that are the least of their class, by rows(d, t, fp) and by_fp(fp, least)."""
    by_fp = by_fp.withColumnRenamed("fp", "_fp")
    judged = rows.join(by_fp, F.col("fp") == F.col("_fp")).groupBy("d", "t").agg(F.max((F.struct("d", "t") == F.col("least")).cast("int")).alias("stays"), F.count(F.lit(1)).alias("n"))
    judged = stored(judged.where("stays = 0 or n > 1"), "judged")
    own = fresh(documents, "_key")
    keyed = documents.withColumn(own, row_key())
    # A stored list has a known size, by which Spark chooses how to join it.
    gone = judged.select(F.struct("d", "t").alias("_gone"))
    out = keyed.join(gone, keyed[own] == gone["_gone"], "left_anti").drop(own)
    again = judged.where("stays = 1")
    if again.isEmpty():
        return out
    again = again.select(F.struct("d", "t").alias("_again"))
    return out.unionByName(keyed.join(again, keyed[own] == again["_again"], "left_semi").dropDuplicates([own]).drop(own))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
