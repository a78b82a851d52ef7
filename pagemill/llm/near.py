"""Near-duplicates by SimHash, held against exact Jaccard similarity of five-word shingles.

Texts link where the sets of their shingles have a similarity of 4/5 or more. The
SimHashes of five-word shingles that lie within simhash.links() of each other are
probed first, as in op9, and what they pair is verified. At 4/5 two SimHashes differ
by about ten bits, too many to probe without loss, so the rest has an exact way: with
all shingles in one order, two texts that link share one among the first
n - ceil(4n/5) + 1 of each. Any order is exact; shingles go by how common they are
in a sample, so that a common line is in few prefixes.

Under each shared shingle all members are first held against one of them: the one
that has the fewest rarer shingles, since what a copy adds of its own is rare, and a
text that adds nothing is the likeliest to be like all others. What is linked by then
need not be paired again; the pairs that are left, across components, are all
verified, so no link is lost and a group of copies isn't paired up with itself.
Shingles are sorted over all partitions by range, so that one that a third of the
texts share is dealt over many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import simhash
from pagemill.llm.common import SEED, drop_path, received, scratch_path, shipped, stored, uniform
from pagemill.llm.graph import components
from pagemill.llm.simhash import keep_least, least_of, row_key

WIDTH = 5
#: Part of the texts from which common shingles are taken, about how many at most and at least, and how many must hold one.
SHARE, SAMPLE, LEAST, COMMON = 0.25, 65536, 4096, 2
#: Bits by which pairs are dropped before their texts are read.
BITS = 2048


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles.

    Words as in simhash.fingerprint(); fewer than `width` make one shingle, none gives none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix((out ^ hashes[k : k + n]) + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def parities(own: np.ndarray) -> np.ndarray:
    """For each of BITS remainders, whether an odd number of the shingles has it; packed in longs."""
    odd = np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix(own: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Of sorted shingles those among which any text at 4/5 or more shares one, the rarest first.

    common: shingles that are common in a sample, sorted; often: how often they are there.
    """
    if len(common) and len(own):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.argsort(np.where(common[at] == own, often[at], 0), kind="stable")]
    return own[: len(own) - (4 * len(own) + 4) // 5 + 1] if len(own) else own


def _content(text: str | None) -> int:
    """Equal for texts of the same words."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(b" ".join((text or "").encode().lower().split()), SEED)
    return x - (1 << 64) if x >= 1 << 63 else x


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that COMMON of the sampled texts hold, and how many do."""
    share = max(min(SHARE, SAMPLE / max(texts.count(), 1)), min(1.0, LEAST / max(texts.count(), 1)))
    sample = texts.where(uniform(F.col("fp")) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py()).view(np.int64))], ["v"])

    found = sample.select("text").mapInArrow(run, "v long").groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).toArrow()
    v, n = (found.column(c).to_numpy() for c in ("v", "n"))
    order = np.argsort(v.view(np.uint64))
    return v.view(np.uint64)[order], n[order]


def _forget(*tables: DataFrame) -> None:
    """Remove stored() tables that nothing reads any more, so that they don't stay beside the next ones."""
    for df in tables:
        if files := df.inputFiles():
            drop_path(df.sparkSession, files[0].rpartition("/")[0])


#: A text under one of its shingles: how many rarer ones it has, its hash, its number of shingles.
MEMBER = "struct<at:int,fp:long,n:int>"


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (v, at, fp, n) to those whose v has another member, with the number of members and the first one.

    A batch's first and last v may go on in other batches, of other tasks even; their
    rows go on as they are, marked.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(0).to_numpy()
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        head, group = np.nonzero(new)[0], np.cumsum(new) - 1
        members = np.bincount(group)[group]
        edge = (group == 0) | (group == group[-1])
        some = np.nonzero(edge | (members > 1))[0]
        rows, one = batch.take(pa.array(some)), batch.take(pa.array(head[group[some]]))
        first = pa.StructArray.from_arrays(one.columns[1:4], ["at", "fp", "n"])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(members[some].astype(np.int32)), first, pa.array(edge[some])], ["v", "at", "fp", "n", "members", "one", "edge"])


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """a, b: of texts(fp, text) those that op9's operator pairs, by fingerprints of WIDTH-word shingles.

    Texts of one fingerprint meet its least fp, which stands for it in simhash.links().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash.fingerprint(x.as_py(), WIDTH) for x in batch.column(1)], pa.int64())], ["fp", "h"])

    marks = stored(texts.select("fp", "text").mapInArrow(run, "fp long, h long"), "simhashes")
    one = stored(marks.groupBy("h").agg(F.min("fp").alias("one"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    same = marks.join(one.where("n > 1").select("h", "one"), "h").where("fp <> one").select(F.col("one").alias("a"), F.col("fp").alias("b"))
    side = lambda x: one.select(F.col("h").alias(f"{x}_h"), F.col("one").alias(x))
    near = simhash.links(one.select(F.col("h").alias("fp"))).toDF("a_h", "b_h").join(side("a"), "a_h").join(side("b"), "b_h").select("a", "b")
    return same.unionByName(near)


def links(texts: DataFrame) -> DataFrame:
    """a, b: of texts(fp, text), one row for each fp, links whose graph has the components of all links."""
    spark = texts.sparkSession
    common = shipped(spark, _common(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = received(common)
        for batch in batches:
            for fp, x in zip(batch.column(0), batch.column(1), strict=True):
                own = shingles(x.as_py())
                first = prefix(own, *late)
                k, n = len(first), len(own)
                if k:
                    sign = pa.array([parities(own).tolist(), *[None] * (k - 1)], pa.list_(pa.int64()))  # beside the first row of a text
                    yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, fp.as_py(), np.int64)), pa.array(np.full(k, n, np.int32)), sign], ["v", "at", "fp", "n", "sign"])

    path = scratch_path(spark, "prefixes")
    schema = "v long, at int, fp long, n int"
    texts.select("fp", "text").mapInArrow(run, f"{schema}, sign array<long>").write.parquet(path)
    index = spark.read.schema(f"{schema}, sign array<long>").parquet(path)
    signs = stored(index.where("sign is not null").select("fp", "n", "sign"), "signs")
    index = index.select("v", "at", "fp", "n")
    judged = stored(index.repartitionByRange("v", "at", "fp").sortWithinPartitions("v", "at", "fp").mapInArrow(_share, f"{schema}, members int, one {MEMBER}, edge boolean"), "judged")
    # Shingles that go over batches: all their members, counted and joined with their first one.
    edges = stored(judged.where("edge").select("v", "at", "fp", "n"), "edges")
    held = edges.groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("members"), F.min(F.struct("at", "fp", "n")).alias("one")).where("members > 1")
    columns = ["v", "at", "fp", "n", "members", "one"]
    index = stored(judged.where("not edge").select(*columns).unionByName(edges.join(held, "v").select(*columns)), "shared")
    drop_path(spark, path)
    _forget(judged, edges)

    # Overlap is at most the shingles from the first one in common on.
    can = 9 * F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= 4 * (F.col("a_n") + F.col("b_n"))
    side = lambda s: [F.col("fp").alias(s), F.col("n").alias(f"{s}_n"), F.col("at").alias(f"{s}_at")]
    star = index.select(*[F.col(f"one.{c}").alias(f"a{x}") for c, x in (("fp", ""), ("n", "_n"), ("at", "_at"))], *side("b")).where("a <> b").where(can)
    # What the fingerprints link needs no other pair; a star's pairs are verified once.
    probed = _verified(simhash_pairs(texts), signs, texts, "simhash")
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(probed, ["a", "b"], "left_anti")
    first = stored(probed.unionByName(_verified(star, signs, texts, "star")), "linked")
    more = index.where("members > 2").select("v", "at", "fp", "n")

    def apart(found: DataFrame, name: str) -> DataFrame:
        """Members of one component are linked already; a shingle that has only one has no pair left."""
        root = components(found).withColumnRenamed("node", "_node")
        rooted = more.join(root, more["fp"] == root["_node"], "left").select("v", "at", "fp", "n", F.coalesce("root", "fp").alias("root"))
        split = rooted.groupBy("v").agg(F.max("root").alias("hi"), F.min(F.struct("root", "at", "fp", "n")).alias("lo")).where("lo.root < hi").select("v", "lo")
        return stored(rooted.join(split, "v"), name)

    # Once more all against one, now a member of the first component: what is alike is linked before pairs are made.
    again = apart(first, "apart").where("root <> lo.root")
    fits = 9 * F.least("a_n", "b_n") >= 4 * (F.col("a_n") + F.col("b_n"))
    again = again.select(F.col("lo.fp").alias("a"), F.col("lo.n").alias("a_n"), *side("b")).where(fits)
    first = stored(first.unionByName(_verified(again, signs, texts, "again")), "firsts")
    more = apart(first, "still-apart").drop("lo")
    left, right = more.select("v", F.col("root").alias("a_root"), *side("a")), more.select("v", F.col("root").alias("b_root"), *side("b"))
    rest = _verified(left.join(right, "v").where("a < b and a_root <> b_root").where(can), signs, texts, "rest")
    _forget(index, signs)
    return first.unionByName(rest).distinct()


def _verified(pairs: DataFrame, signs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs(a, b) whose texts are similar.

    The parities of two sets differ in as many bits as shingles are in one set only, at
    most, which is a ninth of both sizes at most where texts are similar. Pairs beyond
    are dropped before any set of shingles is read.
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: signs.select(F.col("fp").alias(x), F.col("n").alias(f"{x}_n"), F.col("sign").alias(f"{x}_sign"))
    differ = F.aggregate(F.zip_with("a_sign", "b_sign", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(9 * differ <= F.col("a_n") + F.col("b_n"))
    pairs = stored(near.select("a", "b"), f"{name}-pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, x in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([fp.as_py()], pa.int64()), pa.array([shingles(x.as_py()).view(np.int64)], pa.list_(pa.int64()))], ["fp", "s"])

    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), f"{name}-wanted")
    sets = stored(texts.select("fp", "text").join(wanted, "fp", "left_semi").mapInArrow(run, "fp long, s array<long>"), f"{name}-sets")
    a, b = sets.select(F.col("fp").alias("a"), F.col("s").alias("s")), sets.select(F.col("fp").alias("b"), F.col("s").alias("z"))
    similar = 9 * F.size(F.array_intersect("s", "z")) >= 4 * (F.size("s") + F.size("z"))
    found = stored(pairs.join(a, "a").join(b, "b").where(similar).select("a", "b"), f"{name}-links")
    _forget(sets, wanted, pairs)
    return found


def keep_one(documents: DataFrame) -> DataFrame:
    """Of each group of linked documents the row with the smallest doc_id, as it is; see simhash.keep_one()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_content(x.as_py()) for x in batch.column(2)], pa.int64())], ["d", "t", "fp"])

    rows = stored(documents.select(row_key().alias("key"), "text").select("key.*", "text").mapInArrow(run, "d long, t long, fp long"), "contents")
    one = rows.groupBy("fp").agg(F.min(F.struct("d", "t")).alias("_one")).select("fp", "_one")
    keyed = documents.select(row_key().alias("_key"), "text")
    texts = stored(keyed.join(one, keyed["_key"] == one["_one"]).dropDuplicates(["fp"]).select("fp", "text"), "texts")
    return keep_least(documents, rows, least_of(rows.select("fp", F.struct("d", "t").alias("key")), lambda fps: links(texts)))
