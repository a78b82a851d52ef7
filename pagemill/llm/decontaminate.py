"""Benchmark decontamination with a distributed positional inverted index.

The index is built and stored once: documents are dealt into shards of about a thousand,
and for each shard and term there is a posting list, the documents that hold the term
and where. Only terms that pass a bitmap of the test set's words are kept; the bitmap
has a fixed size, whatever the test set's, and what it lets through in error is never
looked up. Phrases are searched by their terms: those of a block of the test set are
fetched from the index and meet by shard, where each phrase's rarest list is shifted
to the phrase's start and intersected with the shifted lists of the next terms, rarest
first, by their counts over the whole index.

A shard's lists are bounded, so a term or passage that a third of the documents share
costs its own postings and no more. The test set is taken in blocks of at most
BLOCK_WORDS words, all of them over the same index; a block and the bitmap are all
that is ever broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import fresh, received, shipped, small_batches, stored, utf8

#: Words of a test phrase; an item with fewer is one phrase.
WINDOW = 10
#: Words of the items in a block of the test set.
BLOCK_WORDS = 1_000_000
#: Words of a shard (or one document's), and candidates intersected at once.
SHARD, CANDIDATES = 1 << 20, 1 << 20
#: Bits of the test set's bitmap.
BITS = 1 << 22

#: A-Z to lower case, and all ASCII but 0-9 and a-z to spaces; other bytes belong to words.
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x in _KEEP else 0x20 for x in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def phrases(item: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The item's windows; one shorter window for an item that is shorter, none for an empty one."""
    return [tuple(item[i : i + window]) for i in range(max(1, len(item) - window + 1))] if item else []


class Block:
    """Test phrases with their items, over numbered words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        own: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            for p in phrases(text, window):
                own.setdefault(p, set()).add(name)
        self.words = sorted({w for p in own for w in p})
        number_of = {w: i for i, w in enumerate(self.words)}
        self.items = sorted({name for _, name in ((p, n) for p, s in own.items() for n in s)})
        number = {name: i for i, name in enumerate(self.items)}
        self.length = np.array([len(p) for p in own], np.int64)
        self.terms = np.full((len(own), window), -1, np.int64)
        for i, p in enumerate(own):
            self.terms[i, : len(p)] = [number_of[w] for w in p]
        self.offsets = np.where(self.terms >= 0, np.arange(window), -1)
        self.owners = [np.array(sorted(number[n] for n in s)) for s in own.values()]

    def order(self, counts: np.ndarray) -> None:
        """Put every phrase's words in order of their counts, the rarest first."""
        rare = np.where(self.terms >= 0, counts[self.terms], np.iinfo(np.int64).max)
        by = np.argsort(rare, axis=1, kind="stable")
        self.terms, self.offsets = np.take_along_axis(self.terms, by, 1), np.take_along_axis(self.offsets, by, 1)


def blocks(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW) -> Iterator[Block]:
    """The test set in blocks, read one partition at a time."""
    held, n = [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        own = words(r["t"])
        if own:
            held.append((r["i"] or "", own))
            n += len(own)
        if n >= BLOCK_WORDS:
            yield Block(held, window)
            held, n = [], 0
    if held:
        yield Block(held, window)


def bitmap(benchmark: DataFrame, *, text: str = "text") -> np.ndarray:
    """BITS bits, packed: which remainders the words of the test set have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {zlib.crc32(w) % BITS for t in batch.column(0) for w in words(t.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.int32())], ["bit"])

    found = benchmark.select(F.col(text).alias("t")).mapInArrow(run, "bit int").distinct().toArrow()  # BITS rows at most
    bits = np.zeros(BITS, bool)
    bits[found.column(0).to_numpy()] = True
    return np.packbits(bits)


class Known(dict):
    """Whether a word passes the bitmap; words asked for before are remembered, up to a bound."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __missing__(self, word: bytes) -> bool:
        if len(self) > 1 << 18:
            self.clear()
        held = self[word] = self.bits[zlib.crc32(word) % BITS] == 1
        return held


class Numbers(dict):
    """Numbers of a shard's terms as they come; -1 for words that aren't kept."""

    def __init__(self, known: Known):
        self.known, self.terms = known, []

    def __missing__(self, word: bytes) -> int:
        number = -1
        if self.known[word]:
            number = len(self.terms)
            self.terms.append(word)
        self[word] = number
        return number


#: A posting list has its term and, one after another, documents (numbered in the shard) and positions; a shard's own row has no term but its documents.
INDEX = "shard long, term binary, docs array<int>, positions array<int>, doc_id array<long>, th array<long>, n_words array<long>"


def build_index(documents: DataFrame, bits, *, text: str = "text") -> DataFrame:
    """Posting lists by shard and term, and a row for each shard with its documents: INDEX.

    bits: a broadcast bitmap(); other words are only counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(np.unpackbits(bits.value).tobytes())
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, at = utf8(batch.column("text"))
            i = 0
            while i < batch.num_rows:  # a word has two bytes at least with what divides it
                j = max(i + 1, int(np.searchsorted(at, at[i] + 2 * SHARD, "right")) - 1)
                yield lists(batch.slice(i, j - i), shard, known)
                i, shard = j, shard + 1

    def lists(rows: pa.RecordBatch, shard: int, known: Known) -> pa.RecordBatch:
        number, n_words, found = Numbers(known), [], [np.empty((0, 3), np.int32)]
        for d, t in enumerate(rows.column("text").to_pylist()):
            own = words(t)
            n_words.append(len(own))
            ids = np.fromiter(map(number.__getitem__, own), np.int32, len(own))
            at = np.nonzero(ids >= 0)[0]
            found.append(np.stack([ids[at], np.full(len(at), d), at], 1).astype(np.int32))
        flat, terms = np.concatenate(found), number.terms
        by = np.argsort(flat[:, 0], kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(flat[:, 0], minlength=len(terms))), [len(flat)]]).astype(np.int32)
        n = len(terms) + 1  # the last row is the shard's own

        def only_last(values, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(np.array([0] * n + [len(values)], np.int32), pa.array(values, kind))

        postings = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(flat[by, k]))) for k in (1, 2)]
        ids, ths = (rows.column(c).to_pylist() for c in ("doc_id", "th"))
        columns = [pa.array(np.full(n, shard)), pa.array([*terms, None], pa.binary()), *postings, only_last(ids, pa.int64()), only_last(ths, pa.int64()), only_last(n_words, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INDEX.split(", ")])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(run, INDEX)


def shard_documents(index: DataFrame) -> DataFrame:
    """doc_id, th, n_words: one row for each row of documents."""
    return index.where("term is null").select(F.explode(F.arrays_zip("doc_id", "th", "n_words")).alias("x")).select("x.*")


def term_counts(index: DataFrame, terms: DataFrame, n: int) -> np.ndarray:
    """Occurrences of each of the n terms(term, number) over the whole index."""
    counts = index.where("term is not null").select("term", F.size("positions").alias("n")).groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(n, np.int64)
    for r in counts.join(F.broadcast(terms), "term").select("number", "n").collect():  # a block's terms at most
        out[r["number"]] = r["n"]
    return out


def _matches(block: Block, keys: np.ndarray, size: int, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, start) of the occurrences in a shard; keys: word * size + place, sorted."""
    lo = np.searchsorted(keys, block.terms[:, 0] * size)
    n = np.searchsorted(keys, (block.terms[:, 0] + 1) * size) - lo
    some = np.nonzero(n)[0]
    past = np.cumsum(n[some])
    at = 0
    while at < len(some):
        upto = max(at + 1, int(np.searchsorted(past, (past[at - 1] if at else 0) + CANDIDATES, "right")))
        own = some[at:upto]
        at = upto
        phrase = np.repeat(own, n[own])
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        start = keys[lo[phrase] + within] - block.terms[phrase, 0] * size - block.offsets[phrase, 0]
        for j in range(1, block.terms.shape[1]):
            if not len(phrase):
                break
            term, place = block.terms[phrase, j], start + block.offsets[phrase, j]
            first = np.maximum(place - slop, 0)
            i = np.minimum(np.searchsorted(keys, term * size + first), len(keys) - 1)
            ok = (term < 0) | ((keys[i] >= term * size + first) & (keys[i] <= term * size + np.minimum(place + slop, size - 1)) & (place + slop >= 0))
            phrase, start = phrase[ok], start[ok]
        if len(phrase):
            yield phrase, start


def search(index: DataFrame, terms: DataFrame, block, *, slop: int = 0) -> DataFrame:
    """doc_id, th, n_words, items, spans: one row for each row of documents.

    items: the items with matching phrases, as strings in order; spans: the words
    (first, past the last) that matches cover, merged. slop 0 matches exact
    phrases; a larger one also phrases whose words lie up to slop places from where
    the phrase has them, counted from its rarest word (then a span is where the
    phrase would lie, cut to the text). block: a Block, shipped; terms: its words as
    terms(term, number).
    """

    def run(lists: pa.Table) -> pa.Table:
        number = lists.column("number").to_numpy()
        return shard(received(block), lists.filter(pa.array(number < 0)), lists.filter(pa.array(number >= 0)))

    def shard(own: Block, documents: pa.Table, lists: pa.Table) -> pa.Table:
        doc_id, th, counted = (documents.column(c).combine_chunks().flatten() for c in ("doc_id", "th", "n_words"))
        n_words = counted.to_numpy(zero_copy_only=False)
        docs, positions = (lists.column(c).combine_chunks() for c in ("docs", "positions"))
        term = np.repeat(lists.column("number").to_numpy().astype(np.int64), np.diff(docs.offsets.to_numpy()))
        # Places are numbered through the shard, with room between documents.
        room = own.terms.shape[1] + slop if slop else 0
        base = np.cumsum(n_words + room) - (n_words + room)
        size = int((n_words + room).sum()) + 1
        keys = np.sort(term * size + base[docs.flatten().to_numpy()] + positions.flatten().to_numpy())
        cover = np.zeros(size + 1, np.int32)
        items: list[set[int]] = [set() for _ in range(len(n_words))]
        for phrase, start in _matches(own, keys, size, slop) if len(keys) else ():
            end = start + own.length[phrase]
            doc = np.searchsorted(base, start + own.offsets[phrase, 0], "right") - 1
            if slop:
                start, end = np.maximum(start, base[doc]), np.minimum(end, base[doc] + n_words[doc])
            inside = (start >= base[doc]) & (end <= base[doc] + n_words[doc])
            phrase, start, end, doc = phrase[inside], start[inside], end[inside], doc[inside]
            np.add.at(cover, start, 1)
            np.add.at(cover, end, -1)
            for d, p in np.unique(np.stack([doc, phrase], 1), axis=0):
                items[d].update(own.owners[p].tolist())
        hit = np.cumsum(cover)[:size] > 0
        edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        # A stretch that runs on into the next document is cut at its start.
        cuts = base[1:][hit[base[1:]] & hit[base[1:] - 1] & (n_words[1:] > 0)] if len(n_words) > 1 else base[:0]
        first, last = np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([last, cuts]))
        doc = np.searchsorted(base, first, "right") - 1
        spans: list[list[dict]] = [[] for _ in range(len(n_words))]
        for d, a, b in zip(doc.tolist(), (first - base[doc]).tolist(), (last - base[doc]).tolist(), strict=True):
            spans[d].append({"s": a, "e": b})
        names = [sorted(own.items[i] for i in x) for x in items]
        columns = [doc_id, th, counted, pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))]
        return pa.table(columns, names=["doc_id", "th", "n_words", "items", "spans"])

    wanted = index.join(F.broadcast(terms), "term", "left").where("term is null or number is not null").withColumn("number", F.coalesce("number", F.lit(-1)))
    return wanted.drop("term").groupBy("shard").applyInArrow(run, "doc_id long, th long, n_words long, items array<string>, spans array<struct<s:long,e:long>>")


def contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, th, n_words, n_hit, items, spans; one row for each row of documents.

    n_hit: words inside any matching phrase. Null and empty texts have no words and
    no hits; null or empty items match nothing; items with equal ids are one item;
    equal phrases of several items count for each. th is a hash of the text: rows
    with equal doc_id and th have equal results, other rows with equal ids are
    judged by themselves.
    """
    spark, found = documents.sparkSession, []
    small_batches(spark)
    index = stored(build_index(documents, spark.sparkContext.broadcast(bitmap(benchmark))), "postings")
    for block in blocks(benchmark, window=window):
        terms = spark.createDataFrame(pa.table({"term": pa.array(block.words, pa.binary()), "number": pa.array(range(len(block.words)), pa.int32())}))  # BLOCK_WORDS at most
        block.order(term_counts(index, terms, len(block.words)))
        found.append(search(index, terms, shipped(spark, block), slop=slop))
    if not found:
        found = [shard_documents(index).withColumns({"items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<s:bigint,e:bigint>>")})]
    if len(found) == 1:
        out = found[0]
    else:
        out = found[0].where("false")
        for f in found:
            out = out.unionByName(f.where("size(items) > 0"))
        # A document's hits in all blocks are as long as the document at most.
        out = out.dropDuplicates(["doc_id", "th", "items", "spans"]).groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        merged = F.aggregate("spans", F.array().cast("array<struct<s:bigint,e:bigint>>"), lambda acc, x: F.when((F.size(acc) > 0) & (x["s"] <= F.element_at(acc, -1)["e"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x))))
        out = out.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "items", merged.alias("spans"))
        rows = shard_documents(index)
        out = rows.join(out, rows["doc_id"].eqNullSafe(out["_d"]) & (rows["th"] == out["_t"]), "left").select("doc_id", "th", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return out.select("doc_id", "th", "n_words", hits.alias("n_hit"), "items", "spans")


def keep_clean(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The rows of documents that hold no phrase of the test set, as they are."""
    hit = contamination(documents, benchmark, window=window).where("n_hit > 0").select(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("d"), F.col("th").alias("t")).alias("_hit"))
    hit = stored(hit, "hits")  # a stored list has a known size, by which Spark chooses how to join it
    own = fresh(documents, "_key")
    keyed = documents.withColumn(own, F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")))
    return keyed.join(hit, keyed[own] == hit["_hit"], "left_anti").drop(own)
