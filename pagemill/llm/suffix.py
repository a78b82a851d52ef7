"""Repeated passages by a depth-limited radix sort of suffixes.

A window is the first DEPTH bytes of a suffix: two suffixes that agree that far are
one group, and groups of two or more are exactly the repeated windows. Suffixes are
put in order by most-significant-digit passes that stop at DEPTH, and whatever is
alone after a pass is not looked at again:

1. The first digit is a gram of GRAM bytes inside the window: the one with the
   least hash (the last such, on ties). Equal windows have it at the same offset,
   and neighbouring windows share it, so a run of windows (about 70) is one row:
   its gram's hash, two hashes of the run's bytes, where it is. Rows are sorted over
   all partitions by range, text and place included, so a gram or a passage that a
   third of all rows share is dealt over many partitions. A gram that occurs once
   is dropped.
2. Rows that agree in the gram and in both content hashes (192 bits) are one
   content. All windows of a content that occurs twice repeat.
3. Of grams with several contents, one row of each content is read again, and its
   windows are sorted under their gram and its offset by successive digits of eight
   bytes, down to all DEPTH bytes; windows that are alone are dropped after each
   digit. Up to CROWD contents of a gram are sorted in one task; beyond, every
   window is a row, and Spark groups them by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import pieces, stored, utf8

DEPTH, GRAM = 200, 64
#: Bytes hashed at once; a longer text is cut into parts that overlap by a window.
CHUNK = 1 << 19
#: Contents under one gram that are still sorted in one task.
CROWD = 1000
#: Odd multipliers of the two rolling hashes, and of the final mix (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
LOW = (1 << 24) - 1


class Rolling:
    """Hashes of all substrings of a buffer: sum of table[byte] * base^i, modulo 2^64."""

    def __init__(self, which: int, most: int):
        base = np.uint64(BASES[which])
        inverse = np.uint64(pow(BASES[which], -1, 1 << 64))
        self.table = np.random.default_rng(which + 1).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, base, np.uint64)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, inverse, np.uint64)]), dtype=np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self.up[: len(raw)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, sums: np.ndarray, start, end) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])

    def every(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return mixed((sums[width:] - sums[:n]) * self.down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(MIX[0])
    x ^= x >> np.uint64(29)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(32)
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from running minima forwards and backwards in blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(raw: np.ndarray, at: np.ndarray, first: Rolling, second: Rolling, depth: int, gram: int):
    """Runs of windows with one gram in texts raw[at[i]:at[i + 1]].

    Gives text number, first window's start in the buffer, number of windows, the
    gram's offset from that start, the gram's hash and two hashes of the content.
    """
    none = np.empty(0, np.int64)
    nothing = none, none, none, none, *[none.astype(np.uint64)] * 3
    if len(raw) < depth:
        return nothing
    valid = np.zeros(len(raw) + 1, np.int32)
    long = np.diff(at) >= depth
    np.add.at(valid, at[:-1][long], 1)
    np.add.at(valid, at[1:][long] - depth + 1, -1)
    starts = np.nonzero(np.cumsum(valid[:-1])[: len(raw) - depth + 1])[0]
    if not len(starts):
        return nothing
    sums = first.sums(raw)
    grams = first.every(sums, gram)
    keyed = (grams & ~np.uint64(LOW)) | (np.uint64(LOW) - np.arange(len(grams), dtype=np.uint64))
    place = LOW - (sliding_min(keyed, depth - gram + 1)[starts] & np.uint64(LOW)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.nonzero(new)[0]
    n = np.diff(np.append(head, len(starts)))
    begin, place = starts[head], place[head]
    end = begin + n - 1 + depth
    contents = [h.of(x, begin, end) + n.astype(np.uint64) for h, x in ((first, sums), (second, second.sums(raw)))]
    return np.searchsorted(at, begin, "right") - 1, begin, n, place - begin, grams[place], *contents


RUN = ["a", "f", "g", "doc", "th", "start", "n", "off"]
RUN_TYPES = "a long, f long, g long, doc long, th long, start int, n int, off int"
#: Rows of a judged batch: a run whose windows all repeat; a content of a gram with several; a content of a gram that may go on in another batch.
WHOLE, SEVERAL, EDGE = 0, 1, 2


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs to kind, c (runs of a content) and the run.

    A batch's first and last gram may go on in other batches, of other tasks even: of
    those a row for each content goes on, with the runs counted here.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        a, f, g = (batch.column(i).to_numpy() for i in range(3))
        new_gram, new = np.ones(len(a), bool), np.ones(len(a), bool)
        new_gram[1:] = a[1:] != a[:-1]
        new[1:] = new_gram[1:] | (f[1:] != f[:-1]) | (g[1:] != g[:-1])
        head, content = np.nonzero(new)[0], np.cumsum(new) - 1
        c, gram = np.bincount(content), (np.cumsum(new_gram) - 1)[head]
        contents = np.bincount(gram)[gram]
        edge = (gram == 0) | (gram == gram[-1])
        whole = np.nonzero(c[content] > 1)[0]
        rest = np.nonzero(edge | (contents > 1))[0]
        kind = np.concatenate([np.full(len(whole), WHOLE), np.where(edge[rest], EDGE, SEVERAL)]).astype(np.int32)
        rows = batch.take(pa.array(np.concatenate([whole, head[rest]])))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[content[whole]], c[rest]])), *rows.columns, pa.array(kind)], ["c", *RUN, "kind"])


def _deal(depth: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Rolling(0, CHUNK + depth), Rolling(1, CHUNK + depth)
        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                raw, at = utf8(part.column("text"))
                keys = [part.column("doc").to_numpy(), part.column("th").to_numpy()]
                for lo in range(0, max(1, len(raw) - depth + 1), CHUNK):  # more than one only for a text over CHUNK, which is alone
                    some = raw[lo : lo + CHUNK + depth - 1]
                    text, begin, n, off, a, f, g = runs(some, at if len(some) == len(raw) else np.array([0, len(some)]), first, second, depth, gram)
                    if not len(text):
                        continue
                    begin = begin + lo - at[text]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (a, f, g)), *(pa.array(k[text]) for k in keys), *(pa.array(x.astype(np.int32)) for x in (begin, n, off))], RUN)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, which is what goes through the shuffles."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [pack((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], [*batch.schema.names[:-1], "packed"])


def _slices(depth: int):
    """The bytes of the chosen runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                lists = some.column("runs")
                flat = lists.flatten()
                count = np.diff(lists.offsets.to_numpy())
                start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                texts = [unpack(t.as_py()) for t in some.column("packed")]
                owner = np.repeat(np.arange(len(texts)), count)
                cut = [texts[o][s : s + m - 1 + depth] for o, s, m in zip(owner, start, n, strict=True)]
                yield pa.RecordBatch.from_arrays([flat.field("a"), flat.field("c"), flat.field("many"), some.column("doc").take(pa.array(owner)), some.column("th").take(pa.array(owner)), flat.field("start"), flat.field("n"), flat.field("off"), pa.array(cut, pa.binary())], ["a", "c", "many", "doc", "th", "start", "n", "off", "bytes"])

    return run


def _windows(batch: pa.RecordBatch):
    """All bytes; and row number, number in its run and place in the bytes of every window of the runs."""
    raw, at = utf8(batch.column("bytes"))
    n = batch.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return raw, row, inner, at[row] + inner


def repeated(raw: np.ndarray, place: np.ndarray, under: np.ndarray, depth: int) -> np.ndarray:
    """Which of the windows raw[place : place + depth] equal another one under the same number.

    Most-significant-digit passes over digits of eight bytes: groups that a digit
    doesn't tell apart stay as they are, others are sorted by it and split, and what
    is alone goes.
    """
    width = min(8, depth)
    digits = np.ndarray(len(raw), ">u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    at = np.argsort(under, kind="stable")
    head = np.ones(len(at), bool)
    head[1:] = under[at[1:]] != under[at[:-1]]
    for shift in [*range(0, depth - width, width), depth - width]:
        alone = head & np.append(head[1:], True)
        at, head = at[~alone], head[~alone]
        if not len(at):
            break
        digit = digits[place[at] + shift].astype(np.uint64) >> np.uint64(64 - 8 * width)
        group = np.cumsum(head) - 1
        other = digit != digit[head][group]
        if other.any():
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[other]] = True
            some = np.nonzero(mixed[group])[0]
            order = some[np.lexsort((digit[some], group[some]))]
            at[some], digit[some] = at[order], digit[order]
            head[1:] |= digit[1:] != digit[:-1]
    alone = head & np.append(head[1:], True)
    out = np.zeros(len(place), bool)
    out[at[~alone]] = True
    return out


def _spans(batch: pa.RecordBatch, row: np.ndarray, inner: np.ndarray, hit: np.ndarray, depth: int) -> pa.RecordBatch:
    """Spans of the windows that are hit, of runs whose content occurs once; a row for each stretch of windows."""
    hit = hit & (batch.column("c").to_numpy() == 1)[row]
    row, inner = row[hit], inner[hit]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)
    head = np.nonzero(new)[0]
    last = np.append(head[1:], len(row))[: len(head)] - 1
    begin = batch.column("start").to_numpy()[row[head]] + inner[head]
    end = batch.column("start").to_numpy()[row[last]] + inner[last] + depth if len(head) else begin
    return pa.RecordBatch.from_arrays([pa.array(batch.column("doc").to_numpy()[row[head]]), pa.array(batch.column("th").to_numpy()[row[head]]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc", "th", "s", "e"])


def _sort(depth: int):
    """Windows that several contents of one gram share; rows come sorted by gram."""

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        raw, row, inner, place = _windows(rows)
        a = rows.column("a").to_numpy()
        gram = np.cumsum(np.concatenate([[0], a[1:] != a[:-1]]))[row]
        off = rows.column("off").to_numpy()[row] - inner
        return _spans(rows, row, inner, repeated(raw, place, gram * depth + off, depth), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                rows = pa.Table.from_batches([*kept, batch.slice(i, 2000)]).combine_chunks().to_batches()[0]
                a = rows.column("a").to_numpy()
                cut = int(np.searchsorted(a, a[-1]))  # the last gram may go on
                if cut:
                    yield done(rows.slice(0, cut))
                kept = [rows.slice(cut)]
        if kept:
            yield done(kept[0])

    return run


def _explode(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                rows = batch.slice(i, 100)
                raw, row, inner, place = _windows(rows)
                bytes_, take = raw.tobytes(), pa.array(row)
                windows = pa.array([bytes_[x : x + depth] for x in place.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([windows, *(rows.column(x).take(take) for x in ("c", "doc", "th")), pa.array((rows.column("start").to_numpy()[row] + inner).astype(np.int32))], ["w", "c", "doc", "th", "s"])

    return run


def repeated_spans(documents: DataFrame, *, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """doc, th, s, e: byte spans covered by repeated windows; spans may overlap.

    documents(doc, th, text): th is a hash of the text that tells apart rows with
    equal doc. Rows with both equal share their spans.
    """
    if not 1 <= gram <= depth < CHUNK // 4:
        raise ValueError("1 <= gram <= depth < a quarter of CHUNK")
    dealt = stored(documents.select("doc", "th", "text").mapInArrow(_deal(depth, gram), RUN_TYPES), "dealt")
    content = ["a", "f", "g"]
    judged = stored(dealt.repartitionByRange(*content, "doc", "start").sortWithinPartitions(*content).mapInArrow(_judge, f"c long, {RUN_TYPES}, kind int"), "judged")
    kind = lambda k: judged.where(F.col("kind") == k).drop("kind")
    # Grams that go over batches: few rows, as each stands for a batch's runs of its content.
    edges = stored(kind(EDGE), "edges")
    met = stored(edges.groupBy(*content).agg(F.sum("c").alias("c"), F.min(F.struct("doc", "th", "start", "n", "off")).alias("x")), "met")
    again = edges.where("c = 1").join(met.where("c > 1").select(*content), content, "left_semi")
    whole = kind(WHOLE).drop("c", *content).unionByName(again.drop("c", *content))
    whole = whole.select("doc", "th", F.col("start").alias("s"), (F.col("start") + F.col("n") + (depth - 1)).alias("e"))
    several = met.groupBy("a").agg(F.count(F.lit(1)).alias("n_f")).where("n_f > 1").select("a", (F.col("n_f") > CROWD).alias("many"))
    fields = ["a", "c", "many", "doc", "th", "start", "n", "off"]
    contents = kind(SEVERAL).withColumn("many", F.lit(False)).select(*fields).unionByName(met.join(several, "a").select("a", "c", "many", "x.*"))
    by_text = contents.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "c", "many", "start", "n", "off")).alias("runs"))
    packed = documents.select("doc", "th", "text").mapInArrow(_packed, "doc long, th long, packed binary")
    cut = by_text.join(packed, ["doc", "th"]).select("doc", "th", "packed", "runs").mapInArrow(_slices(depth), "a long, c long, many boolean, doc long, th long, start int, n int, off int, bytes binary")
    cut = stored(cut, "slices")
    few = cut.where("not many").repartition("a").sortWithinPartitions("a").mapInArrow(_sort(depth), "doc long, th long, s int, e int")  # CROWD contents of a gram at most
    out = whole.unionByName(few)
    if not cut.where("many").isEmpty():
        each = cut.where("many").mapInArrow(_explode(depth), "w binary, c long, doc long, th long, s int")
        shared = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
        out = out.unionByName(each.where("c = 1").join(shared, "w", "left_semi").select("doc", "th", "s", (F.col("s") + depth).alias("e")))
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come as doc_id, columns to hand through, packed, s, e."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            rows = []
            for packed, begin, end in zip(some.column("packed"), some.column("s"), some.column("e"), strict=True):
                raw = unpack(packed.as_py())
                spans = _union(list(zip(begin.as_py(), end.as_py(), strict=True))) if begin.is_valid else []
                kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True))
                rows.append((len(raw), len(raw) - len(kept), spans, kept))
            columns = list(zip(*rows, strict=True))
            spans = pa.array([[{"s": s, "e": e} for s, e in x] for x in columns[2]], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            shas = [hashlib.sha256(x).hexdigest() for x in columns[3]]
            texts = [x.decode(errors="ignore") for x in columns[3]]
            yield pa.RecordBatch.from_arrays([*some.columns[:-3], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), spans, pa.array(shas, pa.string()), pa.array(texts, pa.string())], [*some.schema.names[:-3], "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def remove_repeats(documents: DataFrame, *, text: str = "text", depth: int = DEPTH, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept_sha256, kept for each row of documents.

    Every byte inside a window of `depth` bytes that starts anywhere else as well is
    removed, all copies alike; windows stay within one text, and are judged on the
    texts as given. A null text is empty; a shorter text than a window loses nothing.
    Rows with equal ids are texts of their own. kept is the text without the removed
    bytes; a character that was cut in two is left out of it, while kept_sha256 is
    over all remaining bytes. An empty table gives an empty result. `carry` names
    columns to hand through, whatever their names but those of the result; other columns
    are not read.
    """
    own = ("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept")
    if clash := {c.lower() for c in carry or ()} & set(own):
        raise ValueError(f"columns of the result have these names: {sorted(clash)}")
    least = F.lit(-(1 << 63)).cast("long")
    doc_id = F.col("doc_id").cast("long")
    # What is handed through travels as one column, so its names meet none of those used here.
    through = F.struct(*carry) if carry else F.lit(None).cast("int")
    rows = documents.select(doc_id.alias("doc_id"), through.alias("through"), F.coalesce(doc_id, least).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    covered = repeated_spans(rows, depth=depth, gram=gram)
    covered = covered.groupBy("doc", "th").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    fields = f"doc_id long, through {rows.schema['through'].dataType.simpleString()}" if carry else "doc_id long, through int"
    packed = rows.select("doc_id", "through", "doc", "th", "text").mapInArrow(_packed, f"{fields}, doc long, th long, packed binary")
    joined = packed.join(covered, ["doc", "th"], "left").select("doc_id", "through", "packed", "s", "e")
    out = joined.mapInArrow(_apply, f"{fields}, n_bytes long, n_removed long, spans array<struct<s:int,e:int>>, kept_sha256 string, kept string")
    return out.select("doc_id", *(F.col(f"through.`{c}`").alias(c) for c in carry or ()), *own[1:])
