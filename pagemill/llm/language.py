"""Language identification by compression.

A zstandard raw-content dictionary is made for each language from a bounded
sample of labelled documents. A text is cut into segments of SEGMENT bytes, every
segment is compressed whole with every dictionary, and the language with the fewest
bytes wins. A narrow margin to the second language rejects the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import small_batches, uniform

#: Bounds of what is learned from: documents and bytes of text for each language, and characters of one document.
SAMPLE_DOCS, SAMPLE_BYTES, DOC_CHARS = 256, 1 << 17, 512
#: Languages whose dictionaries a task holds at once; more are taken in turn.
LANGUAGES = 256
SEGMENT = 2048
#: Bytes that make one language e times likelier than another in the score.
TEMPERATURE = 6.0


def learn(labelled: DataFrame, *, docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, doc_chars: int = DOC_CHARS) -> list[tuple[str, bytes]]:
    """(language, dictionary) for each language of labelled(doc_id, text, lang), the most frequent first.

    Of each language the `docs` documents with the smallest id hash are read, and the
    first doc_chars characters of each, so that no long document fills a dictionary;
    both bound the sample, not what is classified. Null languages and texts teach
    nothing; no rows, no languages. Repeated ids count as often as they occur, and
    other columns are not read.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", uniform(F.col("doc_id")).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    order, own = sorted(counts, key=lambda x: (-counts[x], x)), []
    for i in range(0, len(order), LANGUAGES):
        some = order[i : i + LANGUAGES]
        # A cut on the hash leaves about twice the sample before anything is ranked.
        share = F.create_map(*(F.lit(x) for lang in some for x in (lang, min(1.0, (2.0 * docs + 100) / counts[lang]))))
        cut = rows.where(F.col("h") < F.element_at(share, F.col("lang"))).select("lang", "h", F.left("text", F.lit(doc_chars)).alias("text"))
        few = cut.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("i") <= docs)
        texts: dict[str, list[bytes]] = {lang: [] for lang in some}
        for r in sorted(few.collect(), key=lambda r: (r["lang"], r["i"])):
            texts[r["lang"]].append(_plain(r["text"]) + b"\n")
        own += [(lang, b"".join(texts[lang])[:most_bytes]) for lang in some]
    return own


def _plain(text: str) -> bytes:
    """Letters in lower case; whatever lies between them is one space."""
    return re.sub(r"[\W\d_]+", " ", text.lower()).encode()


def packers(dictionaries: list[bytes], level: int) -> list:
    import zstandard as Z

    out = []
    for own in dictionaries:
        d = Z.ZstdCompressionDict(own, dict_type=Z.DICT_TYPE_RAWCONTENT) if len(own) >= 8 else None
        if d:
            d.precompute_compress(level=level)
        out.append(Z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    return out


SIZES = "best string, least double, second double, log_sum double"


def _pack(shared, level: int, alone: bool, last: bool):
    """Compress with one block of dictionaries, and bring best, second and the sum of all likelihoods forward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        names, pack = [name for name, _ in block], packers([own for _, own in block], level)
        for batch in batches:
            found = []
            for text, best, least, second, log_sum in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                if text is None or not any(map(str.isalpha, text)):
                    found.append((None, None, None, None))
                    continue
                raw = _plain(text)
                segments = [raw[i : i + SEGMENT] for i in range(0, len(raw), SEGMENT)]
                sizes = np.array([sum(len(p(s)) for s in segments) for p in pack], float)
                if alone:
                    second = float(len(raw) + 16)
                i = int(sizes.argmin())
                few = sorted([*np.partition(sizes, min(1, len(sizes) - 1))[:2].tolist(), *(x for x in (least, second) if x is not None)])
                if least is None or sizes[i] < least:
                    best, least = names[i], float(sizes[i])
                own = float(-least / TEMPERATURE + np.log(np.exp((least - sizes) / TEMPERATURE).sum()))
                found.append((best, least, few[1], own if log_sum is None else float(np.logaddexp(log_sum, own))))
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), *[pa.float64()] * 3), strict=True)] if found else [pa.array([], t) for t in (pa.string(), *[pa.float64()] * 3)]
            head = batch.columns[:1] if last else batch.columns[:2]
            yield pa.RecordBatch.from_arrays([*head, *columns], [*(["doc_id"] if last else ["doc_id", "text"]), "best", "least", "second", "log_sum"])

    return run


def classify(documents: DataFrame, model: list[tuple[str, bytes]], *, level: int = 9, min_margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected; one row for each of documents, repeated ids included.

    Every byte of the letters of a text is compressed with every dictionary, however
    long it is. lang_pred: `und` where the text is null or has no letter, or nothing
    was learned; ties go to the language with more training documents. margin: bytes
    saved against the second language, as a part of the second's. rejected: the
    margin is under min_margin. score: the softmax of the sizes, 0 for `und`. No
    documents give no rows; other columns are not read. Dictionaries are broadcast
    LANGUAGES at a time.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long"), "text", *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in SIZES.split(", "))))
    for i in range(0, len(model), LANGUAGES):
        last = i + LANGUAGES >= len(model)
        shared = spark.sparkContext.broadcast(model[i : i + LANGUAGES])  # LANGUAGES * SAMPLE_BYTES at most
        rows = rows.mapInArrow(_pack(shared, level, len(model) == 1, last), f"doc_id long, {'' if last else 'text string, '}{SIZES}")
    known = F.col("best").isNotNull()
    margin = F.when(known, F.greatest(F.lit(0.0), (F.col("second") - F.col("least")) / F.col("second"))).otherwise(0.0)
    score = F.when(known, F.least(F.lit(1.0), F.exp(-F.col("least") / TEMPERATURE - F.col("log_sum")))).otherwise(0.0)
    return rows.select("doc_id", F.coalesce("best", F.lit("und")).alias("lang_pred"), score.alias("score"), margin.alias("margin"), (~known | (margin < min_margin)).alias("rejected"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in `part` of `parts`; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
