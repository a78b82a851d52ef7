"""Raster images and caption-bound vector figures."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import constants as C

PAGE = ["doc_id", "page_number"]
GAP = 14.0


def image_kind(images: DataFrame) -> DataFrame:
    """images with figure_number (all of a page count) and kind: decorative, jpg, png or unsupported."""
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("image_idx"))
    area = F.col("width").cast("long") * F.col("height")
    jpeg = lambda c: F.substring(F.col(c), 1, 3) == F.lit(b"\xff\xd8\xff")
    channels = F.when(F.col("color_space") == "DeviceRGB", 3).when(F.col("color_space").isin("DeviceGray", "Indexed"), 1)
    flate = (F.col("filter") == "FlateDecode") & (F.col("bits") == 8) & (F.octet_length("decoded") == area * channels)
    if "palette" in images.columns:  # whole colours, 256 at most
        sound = F.octet_length("palette").between(3, 768) & (F.octet_length("palette") % 3 == 0)
        flate = flate & ((F.col("color_space") != "Indexed") | F.coalesce(sound, F.lit(False)))
    else:
        flate = flate & (F.col("color_space") != "Indexed")
    kind = F.when(~F.coalesce(area >= C.MIN_IMAGE_AREA, F.lit(True)), "decorative").when(jpeg("raw") | jpeg("decoded"), "jpg").when(F.coalesce(flate, F.lit(False)), "png").otherwise("unsupported")
    return images.withColumn("figure_number", number).withColumn("kind", kind)


def figure_id(page: Column, number: Column) -> Column:
    return F.format_string("page-%03d-figure-%02d", page, number)


@F.pandas_udf(T.BinaryType())
def png(width: pd.Series, height: pd.Series, channels: pd.Series, pixels: pd.Series) -> pd.Series:
    """8-bit grey or RGB pixels as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def one(w: int, h: int, c: int, raw: bytes) -> bytes:
        rows = b"".join(b"\0" + raw[i * w * c : (i + 1) * w * c] for i in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    return pd.Series([one(int(w), int(h), int(c), bytes(p)) for w, h, c, p in zip(width, height, channels, pixels, strict=True)])


@F.pandas_udf(T.BinaryType())
def rgb_of_palette(pixels: pd.Series, palette: pd.Series) -> pd.Series:
    """8-bit indices as RGB, by a palette of three bytes a colour; indices past its end are black."""

    def one(raw: bytes | None, colours: bytes | None) -> bytes | None:
        if raw is None or colours is None:
            return None
        table = np.frombuffer(bytes(colours)[:768].ljust(768, b"\0"), np.uint8).reshape(256, 3)
        return table[np.frombuffer(bytes(raw), np.uint8)].tobytes()

    return pd.Series([one(r, c) for r, c in zip(pixels, palette, strict=True)])


def png_files(images: DataFrame) -> DataFrame:
    """images of kind png with file: grey and RGB pixels as they are, indexed ones through their palette."""
    indexed = F.col("color_space") == "Indexed"
    pixels = F.coalesce(rgb_of_palette(F.when(indexed, F.col("decoded")), F.when(indexed, F.col("palette"))), F.col("decoded"))
    channels = F.when(F.col("color_space") == "DeviceGray", 1).otherwise(3)
    return images.where("kind = 'png'").withColumn("file", png("width", "height", channels, pixels))


def boxes(primitives: DataFrame) -> DataFrame:
    """Finite boxes with ordered edges; a side without extent gets 0.1."""
    sides = ("x0", "top", "x1", "bottom")
    fine = F.lit(True)
    for c in sides:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    out = primitives.where(fine & (F.col("x0") <= F.col("x1")) & (F.col("top") <= F.col("bottom")))
    return out.withColumn("x1", F.when(F.col("x0") == F.col("x1"), F.col("x1") + 0.1).otherwise(F.col("x1"))).withColumn("bottom", F.when(F.col("top") == F.col("bottom"), F.col("bottom") + 0.1).otherwise(F.col("bottom")))


def components(rows: DataFrame) -> DataFrame:
    """doc_id, page_number, component, x0, top, x1, bottom, n: boxes that touch within GAP, merged in their order.

    A box joins all components that it touches; their union may then touch others, which
    only a later box sees. That depends on the order, so it is a fold over a page.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, page, own in zip(f["doc_id"], f["page_number"], f["boxes"], strict=True):
                merged: list[tuple] = []
                for b in own:
                    box, n, rest = (b["x0"], b["top"], b["x1"], b["bottom"]), 1, []
                    near = [m for m in merged if m[0][0] - GAP <= box[2] and box[0] - GAP <= m[0][2] and m[0][1] - GAP <= box[3] and box[1] - GAP <= m[0][3]]
                    rest = [m for m in merged if m not in near]
                    for m, k in near:
                        box, n = (min(box[0], m[0]), min(box[1], m[1]), max(box[2], m[2]), max(box[3], m[3])), n + k
                    merged = [*rest, (box, n)]
                out += [(doc, page, i, *box, n) for i, (box, n) in enumerate(merged)]
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "component", "x0", "top", "x1", "bottom", "n"])

    pages = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("prim_idx", "x0", "top", "x1", "bottom"))).alias("boxes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return pages.mapInPandas(run, f"doc_id {kind}, page_number int, component int, x0 double, top double, x1 double, bottom double, n int")


def figure_candidates(parts: DataFrame, captions: DataFrame, words: DataFrame, geometry: DataFrame) -> DataFrame:
    """doc_id, page_number, caption, x0, top, x1, bottom, n: captions with exactly one fitting component, which fits no other caption.

    Fitting: three primitives or more, a fifth of the width and a tenth of the height, up
    to 42 units above the caption and over a quarter of it (12 units at most), not the
    whole page, and at most three tenths covered by words.
    """
    p, c, g = parts.alias("p"), captions.alias("c"), geometry.alias("g")
    same = lambda a, b: (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.page_number") == F.col(f"{b}.page_number"))
    w, h = F.col("p.x1") - F.col("p.x0"), F.col("p.bottom") - F.col("p.top")
    over = F.least("p.x1", "c.x1") - F.greatest("p.x0", "c.x0")
    gap = F.col("c.top") - F.col("p.bottom")
    fits = (F.col("p.n") >= 3) & (w >= F.col("g.width") * 0.2) & (h >= F.col("g.height") * 0.1) & gap.between(0, 42) & (over >= F.least(F.lit(12.0), (F.col("c.x1") - F.col("c.x0")) * 0.25)) & ~((w >= F.col("g.width") * 0.96) & (h >= F.col("g.height") * 0.96))
    pairs = p.join(g, same("p", "g")).join(c, same("p", "c") & fits).select("p.doc_id", "p.page_number", "p.component", F.col("c.caption").alias("caption"), F.col("c.caption_idx").alias("caption_idx"), "p.x0", "p.top", "p.x1", "p.bottom", "p.n")
    q, v = pairs.alias("q"), words.alias("v")
    x, y = (F.col("v.x0") + F.col("v.x1")) / 2, (F.col("v.top") + F.col("v.bottom")) / 2
    inside = same("q", "v") & x.between(F.col("q.x0"), F.col("q.x1")) & y.between(F.col("q.top"), F.col("q.bottom"))
    text = q.join(v, inside, "left").groupBy("q.doc_id", "q.page_number", "q.component", "q.caption_idx", "q.caption", "q.x0", "q.top", "q.x1", "q.bottom", "q.n").agg(F.coalesce(F.sum((F.col("v.x1") - F.col("v.x0")) * (F.col("v.bottom") - F.col("v.top"))), F.lit(0.0)).alias("covered"))
    good = text.where(F.col("covered") / ((F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))) <= 0.3)
    alone = F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "caption_idx"))
    shared = F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "component"))
    return good.withColumn("_a", alone).withColumn("_b", shared).where("_a = 1 and _b = 1").select(*PAGE, "caption", "x0", "top", "x1", "bottom", "n")


def number_figures(candidates: DataFrame, assets: DataFrame) -> DataFrame:
    """candidates with asset_id: numbers go on after the page's assets, by top and left."""
    have = assets.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("have"))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("top", "x0"))
    out = candidates.withColumn("place", place).join(have, PAGE, "left")
    return out.withColumn("asset_id", figure_id(F.col("page_number"), (F.col("place") + F.coalesce("have", F.lit(0))).cast("int"))).drop("place", "have")


def crop(candidates: DataFrame, geometry: DataFrame, dpi: int) -> DataFrame:
    """candidates with pixel edges at dpi and valid: on the page and not all of it."""
    scale = dpi / 72
    out = candidates.join(geometry, PAGE)
    out = out.select("*", F.floor(F.col("x0") * scale).alias("left_px"), F.floor(F.col("top") * scale).alias("top_px"), F.ceil(F.col("x1") * scale).alias("right_px"), F.ceil(F.col("bottom") * scale).alias("bottom_px"))
    w, h = F.ceil(F.col("width") * scale), F.ceil(F.col("height") * scale)
    on = (F.col("left_px") >= 0) & (F.col("top_px") >= 0) & (F.col("right_px") <= w) & (F.col("bottom_px") <= h) & (F.col("left_px") < F.col("right_px")) & (F.col("top_px") < F.col("bottom_px"))
    whole = (F.col("left_px") == 0) & (F.col("top_px") == 0) & (F.col("right_px") == w) & (F.col("bottom_px") == h)
    return out.withColumn("valid", on & ~whole)
