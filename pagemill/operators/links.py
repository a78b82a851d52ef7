"""Link annotations: target classes, titles, rendering and coverage."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import constants as C
from pagemill.functions import text as X

_NET = r"^(?i:https)://([^/?#]*)"


def is_link(subtype: Column, uri: Column) -> Column:
    return uri.isNotNull() | F.lower(subtype).rlike("link'*$")


@F.pandas_udf(T.BooleanType())
def _special(host: pd.Series) -> pd.Series:
    def one(x: str | None) -> bool:
        try:
            a = ipaddress.ip_address(x or "")
        except ValueError:
            return False
        return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_unspecified or a.is_multicast

    return host.map(one)


def target_kind(links: DataFrame, url: str = "uri") -> DataFrame:
    """Adds target: unsafe (no clean https address), local (this machine or a private network), invalid or ok.

    invalid: links come with left, bottom, right and top, and these are no rectangle.
    Python sees numeric hosts only, and null for the others.
    """
    u = F.col(url)
    net = F.regexp_extract(u, _NET, 1)
    port = F.regexp_extract(net, r":([^:\]]*)$", 1)
    fine = u.isNotNull() & ~u.rlike(r"(?U)[\s\x00-\x1f]") & u.rlike(_NET) & (net != "") & ~F.contains(net, F.lit("@")) & ((port == "") | (port.rlike(r"^[0-9]{1,5}$") & (F.coalesce(F.try_to_number(port, F.lit("99999")), F.lit(0)) <= 65535)))
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(net, r":[^:\]]*$", ""), r"^\[|\]$", ""), r"\.+$", ""))
    rows = links.withColumn("_host", F.when(F.coalesce(fine, F.lit(False)) & (host != ""), host))
    known = F.col("_host")
    numeric = F.coalesce(known.rlike(r"^[0-9.]+$|:"), F.lit(False))
    private = _special(F.when(numeric, known))  # null for every other host
    local = F.when(numeric, private).otherwise(known.rlike(r"(^|\.)localhost$"))
    out = rows.withColumn("target", F.when(known.isNull(), "unsafe").when(local, "local").otherwise("ok")).drop("_host")
    sides = [c for c in ("left", "bottom", "right", "top") if c in links.columns]
    if len(sides) < 4:
        return out
    finite = F.lit(True)
    for c in sides:
        x = F.col(c).cast("double")
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = F.coalesce(finite & (F.col("left") < F.col("right")) & (F.col("bottom") < F.col("top")), F.lit(False))
    return out.withColumn("target", F.when((F.col("target") == "ok") & ~sound, "invalid").otherwise(F.col("target")))


CODES = {"unsafe": "NATIVE_PDF_LINK_UNSAFE_URL", "local": "NATIVE_PDF_LINK_LOCAL_TARGET", "invalid": "NATIVE_PDF_LINK_INVALID_ANNOTATION"}


def rejected_counts(links: DataFrame) -> DataFrame:
    """doc_id, page_number, code, n of links whose target isn't ok."""
    code = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return links.where("target <> 'ok'").groupBy("doc_id", "page_number", F.element_at(code, F.col("target")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def titles(links: DataFrame, visible: DataFrame, geometry: DataFrame) -> DataFrame:
    """links with visible_title, where exactly one title is in sight.

    links(doc_id, page_number, link_idx, left, bottom, right, top) in page space (origin
    below); visible(line_id, text, x0, x1, top, bottom) in text space (origin above). A
    title starts up to 18 units below the rectangle and inside it; the lines that follow
    within 6 units, while each is the only one, belong to it. Otherwise a line up to 18
    units above and right of it is the title.
    """
    key = ["doc_id", "page_number", "link_idx"]
    at = links.join(geometry, ["doc_id", "page_number"]).withColumn("a_top", F.col("height") - F.col("top")).withColumn("a_bottom", F.col("height") - F.col("bottom")).select(*key, "left", "right", "a_top", "a_bottom").alias("k")
    v = visible.select("doc_id", "page_number", F.struct("top", "x0", "line_id", "bottom", "x1", "text").alias("v")).alias("v")
    pairs = at.join(v, (F.col("k.doc_id") == F.col("v.doc_id")) & (F.col("k.page_number") == F.col("v.page_number")))
    grouped = pairs.groupBy(*(F.col(f"k.{c}").alias(c) for c in key), "left", "right", "a_top", "a_bottom").agg(F.array_sort(F.collect_list("v.v")).alias("all"))
    inside = F.filter("all", lambda x: (x["x0"] >= F.col("left") - 3) & (x["x1"] <= F.col("right") + 3))
    grouped = grouped.withColumn("inside", inside)
    below = F.filter("inside", lambda x: (x["top"] - F.col("a_bottom")).between(0, 18))
    grouped = grouped.withColumn("below", below)
    starts = F.filter("below", lambda x: ~F.exists("below", lambda o: (o["line_id"] != x["line_id"]) & (x["top"] - o["bottom"]).between(0, 6)))
    right = F.filter("all", lambda x: (F.col("a_top") - x["bottom"]).between(0, 18) & (x["x0"] - F.col("right")).between(0, 18))
    grouped = grouped.withColumn("starts", starts).withColumn("beside", right)
    first = F.element_at("starts", 1)
    state = F.struct(first.alias("last"), first["text"].alias("title"), F.lit(False).alias("done"))

    def follow(s: Column, _: Column) -> Column:
        nxt = F.filter("inside", lambda x: (x["top"] - s["last"]["bottom"]).between(0, 6))
        one = F.get(nxt, F.lit(0))
        glued = F.endswith(s["title"], F.lit("-")) & F.left(one["text"], F.lit(1)).rlike(r"\p{Ll}")
        title = F.when(glued, F.concat(F.substring(s["title"], F.lit(1), F.length(s["title"]) - 1), one["text"])).otherwise(F.concat(s["title"], F.lit(" "), one["text"]))
        stop = s["done"] | (F.size(nxt) != 1)
        return F.when(stop, F.struct(s["last"].alias("last"), s["title"].alias("title"), F.lit(True).alias("done"))).otherwise(F.struct(one.alias("last"), title.alias("title"), F.lit(False).alias("done")))

    joined = F.aggregate("inside", state, follow)["title"]
    title = F.when(F.size("starts") == 1, joined).when(F.size("beside") == 1, F.element_at("beside", 1)["text"])
    return links.join(grouped.select(*key, title.alias("visible_title")), key, "left")


def render_links(links: DataFrame, neutral: str = "Link") -> DataFrame:
    """doc_id, page_number, markdown: the link list of each page."""
    label = X.escape_label(F.coalesce("visible_title", F.lit(neutral)))
    line = F.concat(F.lit("- ["), label, F.lit("](<"), F.col("uri"), F.lit(">)"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_idx", line.alias("line")))), lambda x: x["line"]), "\n")
    return links.groupBy("doc_id", "page_number").agg(body.alias("body")).select("doc_id", "page_number", F.concat(F.lit(f"<!-- {C.NAMESPACE}:native-pdf-links page="), F.col("page_number").cast("string"), F.lit(f" -->\n{C.LINKS_TITLE}\n"), "body").alias("markdown"))
