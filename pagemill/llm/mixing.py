"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words; a document of a source with target t
and size s is due p = t / s copies. The whole part is taken outright. The
fractional parts are rounded by the pivotal method: two fractional units are
paired and words are moved from one to the other, at random but without bias,
until one of them holds a whole copy or none. A pair's words stay the same, so a
source keeps its target up to the last fractional document, and every document
keeps its expected number of copies.

The documents that hold more than 1 / LONG of their source's words, LONG of them at
most, come first, the longest first: each is paired with all shorter documents of its
source as one unit, whose fractions rise or fall together. So a long document is
whole before the others are, and none is left to the end, where it would carry the
source off its target.

The others are paired one by one, folded within buckets of about BUCKET documents of
one source; every bucket leaves at most one fractional document, and those meet in
the next level of the tree, until each source has one bucket, where the last one is
rounded by its fraction. A level reads 1/BUCKET of the rows of the level before, and
no bucket depends on the size of its source, so a source with a third of all rows is
dealt over a third of all buckets.

DataFrame functions only. Randomness comes from hashes of document ids, and sums are
of whole numbers, so reruns agree whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import fresh, stored, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a bucket, on average: few enough for a fold that appends to an array.
BUCKET = 512
#: A document with more than this part of its source's words is paired with all shorter ones.
LONG = 2048
#: Equal rows that one row stands for while they are dealt out.
RANGE = 4096
#: Below this, a fraction is rounding noise of the division.
EPS = 1e-9


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, n, target for sizes(source, size).

    Sources in code point order (null last) get the weights in turn, and share the
    sum of all sizes by weight; a source stops at `most` times its size, and the
    excess is shared by weight among the others until none is above. That is the
    level L with sum(min(most * size, L * weight)) = sum(size), found by sorting
    sources by most * size / weight. One row a source: their number is a setting
    of the mixture and doesn't grow with the documents.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))
    each = each.withColumn("w", F.element_at(turn, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    each = each.withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(after)).withColumn("at", F.row_number().over(by_ratio))
    holds = F.col("left") * F.col("w") <= F.col("cap") * F.col("w_left")
    first = F.min(F.when(holds, F.struct("at", "left", "w_left"))).over(all_rows)
    each = each.withColumn("first", first)
    shared = F.col("first.left") * F.col("w") / F.col("first.w_left")
    target = F.when(F.col("at") < F.col("first.at"), F.col("cap").cast("double")).otherwise(F.least(shared, F.col("cap").cast("double")))
    return each.select("source", "source_size", "n", F.coalesce(target, F.lit(0.0)).alias("target"))


def _fold(items: Column, seed: int, level: int) -> Column:
    """Pair the items (doc_id, size, frac) of a bucket one after another, the longest first.

    A long document keeps its fraction until shorter ones have filled or emptied it,
    so what is left at the end is short. Returns out: items with frac 0 or 1, and carry: the last fractional one or null.
    """
    item = "struct<doc_id:bigint,size:bigint,frac:double>"
    start = F.struct(F.lit(None).cast(item).alias("carry"), F.array().cast(f"array<{item}>").alias("out"))

    def with_frac(x: Column, frac: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), frac.alias("frac"))

    def pair(state: Column, e: Column) -> Column:
        c = state["carry"]
        # Words that can go to c from e (up), or to e from c (down).
        room_c, held_c = (1 - c["frac"]) * c["size"], c["frac"] * c["size"]
        room_e, held_e = (1 - e["frac"]) * e["size"], e["frac"] * e["size"]
        up, down = F.least(room_c, held_e), F.least(held_c, room_e)
        goes_up = uniform(F.lit(seed), F.lit(level), c["doc_id"], e["doc_id"]) * (up + down) < down
        # Whoever reaches its end gets exactly 0 or 1; the other takes what moved.
        c_frac = F.when(goes_up, F.when(room_c <= held_e, 1.0).otherwise(c["frac"] + held_e / c["size"])).otherwise(F.when(held_c <= room_e, 0.0).otherwise(c["frac"] - room_e / c["size"]))
        e_frac = F.when(goes_up, F.when(held_e <= room_c, 0.0).otherwise(e["frac"] - room_c / e["size"])).otherwise(F.when(room_e <= held_c, 1.0).otherwise(e["frac"] + held_c / e["size"]))
        both = F.array(with_frac(c, c_frac), with_frac(e, e_frac))

        def split(two: Column) -> Column:
            whole = F.filter(two, lambda x: (x["frac"] <= EPS) | (x["frac"] >= 1 - EPS))
            rest = F.filter(two, lambda x: (x["frac"] > EPS) & (x["frac"] < 1 - EPS))
            return F.struct(F.get(rest, F.lit(0)).alias("carry"), F.concat(state["out"], whole).alias("out"))

        return F.when(c.isNull(), F.struct(with_frac(e, e["frac"]).alias("carry"), state["out"].alias("out"))).otherwise(split(both))

    return F.aggregate(items, start, pair)


def _settle_long(items: Column, held: Column, room: Column, seed: int) -> Column:
    """Pair each of the items (doc_id, size, frac), the longest first, with the pool of all that come after it.

    held and room: words that all documents of the source hold in fractions, and that
    they could take up. Pool fractions go from f to add + scale * f. Returns add,
    scale, and out: the items with their fractions, which are whole unless the pool is
    used up.
    """
    item = "struct<doc_id:bigint,size:bigint,frac:double>"
    start = F.struct(F.lit(0.0).alias("add"), F.lit(1.0).alias("scale"), held.alias("held"), room.alias("room"), F.array().cast(f"array<{item}>").alias("out"))

    def pair(state: Column, e: Column) -> Column:
        frac = state["add"] + state["scale"] * e["frac"]
        # The pool without the item; rounding must not leave it less than nothing.
        held = F.greatest(F.lit(0.0), state["held"] - frac * e["size"])
        room = F.greatest(F.lit(0.0), state["room"] - (1 - frac) * e["size"])
        up, down = F.least((1 - frac) * e["size"], held), F.least(frac * e["size"], room)
        goes_up = uniform(F.lit(seed), F.lit(-2), e["doc_id"], e["size"]) * (up + down) < down
        less, more = F.when(held > 0, up / held).otherwise(0.0), F.when(room > 0, down / room).otherwise(0.0)
        whole = F.when(goes_up, frac + up / e["size"]).otherwise(frac - down / e["size"])
        add = F.when(goes_up, state["add"] * (1 - less)).otherwise(state["add"] + (1 - state["add"]) * more)
        scale = F.when(goes_up, state["scale"] * (1 - less)).otherwise(state["scale"] * (1 - more))
        moved = F.when(goes_up, -up).otherwise(down)
        own = F.struct(e["doc_id"].alias("doc_id"), e["size"].alias("size"), whole.alias("frac"))
        return F.struct(add.alias("add"), scale.alias("scale"), (held + moved).alias("held"), (room - moved).alias("room"), F.concat(state["out"], F.array(own)).alias("out"))

    return F.aggregate(items, start, pair)


def _same_source(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on source, null included; right has a row a source."""
    key = right.withColumnRenamed("source", "_source")
    return left.join(key, left["source"].eqNullSafe(key["_source"]), how).drop("_source")


def _last(fold: Column, seed: int) -> Column:
    """The items of a source's last bucket, all whole: the fractional one is rounded at random by its fraction."""
    carry, out = fold["carry"], fold["out"]
    up = (uniform(F.lit(seed), F.lit(-1), carry["doc_id"]) < carry["frac"]).cast("double")
    last = F.struct(carry["doc_id"].alias("doc_id"), carry["size"].alias("size"), up.alias("frac"))
    return F.when(carry.isNull(), out).otherwise(F.concat(out, F.array(last)))


def _equal_rows(groups: DataFrame) -> DataFrame:
    """`rows` rows of each group, the first `full` of them with extra 1.

    Large groups are dealt as ranges of RANGE rows before they are written out, so
    neither an array nor a task holds all rows of one.
    """
    cols = [c for c in groups.columns if c not in ("full", "rows")]
    ranged = groups.where("rows > 0").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / RANGE))))

    def written(some: DataFrame) -> DataFrame:
        start = F.col("from") * RANGE
        each = some.withColumn("i", F.explode(F.sequence(start, F.least(start + RANGE, F.col("rows")) - 1)))
        return each.select(*cols, (F.col("i") < F.col("full")).cast("int").alias("extra"))

    large = ranged.where(F.col("rows") > RANGE).repartition("doc_id", "from")
    return written(ranged.where(F.col("rows") <= RANGE)).unionByName(written(large))


def mix(documents: DataFrame, *, text: str = "text", seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken; one row for each of documents.

    taken = size * copies; copies is 0 to `most`. A null text has size 0; a null
    source is a source of its own, the last. Equal rows (doc_id, source, size) are
    due as many copies together as they hold, split as evenly as whole copies allow.
    A null doc_id counts as an id. No documents give no rows. Other columns are
    not read.
    """
    count = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), count.alias("size"))
    # Equal rows become one, so no bucket can hold more than its share of rows.
    groups = stored(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    targets = stored(source_targets(groups.select("source", (F.col("size") * F.col("rows")).alias("size")), weights=weights, most=most), "targets")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(due + EPS)
    all_due = _same_source(groups, targets)
    all_due = all_due.withColumn("base", base.cast("int")).withColumn("frac", F.greatest(F.lit(0.0), due - base))
    # Of equal rows, whole shares go to some of them and the rest of the mass to one.
    mass = F.col("rows") * F.col("frac")
    full = F.floor(mass + EPS).cast("long")
    all_due = all_due.withColumn("full", full).withColumn("rest", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), mass - full)).otherwise(0.0))
    all_due = all_due.withColumn("rest", F.when(F.col("rest") <= EPS, 0.0).otherwise(F.col("rest")))
    all_due = all_due.withColumn("one", (F.col("rest") > 0).cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", "base"]
    parts = [_equal_rows(all_due.select(*cols, "full", (F.col("rows") - F.col("one")).alias("rows")))]

    items = all_due.where("one = 1").select(*cols, "n", F.col("rest").alias("frac"))
    sum_of = lambda x: F.sum(F.round(x * 1e6).cast("long")) / 1e6  # noqa: E731  whole numbers, so the order of rows is no matter
    pool = stored(items.groupBy("source").agg(F.sum("size").alias("words"), sum_of(F.col("frac") * F.col("size")).alias("held"), sum_of((1 - F.col("frac")) * F.col("size")).alias("room")), "pool")
    sized = _same_source(items, pool)
    is_long = F.col("size") * LONG > F.col("words")
    by_size = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "doc_id", "size", "frac")))
    fixed = ["source", "source_size", "target", "base", "n"]
    longest = sized.where(is_long).groupBy(*fixed, "held", "room").agg(by_size.alias("items"))  # LONG at most
    longest = stored(longest.select(*fixed, _settle_long(F.col("items"), F.col("held"), F.col("room"), seed).alias("fold")), "long")
    moved = longest.select("source", F.col("fold.add").alias("add"), F.col("fold.scale").alias("scale"))
    short = _same_source(sized.where(~is_long), moved).withColumn("frac", F.coalesce("add", F.lit(0.0)) + F.coalesce("scale", F.lit(1.0)) * F.col("frac"))
    first = longest.select(*fixed, F.explode("fold.out").alias("x")).select("x.doc_id", "source", "x.size", "source_size", "target", "base", "n", "x.frac")
    items = stored(short.select(*cols, "n", "frac").unionByName(first), "items")
    is_whole = (F.col("frac") <= EPS) | (F.col("frac") >= 1 - EPS)
    parts.append(items.where(is_whole).select(*cols, (F.col("frac") > 0.5).cast("int").alias("extra")))
    items, level = items.where(~is_whole), 0
    widest = targets.agg(F.max("n")).first()[0] or 0
    buckets = F.ceil(F.col("n") / BUCKET)
    while widest:
        widest = 0 if widest <= BUCKET else -(-widest // BUCKET)
        spread = F.pmod(F.xxhash64(F.lit(seed + level), F.col("doc_id"), F.col("size")), F.greatest(F.lit(1).cast("long"), buckets))
        grouped = items.groupBy(*fixed, spread.alias("bucket")).agg(by_size.alias("items"))
        folded = stored(grouped.withColumn("fold", _fold(F.col("items"), seed, level)).drop("items"), f"level{level}")
        whole = F.when(buckets <= 1, _last(F.col("fold"), seed)).otherwise(F.col("fold.out"))
        parts.append(folded.select("*", F.explode(whole).alias("x")).select("x.doc_id", "source", "x.size", "source_size", "target", "base", (F.col("x.frac") > 0.5).cast("int").alias("extra")))
        left = folded.where((buckets > 1) & F.col("fold.carry").isNotNull()).select("fold.carry.doc_id", "source", "fold.carry.size", "source_size", "target", "base", "n", "fold.carry.frac")
        items, buckets, level = left, F.ceil(buckets / BUCKET), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    copies = F.col("base") + F.col("extra")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def take(documents: DataFrame, **settings) -> DataFrame:
    """The rows of documents that the mix takes, with copies and taken.

    Rows that agree in doc_id, source and size are told apart by number; any of them
    may stand for the other. Columns of documents with these two names give way.
    """
    count = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    own, nth = fresh(documents, "_size"), fresh(documents, "_nth")
    sized = documents.withColumn(own, count)
    picks = stored(mix(documents, **settings).where("copies > 0").select("doc_id", "source", "size", "copies", "taken"), "picks")
    key, n = ["doc_id", "source", "size"], F.lit(1)
    if picks.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        sized = sized.withColumn(nth, F.lit(1))
    else:
        n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("copies")))
        sized = sized.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", own).orderBy(own)))
    picks = picks.select(*(F.col(k).alias(f"_{k}_") for k in key), n.alias("_n_"), F.col("copies").alias("_copies_"), F.col("taken").alias("_taken_"))
    same = sized["doc_id"].eqNullSafe(picks["_doc_id_"]) & sized["source"].eqNullSafe(picks["_source_"]) & (sized[own] == picks["_size_"]) & (sized[nth] == picks["_n_"])
    kept = [sized[c] for c in documents.columns if c not in ("copies", "taken")]
    return sized.join(picks, same).select(*kept, picks["_copies_"].alias("copies"), picks["_taken_"].alias("taken"))
