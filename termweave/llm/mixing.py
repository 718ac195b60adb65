"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key, the md5 of its id and its text's md5. Within a source the key's leading hex digits cut the order
into ranges: sums by (source, range) are partially aggregated, their prefix sums give each range its offset, and only
inside one small range are single documents ordered. So no source, however large, is sorted in one task.

Defined results: null or blank texts have size 0 and are taken 0 times; a null source is a source of its own, after
all others; rows that repeat a doc_id or have none are told apart by their texts, and interchangeable if those are
equal; an empty table gives an empty result; columns besides doc_id, text and source are not looked at, whatever their
names. A source is a category: the windows over one row a source are one task's, and so need not more than millions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import _shared

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0


def target_table(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): weighted shares, no target above cap times its source.

    Water filling in closed form: with the sources in order of capacity per weight, the first k are full, where k is
    the least number for which the level that the rest reach stays under the next source's capacity per weight.
    One row a source: a list of categories, not of documents.
    """
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    ranked = ranked.withColumn("room", F.col("source_size").cast("double") * cap).withColumn("full_at", F.col("room") / F.col("weight"))
    order = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.sum("source_size").over(whole).cast("double") * share
    full = F.sum("room").over(upto)
    ranked = ranked.withColumn("budget", budget).withColumn("room_before", full - F.col("room"))
    ranked = ranked.withColumn("weight_left", F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"))
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("room_before")) / F.col("weight_left"))
    # the first source, in this order, that can hold the level fixes it for itself and all after it
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(whole)["level"]
    target = F.least(F.col("room"), F.col("weight") * F.coalesce(level, F.lit(0.0)))
    return ranked.select("source", "source_size", F.when(level.isNull(), F.col("room")).otherwise(target).alias("target"))


def mix(docs: DataFrame, digits: int = 3, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken.

    digits: hex digits of the key that name a range, so 16**digits ranges a source; a range should fit one task.
    A source's mix is its first `target` words in key order, over and over: whole epochs, then the documents before
    the cut, the last of them in part.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    sized = _shared.spilled(sized.withColumn("range", F.substring("key", 1, digits)), "mix")
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.withColumn("range_start", F.sum("range_size").over(before) - F.col("range_size"))
    targets = target_table(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    # a null source must meet itself
    named = lambda df: df.withColumn("no_source", F.col("source").isNull()).withColumn("source_", F.coalesce("source", F.lit(""))).drop("source")
    ranges = named(ranges).join(named(targets), ["no_source", "source_"])
    rows = named(sized).join(ranges, ["no_source", "source_", "range"])
    inside = Window.partitionBy("no_source", "source_", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("range_start") + F.sum("size").over(inside) - F.col("size")
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    source = F.when(~F.col("no_source"), F.col("source_")).alias("source")
    return rows.select("doc_id", source, "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, digits: int = 3) -> DataFrame:
    """The mix itself: the columns of docs, a row each time a document is taken; where the budget cuts one, its first words.

    docs: one row a doc_id; repeated ids keep one row each time they are drawn.
    """
    drawn = mix(docs, digits).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    drawn = drawn.select(F.col("doc_id").alias("drawn_id"), F.col("source").alias("drawn_source"), F.col("size").alias("drawn_size"), "taken", "rows")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(_shared.whole(docs).alias("row"), "doc_id", "source", size.alias("size"))
    hit = base.join(drawn, F.col("doc_id").eqNullSafe(F.col("drawn_id")) & F.col("source").eqNullSafe(F.col("drawn_source")) & (F.col("size") == F.col("drawn_size")))
    share = F.floor(F.col("taken") / F.col("rows"))
    times = F.concat(F.array_repeat(F.col("size"), F.floor(share / F.col("size")).cast("int")), F.array_repeat(share % F.col("size"), 1))
    hit = hit.select("row", "size", F.explode(times).alias("words")).where("words > 0")
    parts = F.split(F.col("row")["text"], r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    is_whole = F.col("words") == F.col("size")
    text = F.when(is_whole, F.col("row")["text"]).otherwise(F.array_join(F.slice(parts, F.lit(1), F.col("words").cast("int")), ""))
    out = hit.select("row", is_whole.alias("whole"), text.alias("text"))

    def column(name: str):
        field = F.col("row")[name]
        if name == "n_chars":
            field = F.when(F.col("whole"), field).otherwise(F.length("text")).cast(docs.schema[name].dataType)
        return (F.col("text") if name == "text" else field).alias(name)

    return out.select(*[column(c) for c in docs.columns])
