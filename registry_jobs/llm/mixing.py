"""Mixing sources to target weights by a low-discrepancy schedule.

Points of the golden-ratio sequence are mapped through the sources' cumulative targets; the k-th slot
of a source, in schedule order, takes the source's k-th block of equal word count. Blocks are cut from
the source's documents laid end to end in hashed (shuffled) order, and begin again when they run out.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registry_jobs.llm.common import join_counted, text_or_empty, written

getcontext().prec = 60
_PHI = (Decimal(5).sqrt() - 1) / 2
_STEP = float(_PHI)
_LEAP = float((_PHI * 2**20) % 1)
CELLS = 4096
CHUNK = 1 << 16
MOST = 3  # times that a document is taken at most


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def golden(n: Column) -> Column:
    """Fractional part of n times the golden ratio's, exact to some 1e-9 for n below 2**40."""
    high = F.floor(n / F.lit(1 << 20)).cast("double")
    low = F.pmod(n, F.lit(1 << 20)).cast("double")
    x = F.lit(_LEAP) * high
    y = (x - F.floor(x)) + low * F.lit(_STEP) + F.lit(0.5)
    return y - F.floor(y)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size, target, lo, hi) from (source, size): one row per source.

    Sources are summed before they meet in one task, a row of some 50 bytes each: their number, not that of
    documents, is what this task grows with.

    Sources by code point, null last, take the weights in turn. Each target is the smaller of MOST
    times the source's size and its weight times a common level, the level being such that targets add
    up to all sizes: what giving the excess of capped sources to the others by weight ends in.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    ratio = Window.orderBy("full_at", "nth")
    ranked = (
        per.withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(MOST)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    whole = Window.partitionBy()
    level = (
        ranked.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level_here", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
        # levels fall from the first source on that is not filled, whose level is right
        .withColumn("level", F.max(F.when(F.col("level_here") <= F.col("full_at"), F.col("level_here"))).over(whole))
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce("level", F.col("full_at"))))
    )
    order = Window.orderBy("nth")
    return level.withColumn("hi", F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")).withColumn(
        "lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0))
    ).select("source", "source_size", "target", "lo", F.when(F.col("nth") == F.max("nth").over(whole), F.lit(1.0)).otherwise(F.col("hi")).alias("hi"))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(slot, source, rank): the source of each slot and the slot's rank among its source's.

    Sources meet slots in cells of [0, 1), an equal join: a cell has the sources that overlap it. Ranks
    come from counts by chunk of slots, so no task sees all slots of a source.
    """
    spark = targets.sparkSession
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    spans = targets.where("hi > lo").select("source", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden(F.col("id")).alias("x")).withColumn("cell", cell(F.col("x")))
    placed = points.join(spans, "cell").where("x >= lo and x < hi").select("slot", "source", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = placed.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        F.col("source").alias("s"),
        F.col("chunk").alias("c"),
        (F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    inside = placed.withColumn("k", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    return inside.join(before, inside["source"].eqNullSafe(before["s"]) & (inside["chunk"] == before["c"])).select(
        "slot", "source", (F.col("before") + F.col("k")).alias("rank")
    )


def laid_out(sizes: DataFrame, groups: int) -> DataFrame:
    """sizes with `start`, the words before the row in its source's hashed order, and `nth`, its place in its group.

    A source is split by hash into `groups` consecutive groups; sums of earlier groups and a running
    sum inside the group give the start, so a source with most rows is still dealt over many tasks. Only rows
    equal in id and text have one hash, so rows without ids part by their texts.
    """
    hashed = sizes.withColumn("h", F.xxhash64(F.lit("mix"), "doc_id", "text_key")).withColumn("g", F.pmod(F.shiftrightunsigned("h", 1), F.lit(groups)).cast("int"))
    sums = hashed.groupBy("source", "g").agg(F.sum("size").alias("n"))
    before = sums.select(
        F.col("source").alias("s"),
        F.col("g").alias("sg"),
        (F.sum("n").over(Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    order = Window.partitionBy("source", "g").orderBy("h", "doc_id", "size")
    inside = hashed.withColumn("here", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("nth", F.row_number().over(order))
    return inside.join(before, inside["source"].eqNullSafe(before["s"]) & (inside["g"] == before["sg"])).select(
        "doc_id", "source", "text_key", "size", "g", "nth", (F.col("before") + F.col("here")).alias("start")
    )


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, start, text_key (a hash of the text).

    A null text has size 0, a null source is a source of its own, null ids are kept; a row repeated is
    a document of its own. A source without words has target 0. An empty table gives an empty result.
    Columns besides the three named are not read. Words taken stay within a few blocks of a source's
    target; a block has 1 to 256 words, about 1/65,536 of all words.
    """
    sizes = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"), F.xxhash64(text_or_empty(text_col)).alias("text_key")))
    targets = written(source_targets(sizes, weights))
    rows, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, min(256, total >> 16))
    groups = 1 << max(6, math.ceil(math.log2(rows / 5_000 + 1)))
    known = targets.select(F.col("source").alias("ts"), "source_size", "target")
    laid = laid_out(sizes, groups)
    laid = laid.join(known, laid["source"].eqNullSafe(known["ts"])).drop("ts")
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    slots = schedule(targets, math.ceil(total / block))
    slots = slots.join(known, slots["source"].eqNullSafe(known["ts"])).where(F.col("rank") < blocks * MOST)
    times = slots.groupBy(F.col("source").alias("bs"), F.pmod("rank", blocks).alias("block")).agg(F.count(F.lit(1)).alias("times"))
    first = F.floor(F.col("start") / block)
    last = F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)
    pieces = laid.withColumn("b", F.explode(F.sequence(first, last))).withColumn(
        "words", F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block) - F.greatest(F.col("start"), F.col("b") * block))
    )
    taken = pieces.join(times, pieces["source"].eqNullSafe(times["bs"]) & (pieces["b"] == times["block"]), "left")
    return (
        taken.groupBy("source", "g", "nth")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("size").alias("size"),
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
            F.coalesce(F.sum(F.col("words") * F.coalesce("times", F.lit(0))), F.lit(0)).cast("long").alias("taken"),
            F.first("start").alias("start"),
            F.first("text_key").alias("text_key"),
        )
        .select("doc_id", "source", "size", "source_size", "target", "taken", "start", "text_key")
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them, whole, whatever their columns' names: each row as often as words taken come nearest to, 0 to MOST times.

    A row with no words isn't part of any block and goes, null texts with it. A null id or source stands for
    itself, and rows without ids part by their texts. Rows repeated with id, source and text share the words taken:
    each goes as often as their mean says, rounded up or down in turn by golden-ratio points, so that together
    they are taken as often as planned. An empty table gives an empty one.
    """
    key = [
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("of"), "text_key", "size",
    ]
    names = ["no_id", "id", "no_source", "of", "text_key", "size"]
    plan = mix_sources(docs, weights, id_col, text_col, source_col).where("size > 0").select(*key, "taken")
    plan = plan.groupBy(*names).agg(F.avg("taken").alias("taken"), F.count(F.lit(1)).alias("times")).where("taken > 0")
    at = F.monotonically_increasing_id()
    text = text_or_empty(text_col)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), (F.pmod(at, F.lit(1 << 33)) + F.shiftright(at, 33) * 7919).alias("at"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_key"), word_count(text).alias("size"),
    )
    met = join_counted(rows.select("row", golden(F.col("at")).alias("turn"), *key), plan, names, docs.count())
    often = F.floor(F.col("taken") / F.col("size") + F.when(F.col("times") == 1, F.lit(0.5)).otherwise(F.col("turn"))).cast("int")
    out = met.select("row", F.least(often, F.lit(MOST)).alias("often")).where("often > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("often")))).select("row.*")
