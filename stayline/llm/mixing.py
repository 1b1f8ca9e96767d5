"""Mixing sources to target weights by a low-discrepancy schedule of equal-word blocks.

The documents of a source, in hashed order, form one sequence of words that is cut into
equal blocks. A schedule gives slot after slot to a source: slot i stands at the
fractional part of i times the golden ratio, taken as the quotient of two neighbouring
Fibonacci numbers so that whole numbers give it exactly, and the cumulative quotas of the
sources divide the unit interval. The k-th slot of a source takes its block k modulo the number
of its blocks.

Positions and ranks are running sums in two steps (over segments, then inside one), so
no task holds a whole source. Only the table of sources and a bounded number of segment
totals pass through a single window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.words import WORD
from stayline.operators.ranking import prefix_sums
from stayline.session import checkpointed

BLOCK_WORDS = 64
# The 67th and 68th Fibonacci number, whose products with 16 bits fit a long
STEP, TURN = 44945570212853, 72723460248141
SLOT_SEGMENT = 4096
CELLS = 4096


def _running(df: DataFrame, value: str, groups: list[str], order: list[str]) -> Column:
    """The sum of ``value`` over the rows before, inside a group."""
    upto = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(upto), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``source, source_size`` to targets: weighted shares of the total, ``most`` times the size at most.

    What a source cannot take is shared again by weight among the others: with sources in
    ascending order of cap by weight, the first whose share fits sets the level, which is the highest of those that fit.
    """
    one = Window.partitionBy(F.lit(0))
    place = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    sized = sizes.withColumn("source_no", place).withColumn("weight", weight.cast("long"))
    sized = sized.withColumn("cap", most * F.col("source_size"))
    ranked = one.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    left = F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), none)
    free = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), none)
    level = sized.withColumn("level", left / free)
    level = level.withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    return level.withColumn(
        "target", F.least(F.max("level").over(one) * F.col("weight"), F.col("cap").cast("double"))
    ).drop("level", "cap")


def _quotas(targets: DataFrame, block_words: int) -> DataFrame:
    """Number and length of each source's blocks, and its slots of the schedule."""
    size = F.col("source_size")
    blocks = F.greatest(F.floor(size / block_words), F.lit(1))
    quota = F.when(size > 0, F.round(F.col("target") * F.col("blocks") / size)).otherwise(0).cast("long")
    quotas = targets.withColumn("blocks", blocks).withColumn("quota", quota)
    quotas = quotas.withColumn("base", F.expr("source_size div blocks")).withColumn("longer", F.expr("source_size % blocks"))
    every = Window.partitionBy(F.lit(0))
    return quotas.withColumn("low", _running(quotas, "quota", [F.lit(0)], ["source_no"])).withColumn(
        "slots", F.sum("quota").over(every)
    )


def golden_place(index: Column) -> Column:
    """``index`` times ``STEP`` modulo ``TURN`` in whole numbers, for an index below ``TURN``.

    The index enters in three parts of 16 bits; no product leaves a long.
    """
    step, turn, bits = F.lit(STEP), F.lit(TURN), 1 << 16
    high = (F.shiftright(index, 32) * step) % turn
    middle = (high * bits + (F.shiftright(index, 16) % bits) * step) % turn
    return (middle * bits + (index % bits) * step) % turn


def schedule(quotas: DataFrame) -> DataFrame:
    """``slot, source_no, rank, block`` of every slot.

    Among any 3n points of the sequence the largest gap is below 1 / n, so with three times
    as many points as slots every source finds its quota; later points are left over.
    """
    spark = quotas.sparkSession
    total = quotas.agg(F.max("slots")).first()[0] or 0
    if 3 * total >= TURN:
        raise ValueError("the schedule has more points than its sequence; take larger blocks")
    points = spark.range(3 * total).select(F.col("id").alias("slot"), (golden_place(F.col("id") + 1) / TURN).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS)).withColumn("at", F.col("x") * F.lit(float(total)))
    ends = quotas.where("quota > 0").select("source_no", "quota", "blocks", "low", (F.col("low") + F.col("quota")).alias("high"))
    first = F.floor(F.col("low") / F.lit(float(total)) * CELLS) if total else F.lit(0)
    last = F.floor(F.col("high") / F.lit(float(total)) * CELLS) if total else F.lit(0)
    # a source's interval is looked up by the cells it touches; the exact bounds decide
    cells = ends.withColumn("cell", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last)))
    drawn = points.join(cells, "cell").where("low <= at AND at < high")
    drawn = drawn.withColumn("segment", F.expr(f"slot div {SLOT_SEGMENT}"))
    drawn = drawn.select("slot", "segment", "source_no", "quota", "blocks")
    counts = drawn.groupBy("source_no", "segment").agg(F.count(F.lit(1)).alias("n"))
    sums = prefix_sums(counts, "segment", ["n"], 3 * total // SLOT_SEGMENT, ["source_no"])
    offsets = sums.select("source_no", "segment", F.col("before_n").alias("offset"))
    own = F.row_number().over(Window.partitionBy("source_no", "segment").orderBy("slot")) - 1
    ranked = drawn.withColumn("own", own).join(offsets, ["source_no", "segment"])
    return (
        ranked.withColumn("rank", F.col("offset") + F.col("own"))
        .where("rank < quota")
        .select("slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block"))
    )


def _block_of(position: Column) -> Column:
    edge = F.col("longer") * (F.col("base") + 1)
    late = F.col("longer") + F.floor((position - edge) / F.greatest(F.col("base"), F.lit(1)))
    return F.when(position < edge, F.floor(position / (F.col("base") + 1))).otherwise(late)


def _block_start(block: Column) -> Column:
    return block * F.col("base") + F.least(block, F.col("longer"))


def repeated(docs: DataFrame, mixed: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole documents only.

    A document of which the mix takes a part goes in or not with the chance of that part, by
    a hash of its id. Rows equal in id and text share what the mix takes of them.
    """
    shares = mixed.groupBy("doc_id", "text_key").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("share")).where("share > 0")
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.lit(1 << 30)) / (1 << 30)
    copies = F.floor("share") + (chance < F.col("share") - F.floor("share")).cast("int")
    counts = shares.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), copies.alias("__copies")).where("__copies > 0")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(checkpointed(counts), same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    block_words: int = BLOCK_WORDS,
    seed: str = "mix",
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Sources by code point, null last, weigh ``weights``, repeating, and share as many words
    as there are; no target exceeds ``most`` times its source. Returns one row per input
    row: ``doc_id, text_key`` (hash of the text), ``source, size`` (words), ``source_size, target`` (its source's) and
    ``taken`` (words taken, repeats counted, ``most`` times the size at most). What a source
    gives differs from its target by half a block at most, and is the same in every run.

    Null and empty texts have size 0 and are never taken. Rows that repeat an id, whole
    rows included, are mixed as documents of their own. Other columns are ignored.
    """
    # rows without an id are told apart by their texts
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce("text", F.lit(""))))
    key = F.md5(F.concat(F.lit(seed + ":"), name))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.col("source").cast("string").alias("source"),
        size.alias("size"),
        key.alias("key"),
    )
    sized = checkpointed(sized.withColumn("segment", F.substring("key", 1, 3)))
    segments = sized.groupBy("source", "segment").agg(F.sum("size").alias("n"))
    totals = segments.groupBy("source").agg(F.sum("n").alias("source_size"))
    quotas = checkpointed(_quotas(source_targets(totals, weights, most), block_words))
    slots = schedule(quotas)
    offsets = segments.withColumn("offset", _running(segments, "n", ["source"], ["segment"])).drop("n")
    source = quotas.withColumnRenamed("source", "its_source")
    offsets = offsets.join(source, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source", "source")
    numbers = quotas.select(F.col("source").alias("its_source"), "source_no")
    numbered = sized.join(numbers, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    placed = numbered.withColumn("own", _running(numbered, "size", ["source_no", "segment"], ["key", "doc_id", "size", "text_key"]))
    placed = placed.join(offsets, ["source_no", "segment"]).withColumn("start", F.col("offset") + F.col("own"))
    kept = ["doc_id", "text_key", "source", "size", "source_size", "target"]
    placed = checkpointed(placed.select(*kept, "source_no", "start", "base", "longer"))
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(_block_of(F.col("start")), _block_of(end - 1)))
    )
    overlap = F.least(end, _block_start(F.col("block") + 1)) - F.greatest(F.col("start"), _block_start(F.col("block")))
    visits = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("visits"))
    taken = (
        pieces.withColumn("overlap", overlap)
        .join(visits, ["source_no", "block"])
        .groupBy(*kept, "source_no", "start")
        .agg(F.sum(F.col("overlap") * F.col("visits")).alias("taken"))
        .select("source_no", "start", "taken")
    )
    # rows with words differ in where they start; rows without are taken from nowhere
    found = placed.where("size > 0").join(taken, ["source_no", "start"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return found.unionByName(none, allowMissingColumns=True).select(
        *kept, F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )
