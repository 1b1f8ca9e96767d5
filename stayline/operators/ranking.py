"""Exact ranks, running totals and quantiles without gathering a group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import checkpointed

FAN = 1024
BINS = 1024


def hash_rank(
    df: DataFrame, group: str, key: str, seed: int, bits: int = 12
) -> DataFrame:
    """Add ``rank`` (0-based, by a seeded hash of ``key``) and ``group_size``.

    The hash's leading bits cut every group into 2**bits even slices. The sizes of the
    slices, at most that many per group, are summed up to offsets; the row numbering
    runs per slice, so a group of any size is spread over many tasks. ``key`` must
    identify the row. Rows of the NULL group are a group of their own.
    """
    sliced = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn(
        "_slice", F.shiftrightunsigned("_h", 64 - bits)
    )
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(group, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col(group).alias("_group"),
            F.col("_slice").alias("_part"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("group_size"),
        )
    )
    in_slice = F.row_number().over(Window.partitionBy(group, "_slice").orderBy("_h", key))
    return (
        sliced.withColumn("_row", in_slice)
        .join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_part")))
        .select(
            *df.columns, (F.col("_before") + F.col("_row") - 1).alias("rank"), "group_size"
        )
    )


def prefix_sums(
    df: DataFrame, place: str, values: Sequence[str], most: int, groups: Sequence[str] = (), fan: int = FAN
) -> DataFrame:
    """Add ``before_<value>``: the sum over the rows of the group that come before by place.

    Places are whole numbers from 0 to ``most``, each at most once in a group. The scan has
    as many levels as ``most`` needs: rows are summed in blocks of ``fan`` places, blocks in
    blocks of blocks, so no window holds more than ``fan`` rows. NULL is a group.
    """
    block = f"_{place}_block"
    blocked = df.withColumn(block, F.expr(f"`{place}` div {fan}"))
    inside = Window.partitionBy(*groups, block).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    own = blocked.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    if most < fan:
        return own.drop(block)
    blocks = blocked.groupBy(*groups, block).agg(*[F.sum(v).alias(v) for v in values])
    higher = prefix_sums(blocks, block, values, most // fan, groups, fan).select(
        F.col(block).alias("_its_block"),
        *[F.col(g).alias(f"_its_{i}") for i, g in enumerate(groups)],
        *[F.col(f"before_{v}").alias(f"_more_{v}") for v in values],
    )
    same = F.col(block) == F.col("_its_block")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_its_{i}"))
    return own.join(higher, same).select(
        *df.columns, *[(F.col(f"before_{v}") + F.col(f"_more_{v}")).alias(f"before_{v}") for v in values]
    )


def running_totals(
    df: DataFrame, order: str, values: Sequence[str], descending: bool = False
) -> DataFrame:
    """Add ``cum_<value>`` (this row included) and ``all_<value>`` in the order of a column.

    ``order`` must be unique. Cut points taken from approximate quantiles split the rows
    into ranges of similar size; each range is summed by itself and shifted by the
    totals of the ranges before it, which ``prefix_sums`` adds up. The input is read three times and therefore
    checkpointed first. Rows without a place in the order (NULL or NaN) are left out;
    infinite values are the first and the last.
    """
    spark = df.sparkSession
    df = checkpointed(df.filter(F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double"))))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts)
    inner = sorted({c for c in cuts if math.isfinite(c)}) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=order, outputCol="_range").transform(df)

    def before(column: str) -> Column:
        return F.desc(column) if descending else F.asc(column)

    sums = ranged.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    # one subquery for all totals
    total = sums.agg(F.struct(*[F.sum(v).alias(v) for v in values])).scalar()
    place = (F.lit(len(splits)) - F.col("_range") if descending else F.col("_range")).cast("int")
    offsets = prefix_sums(sums.withColumn("_place", place), "_place", values, len(splits)).select(
        "_range",
        *[F.col(f"before_{v}").alias(f"_before_{v}") for v in values],
        *[total.getField(v).alias(f"all_{v}") for v in values],
    )
    inside = (
        Window.partitionBy("_range")
        .orderBy(before(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumns(
            {f"cum_{v}": F.sum(v).over(inside) + F.col(f"_before_{v}") for v in values}
        )
        .drop("_range", *[f"_before_{v}" for v in values])
    )


def order_statistics(df: DataFrame, column: str, places: Sequence[int]) -> dict[int, float]:
    """The values at some places (from 0) in ascending order, by refining histograms.

    Each pass counts the values of the ranges that still hold a wanted place in ``BINS`` even
    bins; the bin with the place, cut to the least and the greatest value in it, is its
    next range. A pass is one aggregation of a few thousand counts; nothing is sorted. Rows
    without a value (NULL or NaN) have no place; places beyond the last have no value.
    """
    value = F.col(column).cast("double")
    numbers = checkpointed(df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    infinite = float("inf")
    finite = numbers.where(F.abs("v") < infinite)
    first = numbers.agg(
        F.count_if(F.col("v") == -infinite).alias("low"),
        F.count_if(F.abs("v") < infinite).alias("n"),
        F.count(F.lit(1)).alias("all"),
        F.min(F.when(F.abs("v") < infinite, F.col("v"))).alias("lo"),
        F.max(F.when(F.abs("v") < infinite, F.col("v"))).alias("hi"),
    ).first()
    found = {p: -infinite if p < first["low"] else infinite for p in places if 0 <= p < first["all"]}
    open_ = {p: p - first["low"] for p in found if first["low"] <= p < first["low"] + first["n"]}
    ranges = {(first["lo"], first["hi"]): open_} if open_ else {}
    while ranges:
        found |= {p: lo for (lo, hi), wanted in ranges.items() if lo == hi for p in wanted}
        ranges = {r: wanted for r, wanted in ranges.items() if r[0] < r[1]}
        if not ranges:
            break
        bounds = list(ranges)
        which, share = F.lit(None).cast("int"), F.lit(None).cast("double")
        for i, (lo, hi) in enumerate(bounds):
            inside = F.col("v").between(lo, hi)
            which = F.when(inside, i).otherwise(which)
            # halves first: the width of a range may be more than a double holds
            share = F.when(inside, (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise(share)
        binned = finite.select("v", which.alias("i"), F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
        counted = (
            binned.where("i IS NOT NULL")
            .groupBy("i", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        finer: dict[tuple[float, float], dict[int, int]] = {}
        for i, bound in enumerate(bounds):
            before = 0
            for row in sorted((r for r in counted if r["i"] == i), key=lambda r: r["bin"]):
                for p, rank in ranges[bound].items():
                    if before <= rank < before + row["n"]:
                        finer.setdefault((row["lo"], row["hi"]), {})[p] = rank - before
                before += row["n"]
        ranges = finer
    return found


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Quantiles with linear interpolation between the two neighbouring order statistics."""
    value = F.col(column).cast("double")
    total = df.select(F.count_if(value.isNotNull() & ~F.isnan(value))).first()[0]
    if not total:
        return []
    picks = []
    for p in probabilities:
        spot = (total - 1) * p
        low = int(spot)
        picks.append((low, min(low + 1, total - 1), spot - low))
    found = order_statistics(df, column, sorted({i for low, high, _ in picks for i in (low, high)}))
    return [found[low] + share * (found[high] - found[low]) if share else found[low] for low, high, share in picks]
