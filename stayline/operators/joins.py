"""Joins of a large fact frame to a smaller keyed frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 100_000_000
LEAST_SALTS = 16
SALT = "_salt"
# what a value of a type without a fixed width takes
TEXT_BYTES = 48
# the bits that tell members from others: per member, at most in all, in one row
FILTER_LOAD = 16
FILTER_BITS = 1 << 28
BLOCK_WORDS = 512
HASHED_TYPES = ("byte", "short", "integer", "long", "string", "date", "timestamp", "timestamp_ntz", "boolean")
BLOCK_BITS = 32 * BLOCK_WORDS


def row_bytes(df: DataFrame) -> int:
    """About what a row of the frame takes in memory."""
    fixed = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4}
    return 16 + sum(
        8 if f.dataType.typeName() in ("long", "double", "date", "timestamp") else
        fixed.get(f.dataType.typeName(), TEXT_BYTES)
        for f in df.schema.fields
    )


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the frame may be sent to every executor; counting stops at the limit."""
    most = limit // row_bytes(df)
    return df.limit(most + 1).count() <= most


def default_salts(df: DataFrame) -> int:
    """As many salts as a shuffle has partitions, so a key can fill all of them."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_SALTS, partitions)


def salted(df: DataFrame, columns: Sequence[str], salts: int) -> DataFrame:
    """Add a salt from a hash of the columns, which is the same on a retried task."""
    return df.withColumn(SALT, F.pmod(F.xxhash64(*columns), F.lit(salts).cast("long")))


def repeated(df: DataFrame, salts: int) -> DataFrame:
    """Every row once per salt."""
    return df.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1))))


def _hash_alike(left: DataFrame, right: DataFrame, on: Sequence[str]) -> bool:
    """Whether equal keys have equal hashes: one type on both sides, and not a fraction."""
    types = [(left.schema[c].dataType, right.schema[c].dataType) for c in on]
    return all(a == b and a.typeName() in HASHED_TYPES for a, b in types)


def member_filter(facts: DataFrame, lookup: DataFrame, on: Sequence[str], most_bits: int = FILTER_BITS) -> DataFrame:
    """The facts without most rows whose key the lookup does not hold; no row it holds is lost.

    Keys hash to places of a table of bits, ``FILTER_LOAD`` of them per lookup row but at
    most ``most_bits``, which bounds what is broadcast (64 MB by default). With a key hashed to one
    place, about 1 in ``FILTER_LOAD`` foreign keys passes, more where the bound is reached.
    The facts do not move.
    """
    keys = lookup.select(*on).dropna(subset=list(on))
    wanted = max(1, keys.count()) * FILTER_LOAD
    bits = min(most_bits, 1 << (wanted - 1).bit_length())
    blocks = max(1, bits // BLOCK_BITS)
    place = F.pmod(F.xxhash64(*[F.lit("member"), *on]), F.lit(blocks * BLOCK_BITS).cast("long"))
    word, bit = F.expr("_place div 32"), (F.col("_place") % 32).cast("int")
    words = (
        keys.select(place.alias("_place"))
        .groupBy(word.alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_place % 32 as int))")).alias("_bits"))
    )
    in_block = F.map_from_entries(F.collect_list(F.struct((F.col("_word") % BLOCK_WORDS).cast("int"), "_bits")))
    table = words.groupBy(F.expr(f"_word div {BLOCK_WORDS}").alias("_block")).agg(in_block.alias("_map"))
    every = F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1))
    table = table.select("_block", F.transform(every, lambda i: F.coalesce(F.col("_map")[i], F.lit(0))).alias("_words"))
    placed = facts.withColumn("_place", place).withColumn("_block", F.expr(f"_place div {BLOCK_BITS}"))
    kept = placed.join(F.broadcast(table), "_block").where(
        F.getbit(F.get("_words", (word % BLOCK_WORDS).cast("int")), bit) == 1
    )
    return kept.select(*facts.columns)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    small: bool | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Join facts to a lookup (inner, left, left_semi or left_anti).

    A lookup known or counted to be small is broadcast, so the facts do not move.
    Otherwise both sides are shuffled on the key plus a salt: the facts' salt is a
    hash of their other columns, the lookup is repeated once per salt. A key holding a
    third of the facts is then spread over ``salts`` tasks. Where facts without a match
    are not wanted, a table of bits of bounded size drops most of them before the shuffle.
    """
    on = list(on)
    if fits_broadcast(lookup) if small is None else small:
        return facts.join(F.broadcast(lookup), on, how)
    salts = salts or default_salts(facts)
    others = [c for c in facts.columns if c not in on]
    if how in ("inner", "left_semi") and _hash_alike(facts, lookup, on):
        facts = member_filter(facts, lookup, on)
    if not others:
        return facts.join(lookup, on, how)
    return salted(facts, others, salts).join(repeated(lookup, salts), [*on, SALT], how).drop(SALT)


def without_ids(
    df: DataFrame, key: str, ids: DataFrame, id_column: str, small: bool | None = None
) -> DataFrame:
    """Rows whose key is known and not in the list (``NOT IN`` over non-NULL ids).

    A list read as text is brought to the key's type; what does not fit matches nothing.
    """
    same_type = F.col(id_column).try_cast(df.schema[key].dataType).alias(key)
    listed = ids.select(same_type).filter(F.col(key).isNotNull()).distinct()
    return lookup_join(df.filter(F.col(key).isNotNull()), listed, [key], "left_anti", small)


def assemble(base: DataFrame, *parts: DataFrame, on: Sequence[str] = ("teacher",)) -> DataFrame:
    """Left-join feature frames onto a base that must keep all its rows.

    Every frame is grouped by the same key already, so their hash partitioning is
    reused and only the base moves.
    """
    return reduce(lambda left, part: left.join(part, list(on), "left"), parts, base)


def duplicate_keys(df: DataFrame, on: Sequence[str] = ("teacher",)) -> DataFrame:
    """Keys occurring more than once; empty for a frame that is safe to ``assemble``."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
