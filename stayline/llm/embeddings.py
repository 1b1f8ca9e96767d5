"""Linking of near-equal embeddings by randomised-rotation binary codes.

Equal vectors are one representative with a weight. Each is rotated at random; groups of
sign bits of the rotated vector are its keys in several tables, and vectors that share a
key in a table are compared. The first comparison only uses the binary code, its stored
correction factor and the other vector's rotated components in 8 bits: the estimate of
the inner product is unbiased, and where it is below the threshold by more than its
confidence bound the pair is done. Only vectors with a pair left in a bucket are fetched
there, and the cosine is computed in double precision.

A pair is counted in the first table in which it meets, and a bucket returns one row per
vector (number of links, smallest id of its component), never pairs. Buckets with many
vectors are cut into blocks whose pairs are separate pieces of work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.components import components
from stayline.session import checkpointed

BUCKET = 128
BLOCK = 2048
MISSED = 5e-4
DEVIATIONS = 3.0
Batches = Iterator[pa.RecordBatch]


def tables_for(count: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, tables) for so many vectors.

    Keys are long enough for buckets of about 100 unrelated vectors, and there are enough
    tables that a pair right at the threshold fails to meet with a chance of ``MISSED``.
    """
    bits = max(6, math.ceil(math.log2(max(count, 1) / BUCKET)))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(MISSED) / math.log1p(-(agree**bits)))


@cache
def _rotations(dim: int, bits: int) -> np.ndarray:
    """``dim`` x (at least ``bits``) columns of random rotations, the same in every process."""
    random = np.random.default_rng([dim, 20240601])
    parts = [np.linalg.qr(random.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.hstack(parts)


def _unit(vectors: list) -> np.ndarray:
    matrix = np.array(vectors, np.float64)
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _keys(rotated: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of every vector in every table."""
    signs = (rotated[:, : bits * tables] > 0).reshape(len(rotated), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _sketch(bits: int, tables: int) -> Callable[[Batches], Batches]:
    def sketch(batches: Batches) -> Batches:
        for batch in batches:
            columns = {k: batch[k].to_pylist() for k in ("rep", "tag", "vector")}
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(columns["vector"]):
                by_dim.setdefault(len(v), []).append(i)
            for dim, places in by_dim.items():
                rotated = _unit([columns["vector"][i] for i in places]) @ _rotations(dim, bits * tables)
                keys = _keys(rotated, bits, tables) + (np.arange(tables) << bits)
                own = rotated[:, :dim].astype(np.float32)
                low, high = own.min(axis=1, keepdims=True), own.max(axis=1, keepdims=True)
                step = np.maximum((high - low) / 255, np.float32(1e-12))
                levels = np.rint((own - low) / step).astype(np.uint8)
                factor = np.abs(own).sum(axis=1, keepdims=True) / np.float32(math.sqrt(dim))
                numbers = np.hstack((low, step, factor)).astype("<f4").view(np.uint8).reshape(len(own), 12)
                blobs = np.hstack((numbers, np.packbits(own > 0, axis=1), levels))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([columns["rep"][i] for i in places], pa.int64()),
                        pa.array([columns["tag"][i] for i in places], pa.int64()),
                        pa.array([dim] * len(places), pa.int64()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                        pa.array([b.tobytes() for b in blobs], pa.binary()),
                    ],
                    names=["rep", "tag", "dim", "keys", "sketch"],
                )

    return sketch


def _runs(batches: Batches, names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The complete runs of rows that are equal in the named columns, over batch borders."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not len(table):
            continue
        columns = np.column_stack([table[n].to_numpy() for n in names])
        starts = np.flatnonzero(np.concatenate(([True], (columns[1:] != columns[:-1]).any(axis=1))))
        for a, z in zip(starts, starts[1:], strict=False):
            yield table.slice(a, z - a)
        rest = table.slice(starts[-1])
    if rest is not None and len(rest):
        yield rest


def _sides(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sides; the same if a block meets itself."""
    own = run["own"].to_numpy()
    if run["low"][0].as_py() == run["high"][0].as_py():
        every = np.arange(len(own))
        return every, every
    return np.flatnonzero(own == run["low"][0].as_py()), np.flatnonzero(own == run["high"][0].as_py())


def _estimate(threshold: float) -> Callable[[Batches], Batches]:
    """The vectors of a bucket with a partner whose cosine may reach the threshold."""

    def candidates(run: pa.Table) -> np.ndarray:
        dim = run["dim"][0].as_py()
        blobs = np.frombuffer(b"".join(run["sketch"].to_pylist()), np.uint8).reshape(len(run), -1)
        numbers = blobs[:, :12].copy().view("<f4")
        packed = (dim + 7) // 8
        code = np.unpackbits(blobs[:, 12 : 12 + packed], axis=1, count=dim).astype(np.float32) * 2 - 1
        own = blobs[:, 12 + packed :].astype(np.float32) * numbers[:, 1:2] + numbers[:, :1]
        factor = numbers[:, 2]
        # estimate of <own, other>: <own, code> over the code's product with its own vector
        error = DEVIATIONS * np.sqrt(np.maximum(1 - factor**2, 0) / max(dim - 1, 1)) / factor
        one, two = _sides(run)
        near = np.zeros(len(run), bool)
        # a block with itself holds each pair both ways already
        for a, b in ((one, two), (two, one))[: 1 if one is two else 2]:
            if not len(a) or not len(b):
                continue
            for part in np.array_split(a, -(-len(a) // 512)):
                estimate = own[part] @ code[b].T / (math.sqrt(dim) * factor[b])
                hit = estimate >= threshold - error[b]
                hit &= part[:, None] != b[None, :]
                near[part] |= hit.any(axis=1)
                near[b] |= hit.any(axis=0)
        return near

    def estimate(batches: Batches) -> Batches:
        for run in _runs(batches, ("key", "dim", "low", "high")):
            if len(run) > 1 and (near := candidates(run)).any():
                kept = run.drop_columns(["sketch"]).filter(pa.array(near))
                yield from kept.combine_chunks().to_batches()

    return estimate


def _exact(threshold: float, bits: int, tables: int) -> Callable[[Batches], Batches]:
    """Number of links and smallest connected id of each vector, over the pairs counted here."""

    def links(run: pa.Table) -> pa.RecordBatch | None:
        unit = _unit(run["vector"].to_pylist())
        keys = _keys(unit @ _rotations(unit.shape[1], bits * tables), bits, tables)
        table = run["key"][0].as_py() >> bits
        reps, weight = run["rep"].to_numpy(), run["weight"].to_numpy()
        one, two = _sides(run)
        pairs = []
        for part in np.array_split(one, -(-len(one) // 256) or 1):
            i, j = np.nonzero(unit[part] @ unit[two].T >= threshold)
            i, j = part[i], two[j]
            i, j = (i[i < j], j[i < j]) if one is two else (i, j)
            first = (keys[i] == keys[j]).argmax(axis=1) if len(i) else np.empty(0, np.int64)
            pairs.append((i[first == table], j[first == table]))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(i):
            return None
        count = np.bincount(i, weight[j], len(run)) + np.bincount(j, weight[i], len(run))
        root = reps.copy()
        while True:
            before = root.copy()
            least = np.minimum(root[i], root[j])
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
            if (root == before).all():
                break
        linked = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(reps[linked]),
                run["tag"].combine_chunks().take(pa.array(linked)),
                pa.array(count[linked].astype(np.int64)),
                pa.array(root[linked]),
            ],
            names=["rep", "tag", "n", "root"],
        )

    def exact(batches: Batches) -> Batches:
        for run in _runs(batches, ("key", "dim", "low", "high")):
            if len(run) > 1 and (found := links(run)) is not None:
                yield found

    return exact


def link_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Number of links and component of every vector; two link with a cosine of ``threshold`` or more.

    Returns one row per input row: ``vec_id, n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable) and ``kept`` (it is its own component's id).
    No pair below the threshold is linked. A pair at the threshold meets in no table with a
    chance of 5e-4; the closer, the rarer.

    A vector that is null, empty, zero or holds a null or non-finite component links with
    nothing, nor does one with a null id or vectors of different lengths with each other.
    Rows that repeat an id are linked each by its own vector.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = checkpointed(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .select("vec_id", F.when(valid, F.col("embedding")).alias("vector"))
    )
    reps = checkpointed(
        rows.where("vector IS NOT NULL")
        .groupBy("vector")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
        .withColumn("tag", F.xxhash64("vector"))
    )
    bits, tables = tables_for(reps.count(), threshold)
    sketches = reps.select("rep", "tag", "vector").mapInArrow(
        _sketch(bits, tables), "rep long, tag long, dim long, keys array<long>, sketch binary"
    )
    sketches = checkpointed(sketches)
    entries = sketches.select("rep", "tag", "dim", "sketch", F.explode("keys").alias("key"))
    # at most tables x 2**bits rows, a hundredth of the entries; only the large buckets
    large = (
        entries.groupBy("key", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        .select("key", "dim", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    )
    entries = entries.join(checkpointed(large), ["key", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    entries = entries.withColumn("own", F.pmod(F.xxhash64("rep", "tag"), "blocks"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    entries = entries.select(
        "key", "dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "tag", "sketch"
    )
    work = ["key", "dim", "low", "high"]
    near = checkpointed(
        entries.repartition(*work)
        .sortWithinPartitions(*work)
        .mapInArrow(_estimate(threshold), "key long, dim long, low long, high long, own long, rep long, tag long")
    )
    found = checkpointed(
        near.join(reps, ["rep", "tag"])
        .repartition(*work)
        .sortWithinPartitions(*work)
        .mapInArrow(_exact(threshold, bits, tables), "rep long, tag long, n long, root long")
    )
    counts = found.groupBy("rep", "tag").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    known = (
        reps.join(counts, ["rep", "tag"], "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "vector",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    # equal vectors may be a third of all rows: both sides of the join stand in storage
    out = rows.join(checkpointed(known), "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
