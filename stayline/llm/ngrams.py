"""Jaccard join of documents on word n-grams, by prefix filtering.

The n-grams of a document are ordered rare first; two sets that are similar enough share
one of the first few. The order is by how often the n-gram's slot of a table of fixed
size was hit over all documents, then by hash, so the table can be broadcast at any size.

Links are only needed as far as they connect, so no group is joined with itself as a
whole: first every document that shares an n-gram with a leader (the most central
document of that n-gram's list) is compared with it, then what is still unconnected
within a list is compared in pairs. Length, positional and suffix filters come before
the sets are fetched, and a pair is verified once.

The lists are made for a part of the n-grams at a time, and what a step has written goes
when the next ones no longer read it, so the disk holds a fraction of all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.components import components
from stayline.llm.words import WordHashes, each_text, lower_ascii, shingles
from stayline.session import checkpointed, scratch_tables

SLOTS = 1 << 18
SLICE = 1 << 14
BINS = 256
ID_SLOTS = 1 << 20
BLOCK = 256
PARTS = 2
Batches = Iterator[pa.RecordBatch]


class _Sets:
    """The n-gram sets of texts, and their digests."""

    def __init__(self, size: int):
        self.size, self.vocabulary = size, WordHashes()

    def of(self, text: bytes | None) -> np.ndarray:
        return shingles(self.vocabulary.of(lower_ascii(text or b"").split()), self.size)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _count(size: int) -> Callable[[Batches], Batches]:
    """Set size and digest of each text; at the end of a task, the hits of each slot."""

    def count(batches: Batches) -> Batches:
        sets, hits = _Sets(size), np.zeros(SLOTS, np.int64)
        for batch in batches:
            sizes, high, low = [], [], []
            for text in each_text(batch["text"]):
                grams = sets.of(text)
                hits += np.bincount((grams % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS) if len(grams) > 20_000 else 0
                if len(grams) <= 20_000:
                    np.add.at(hits, (grams % np.uint64(SLOTS)).astype(np.int64), 1)
                digest = _digest(grams)
                sizes.append(len(grams))
                high.append(digest[0])
                low.append(digest[1])
            empty = pa.nulls(len(sizes), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), empty],
                names=["doc_id", "text_key", "n", "high", "low", "hits"],
            )
        nothing = pa.nulls(SLOTS // SLICE, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [nothing, nothing, pa.array(range(SLOTS // SLICE), pa.int64()), nothing, nothing, pa.array(list(hits.reshape(-1, SLICE)), pa.list_(pa.int64()))],
            names=["doc_id", "text_key", "n", "high", "low", "hits"],
        )

    return count


def _prefixes(size: int, percent: int, loads) -> Callable[[Batches], Batches]:
    """Each text's first n-grams in rare-first order, its centrality and its bins."""

    def prefixes(batches: Batches) -> Batches:
        sets, load = _Sets(size), loads.value
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "n", "high", "low", "rarest", "grams", "bins")}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), each_text(batch["text"]), strict=True):
                grams = sets.of(text)
                if doc_id is None or not len(grams):
                    continue
                length = len(grams) - -(-percent * len(grams) // 100) + 1
                weight = load[grams % np.uint64(SLOTS)]
                if length < len(grams):
                    # at most the last of the prefix may be tied, which the hash decides
                    near = np.flatnonzero(weight <= np.partition(weight, length - 1)[length - 1])
                else:
                    near = np.arange(len(grams))
                first = near[np.lexsort((grams[near], weight[near]))][:length]
                digest = _digest(grams)
                rows["doc_id"].append(doc_id)
                rows["n"].append(len(grams))
                rows["high"].append(digest[0])
                rows["low"].append(digest[1])
                rows["rarest"].append(int(weight[first[0]]))
                rows["grams"].append(grams[first].view(np.int64))
                rows["bins"].append(np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=BINS).astype(np.int32))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, kind) for v, kind in zip(rows.values(), kinds, strict=True)], names=list(rows)
            )

    return prefixes


def _fetch(size: int, wanted) -> Callable[[Batches], Batches]:
    """The sets of the ids whose slot is wanted."""

    def fetch(batches: Batches) -> Batches:
        sets = _Sets(size)
        for batch in batches:
            keep = np.flatnonzero(wanted.value[batch["slot"].to_numpy()])
            batch = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([sets.of(t).tobytes() for t in each_text(batch["text"])], pa.binary())],
                names=["doc_id", "grams"],
            )

    return fetch


def _verify(percent: int) -> Callable[[Batches], Batches]:
    """Rows come sorted: the set of a, then those of the b to compare with it."""

    def verify(batches: Batches) -> Batches:
        at, own = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            ends = (batch[k].to_pylist() for k in ("a", "block", "b"))
            for a, block, b, blob in zip(*ends, each_text(batch["grams"]), strict=True):
                grams = np.frombuffer(blob, np.uint64)
                if (a, block) != at:
                    at, own = (a, block), []
                if b is None:
                    own.append(grams)
                    continue
                for mine in own:
                    both = np.concatenate((mine, grams))
                    both.sort(kind="stable")
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * common >= percent * (len(both) - common):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

    return verify


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.spark = docs.sparkSession
        self.rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
        )
        self.keyed = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key")
        )

    def _slot_table(self, slots: DataFrame, size: int, kind: type) -> np.ndarray:
        """A table of fixed size on the driver, from rows of ``slot, value``."""
        table = np.zeros(size, kind)
        rows = slots.toArrow()
        table[rows["slot"].to_numpy()] = rows["value"].to_numpy()
        return table

    def classes(self) -> np.ndarray:
        """Set sizes, classes of equal sets, and the hits of each slot."""
        counted = checkpointed(
            self.keyed.mapInArrow(_count(self.size), "doc_id long, text_key long, n long, high long, low long, hits array<long>")
        )
        self.counted = counted.where("hits IS NULL").drop("hits")
        hits = counted.where("hits IS NOT NULL").select("n", F.posexplode("hits").alias("place", "hit"))
        loads = hits.groupBy((F.col("n") * SLICE + F.col("place")).alias("slot")).agg(F.sum("hit").alias("value"))
        self.heads = (
            self.counted.where("n > 0 AND doc_id IS NOT NULL")
            .groupBy("high", "low")
            .agg(F.min("doc_id").alias("head"))
        )
        return self._slot_table(loads.where("value > 0"), SLOTS, np.int64)

    def first_grams(self, loads: np.ndarray) -> None:
        """The prefixes of one document of each class."""
        prefixes = self.rows.mapInArrow(
            _prefixes(self.size, self.percent, self.spark.sparkContext.broadcast(loads)),
            "doc_id long, n long, high long, low long, rarest long, grams array<long>, bins array<int>",
        )
        self.prefixes = checkpointed(
            prefixes.join(
                self.heads.withColumnRenamed("head", "doc_id"), ["doc_id", "high", "low"], "left_semi"
            ).drop("high", "low")
        )

    def lists(self) -> None:
        """The prefix n-grams that several documents have, each with its leader."""
        places = self.prefixes.select("doc_id", "n", "rarest", F.posexplode("grams").alias("place", "gram"))
        parts = []
        for part in range(PARTS):
            own = places.where(F.pmod("gram", F.lit(PARTS)) == part)
            with scratch_tables(self.spark) as keep:
                leaders = checkpointed(
                    own.groupBy("gram")
                    .agg(
                        F.min(F.struct((-F.col("rarest")).alias("order"), "doc_id", "n", "place")).alias("lead"),
                        F.count(F.lit(1)).alias("many"),
                    )
                    .where("many > 1")
                    .select(
                        "gram",
                        F.col("lead.doc_id").alias("leader"),
                        F.col("lead.n").alias("leader_n"),
                        F.col("lead.place").alias("leader_place"),
                    )
                )
                parts.append(keep(own.drop("rarest").join(leaders, "gram")))
        self.places = reduce(DataFrame.unionByName, parts)

    def _possible(self, n: tuple, place: tuple) -> F.Column:
        """Length and positional filter, for sets of n that have an n-gram at place."""
        p = self.percent
        overlap = F.least(*(a - b for a, b in zip(n, place, strict=True)))
        return (100 * F.least(*n) >= p * F.greatest(*n)) & ((100 + p) * overlap >= p * (n[0] + n[1]))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that are similar enough."""
        with scratch_tables(self.spark) as keep:
            return self._verified(pairs, keep)

    def _verified(self, pairs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        bins = self.prefixes.select(F.col("doc_id"), "n", "bins")
        for end in ("a", "b"):
            pairs = pairs.join(
                bins.select(F.col("doc_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("bins").alias(f"bins_{end}")), end
            )
        # suffix filter: n-grams whose hashes start differently are not common
        common = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
        near = (100 + self.percent) * common >= self.percent * (F.col("n_a") + F.col("n_b"))
        pairs = keep(pairs.where(near).select("a", "b"))
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(ID_SLOTS))
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
        wanted = self._slot_table(ids.select(slot.alias("slot")).distinct().withColumn("value", F.lit(True)), ID_SLOTS, np.bool_)
        if not wanted.any():
            return pairs
        sets = self.rows.select("doc_id", "text", slot.alias("slot")).where("doc_id IS NOT NULL").mapInArrow(
            _fetch(self.size, self.spark.sparkContext.broadcast(wanted)), "doc_id long, grams binary"
        )
        # only ids that stand in a pair are stored: the slots let others through
        sets = checkpointed(sets.join(ids.distinct(), "doc_id", "left_semi"))
        blocks = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).alias("blocks"))
        dealt = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), "b")
        members = dealt.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "block", "b", "grams")
        owners = (
            dealt.select("a", "block").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a")
            .select("a", "block", F.lit(None).cast("long").alias("b"), "grams")
        )
        return keep(
            owners.unionByName(members)
            .repartition("a", "block")
            .sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
            .mapInArrow(_verify(self.percent), "a long, b long")
        )

    def leader_pairs(self) -> DataFrame:
        fits = self._possible(
            (F.col("n"), F.col("leader_n")), (F.col("place"), F.col("leader_place"))
        )
        return (
            self.places.where(fits & (F.col("doc_id") != F.col("leader")))
            .select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
            .distinct()
        )

    def other_pairs(self, labels: DataFrame) -> DataFrame:
        """Pairs without the leader in a list that its links have not connected."""
        with scratch_tables(self.spark) as keep:
            marked = checkpointed(
                self.places.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
                    "gram", "doc_id", "n", "place", "leader", F.coalesce("component", "doc_id").alias("component")
                )
            )
            open_grams = checkpointed(
                marked.where("doc_id <> leader")
                .groupBy("gram")
                .agg(F.min("component").alias("least"), F.max("component").alias("most"))
                .where("least <> most")
                .select("gram")
            )
            rest = keep(marked.where("doc_id <> leader").join(open_grams, "gram").drop("leader"))
        one = rest.select("gram", *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "n", "place", "component")))
        two = rest.select("gram", *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "place", "component")))
        fits = self._possible(
            (F.col("n_a"), F.col("n_b")), (F.col("place_a"), F.col("place_b"))
        )
        return (
            one.join(two, "gram")
            .where(fits & (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("component_a") != F.col("component_b")))
            .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
            .distinct()
        )

    def result(self) -> DataFrame:
        loads = self.classes()
        with scratch_tables(self.spark) as keep:
            self.first_grams(loads)
            self.lists()
            links = self.verified(self.leader_pairs())
            links = links.unionByName(self.verified(self.other_pairs(components(links))))
            joined = components(links).withColumnRenamed("node", "head")
            heads = self.heads.join(joined, "head", "left").select(
                "high", "low", F.coalesce("component", "head").alias("component")
            )
            # the ids of a class of copies may be a third of all rows: both sides stand in storage
            heads = keep(heads)
        return self.counted.join(heads, ["high", "low"], "left").select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
            "text_key",
        )


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Connect documents whose word n-gram sets have a Jaccard similarity of ``percent`` / 100.

    Words are compared with A to Z in lower case. Returns one row per input row: ``doc_id,
    n_shingles`` (size of the set of distinct n-grams), ``component_id`` (smallest id
    reachable by links, itself included) and ``text_key`` (hash of the text). Nothing is missed: the filters only drop pairs
    that cannot be similar enough, and pairs left out as already connected change no
    component.

    A text shorter than ``size`` words has its whole sequence as its one n-gram. Null and
    empty texts have none and link with nothing. A row with a null id links with nothing
    and has a null component. Rows that repeat an id are compared each by its own text.
    Columns other than ``doc_id`` and ``text`` are ignored.
    """
    return _Join(docs, size, percent).result()
