"""Packing tokenised documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the squares of its
pieces' lengths). Pieces go, longest first, into the open sequence that fits under every
capacity and has the best score: the smallest weighted norm of what would remain of the
capacities, or the largest weighted dot product of the piece with what remains.

Pieces of one length are alike, so the choice is made for whole numbers of them: open
sequences with equal remaining capacities stand together as a range. That needs only the
number of pieces of each length, one row per length, whatever the size of the corpus; the
result is a table of ranges of pieces. Each task numbers its pieces of a length, sums over
tasks turn that into ranks, and the rank finds its range: no piece moves to be packed.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stayline.session import checkpointed

CAPACITY = 1024
WEIGHTS = (1.0, 0.0, 0.0)
TASKS_AT_ONCE = 1024
_PIECES = "piece int, start long, length int, ids_crc32 long, part int, nth long"
# the split that byte-level vocabularies of this kind are made for
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# no token reaches over the place between a character that is not white and one of these
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")
_SLICE = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The letters by which such vocabularies write bytes: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a ``tokenizers`` file.

    Its ids are those that ``tokenizers`` gives without added special tokens; this reader of
    the same file takes a quarter of the time.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {token["content"]: token["id"] for token in content["added_tokens"]}
    letters = _byte_letters()
    ranks = {
        bytes(letters[c] for c in word): place for word, place in content["model"]["vocab"].items() if word not in special
    }
    return tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, encoding: tiktoken.Encoding) -> np.ndarray:
    """The ids of a whole text; a long one is encoded in slices whose border no token crosses."""
    parts, start = [], 0
    while start < len(text):
        cut = _CUT.search(text, start + _SLICE) if len(text) - start > _SLICE else None
        end = cut.start() if cut else len(text)
        parts.append(encoding.encode_to_numpy(text[start:end], allowed_special="all"))
        start = end
    return np.concatenate(parts).astype("<u4") if parts else np.empty(0, "<u4")


def pieces_of(docs: DataFrame, path: str, end_id: int, longest: int) -> DataFrame:
    """``doc_id`` and the pieces of every document, with the task and the piece's number there.

    A document ends with ``end_id``. Longer ones are cut from the back, so the first piece may
    be the shorter one. ``nth`` counts the pieces of one length inside the task ``part``.
    """
    own = docs.select("doc_id", "text")
    schema = StructType([own.schema["doc_id"], *StructType.fromDDL(_PIECES)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part = vocabulary(path), TaskContext.get().partitionId()
        seen = np.zeros(longest + 1, np.int64)
        for batch in batches:
            rows, found = [], []
            for row, value in enumerate(batch.column(1).cast(pa.binary())):
                text = (value.as_py() or b"").decode("utf-8", "replace")
                ids = np.append(token_ids(text, encoding), np.uint32(end_id)).astype("<u4")
                edges = [0, *range(len(ids) % longest or longest, len(ids) + 1, longest)]
                for piece, (start, end) in enumerate(zip(edges, edges[1:])):
                    rows.append(row)
                    found.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), part, seen[end - start]))
                    seen[end - start] += 1
            columns = list(zip(*found)) if found else [()] * 6
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return own.mapInArrow(cut, schema)


class Bins:
    """Open sequences with equal remaining capacities, as ranges of consecutive numbers."""

    def __init__(self, capacities: Sequence[int], weights: Sequence[float], by: str):
        self.full = np.array(capacities, dtype=np.int64)
        self.weights, self.by = np.array(weights) / self.full**2.0, by
        self.left = np.empty((0, 3), np.int64)
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.used = 0

    def scores(self, left: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Smaller is better; sequences that cannot take the item are infinitely bad."""
        rest = left - item
        score = (rest.astype(float) ** 2 @ self.weights) if self.by == "norm" else -(left * item.astype(float) @ self.weights)
        return np.where((rest >= 0).all(axis=1), score, np.inf)

    def _add(self, left: np.ndarray, first: int, count: int) -> None:
        if count:
            self.left = np.vstack([self.left, left])
            self.first, self.count = np.append(self.first, first), np.append(self.count, count)

    def place(self, length: int, pieces: int) -> list[tuple[int, int, int, int, int, int]]:
        """Put pieces of a length in: ``length, first rank, pieces, first sequence, per sequence, offset``."""
        item = np.array([length, 1, length * length])
        done = 0
        found = []
        while done < pieces:
            score = self.scores(self.left, item) if len(self.left) else np.array([np.inf])
            best = int(np.argmin(score))
            if np.isinf(score[best]):
                left, first = self.full, self.used
                each = int((left // item).min())
                count = -(-(pieces - done) // each)
                self.used += count
            else:
                left, first, count = self.left[best], int(self.first[best]), int(self.count[best])
                keep = np.arange(len(self.count)) != best
                self.left, self.first, self.count = self.left[keep], self.first[keep], self.count[keep]
                # a sequence goes on taking pieces as long as that makes it the better choice
                each = int((left // item).min()) if self.by == "norm" else 1
            taken = min(pieces - done, each * count)
            whole, rest = divmod(taken, each)
            found.append((length, done, taken, first, each, int(self.full[0] - left[0])))
            self._add(left - each * item, first, whole)
            if rest:
                self._add(left - rest * item, first + whole, 1)
            self._add(left, first + whole + bool(rest), count - whole - bool(rest))
            done += taken
            # what has no token left takes nothing more
            open_ = (self.left > 0).all(axis=1)
            self.left, self.first, self.count = self.left[open_], self.first[open_], self.count[open_]
        return found


def plan(
    lengths: dict[int, int], capacities: Sequence[int], weights: Sequence[float] = WEIGHTS, by: str = "norm"
) -> tuple[np.ndarray, int]:
    """The ranges of pieces for numbers of pieces by length, longest first, and the number of sequences."""
    bins = Bins(capacities, weights, by)
    found = [row for length in sorted(lengths, reverse=True) for row in bins.place(length, lengths[length])]
    return np.array(found, dtype=np.int64).reshape(-1, 6), bins.used


def _before(counts: DataFrame) -> DataFrame:
    """``part, length, before``: pieces of a length in the tasks before, summed in two levels."""
    grouped = counts.withColumn("block", F.expr(f"part div {TASKS_AT_ONCE}"))
    inside = Window.partitionBy("length", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = grouped.groupBy("length", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("length", "block", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("blocks_before"))
    own = grouped.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return own.join(blocks, ["length", "block"]).select("part", "length", (F.col("own") + F.col("blocks_before")).alias("before"))


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int,
    tokens: int = CAPACITY,
    documents: int | None = None,
    cost: int | None = None,
    weights: Sequence[float] = WEIGHTS,
    by: str = "norm",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``path`` is a byte-level vocabulary file, read on the executors. A sequence holds at most
    ``tokens`` tokens, pieces of ``documents`` documents and the attention ``cost`` (sum of
    squared lengths); without the last two they bind nothing. A document longer than a
    sequence may be is cut into pieces of that length, the first one shorter.
    ``weights`` of the three capacities and ``by`` (``norm`` or ``dot``) choose sequences.

    Null and empty texts are the end token alone. Whole texts are read, long ones in slices.
    Bytes that are not UTF-8 count as replacement characters. Every row is a document of its
    own, rows that repeat an id or are equal too; ids may be null. An empty table gives no
    rows. Other columns are ignored. Which of several pieces of one length goes where follows
    from the order of the input's files.
    """
    if by not in ("norm", "dot"):
        raise ValueError("by is norm or dot")
    documents, cost = documents or tokens, cost or tokens * tokens
    longest = min(tokens, int(cost**0.5))
    pieces = checkpointed(pieces_of(docs, path, end_id, longest))
    counts = checkpointed(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges, _ = plan(lengths, (tokens, documents, cost), weights, by)
    # rank and length in one number: ranges are found by bisection
    order = np.lexsort((ranges[:, 1], ranges[:, 0]))
    ranges = ranges[order]
    starts = (ranges[:, 0] << 44) + ranges[:, 1]
    ranked = pieces.join(_before(counts), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    schema = StructType(
        [
            *[f for f in ranked.schema if f.name not in ("length", "rank", "ids_crc32")],
            *[StructField(n, LongType()) for n in ("length", "ids_crc32", "sequence_id", "offset")],
        ]
    )

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy().astype(np.int64)
            rank = batch.column(5).to_numpy()
            own = ranges[np.searchsorted(starts, (length << 44) + rank, "right") - 1]
            sequence, place = np.divmod(rank - own[:, 1], own[:, 4])
            arrays = [*batch.columns[:3], pa.array(length), batch.column(4)]
            arrays += [pa.array(own[:, 3] + sequence), pa.array(own[:, 5] + place * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return ranked.mapInArrow(put, schema)
