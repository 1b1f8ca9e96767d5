"""Removal of word windows that already occur in an earlier document.

Documents are dealt to chunks of a few MB of text. A chunk hashes every window of its
documents (Rabin-Karp over word hashes), keeps each distinct window once with the
smallest id it has there, and sends the windows, packed by bucket, to be counted: a
bucket finds each window's smallest id overall and answers with one bit per window.
The chunk turns the answers back into maximal intervals of words.

- A window's bucket comes from a second hash, independent of the 64-bit one compared
  inside the bucket, so the bits that tell windows apart grow with the number of buckets.
- A window repeated in many documents reaches its bucket once per chunk, so no bucket
  depends on how often a window occurs. Buckets and chunks are sized from the total text.
- Only text (once) and 8 bytes per distinct window, with a packed owner, are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.words import Rolling, WordHashes, mixed, runs

CHUNK_CHARS = 4_000_000
BUCKET_WINDOWS = 500_000
_NULL_ID = np.iinfo(np.int64).max
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
KEPT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


def _planes(values: np.ndarray) -> bytes:
    """64-bit values with equal bytes side by side, which compresses well."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


class _Chunk:
    """The distinct windows of a chunk's documents, grouped by bucket."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        ids = table["doc_id"].to_pylist()
        texts = [t or b"" for t in table["text"].to_pylist()]
        keys = [_NULL_ID if i is None else i for i in ids]
        # equal ids are ordered by their texts, so that both passes number windows alike
        order = sorted(range(len(ids)), key=lambda i: (keys[i], xxhash.xxh3_64_intdigest(texts[i])))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        vocabulary, rolling = WordHashes(), [Rolling(window, base) for base in _BASES]
        hashes, second, self.counts = [], [], []
        for text in self.texts:
            words = vocabulary.of(text.split())
            hashes.append(rolling[0].of(words))
            second.append(rolling[1].of(mixed(words)))
            self.counts.append(len(hashes[-1]))
        self.keys = np.array([keys[i] for i in order], np.int64)
        self.owner_of = np.repeat(self.keys, self.counts)
        h = mixed(np.concatenate([*hashes, np.empty(0, np.uint64)]))
        b = ((mixed(np.concatenate([*second, np.empty(0, np.uint64)])) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((h, b))  # stable: equal windows stay in the order of their ids
        hs, bs = h[order], b[order]
        new = np.ones(len(h), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (bs[1:] != bs[:-1])
        first = order[new]
        # inside a bucket by first occurrence, so that the owners' ids ascend
        rank = np.lexsort((first, bs[new]))
        self.hash, self.bucket, self.owner = hs[new][rank], bs[new][rank], self.owner_of[first[rank]]
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.window_to = np.empty(len(h), np.int64)
        self.window_to[order] = place[np.cumsum(new) - 1]
        self.edges = np.flatnonzero(np.diff(self.bucket, prepend=-1))

    def spans(self) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of each bucket's part of the distinct windows."""
        if not len(self.edges):
            return []
        ends = [*self.edges[1:], len(self.bucket)]
        return [(int(self.bucket[a]), int(a), int(z)) for a, z in zip(self.edges, ends, strict=True)]


def _ask(window: int, buckets: int) -> Callable:
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, buckets)
        spans = chunk.spans()
        return pa.table(
            {
                "bucket": pa.array([s[0] for s in spans], pa.int64()),
                "chunk": pa.array([key[0].as_py()] * len(spans), pa.int64()),
                "hashes": pa.array([chunk.hash[a:z].tobytes() for _, a, z in spans], pa.binary()),
                "owners": pa.array(
                    [_planes(np.diff(chunk.owner[a:z], prepend=0)) for _, a, z in spans], pa.binary()
                ),
            }
        )

    return ask


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    blobs = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    owners = np.concatenate([np.cumsum(_from_planes(x)) for x in table["owners"].to_pylist()])
    hashes = np.concatenate(blobs)
    order = np.lexsort((owners, hashes))
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    least = owners[order][new][np.cumsum(new) - 1]
    late = np.empty(len(hashes), bool)
    late[order] = owners[order] > least
    parts = np.split(late, np.cumsum([len(x) for x in blobs])[:-1])
    kept = [i for i, part in enumerate(parts) if part.any()]
    return pa.table(
        {
            "chunk": table["chunk"].take(pa.array(kept, pa.int64())).combine_chunks(),
            "bucket": pa.array([key[0].as_py()] * len(kept), pa.int64()),
            "late": pa.array([np.packbits(parts[i]).tobytes() for i in kept], pa.binary()),
        }
    )


def _cut(window: int, buckets: int) -> Callable:
    def cut(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(docs, window, buckets)
        late = np.zeros(len(chunk.hash), bool)
        said = dict(zip(answers["bucket"].to_pylist(), answers["late"].to_pylist(), strict=True))
        for bucket, a, z in chunk.spans():
            if bucket in said:
                late[a:z] = np.unpackbits(np.frombuffer(said[bucket], np.uint8), count=z - a)
        drop = late[chunk.window_to] | (chunk.owner_of > chunk.owner[chunk.window_to])
        rows: dict[str, list] = {name: [] for name in ("n_words", "n_removed", "kept_text", "removed")}
        at = 0
        for text, count in zip(chunk.texts, chunk.counts, strict=True):
            words = text.split()
            spans = runs(np.flatnonzero(drop[at : at + count]).tolist(), window)
            at += count
            kept, done = [], 0
            for start, end in spans:
                kept += words[done:start]
                done = end
            kept += words[done:]
            rows["n_words"].append(len(words))
            rows["n_removed"].append(len(words) - len(kept))
            rows["kept_text"].append(b" ".join(kept).decode())
            rows["removed"].append([{"start": s, "end": e} for s, e in spans])
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table(
            {
                "doc_id": pa.array(chunk.ids, pa.int64()),
                "n_words": pa.array(rows["n_words"], pa.int64()),
                "n_removed": pa.array(rows["n_removed"], pa.int64()),
                "kept_text": pa.array(rows["kept_text"], pa.string()),
                "removed": pa.array(rows["removed"], pa.list_(span)),
            }
        )

    return cut


def remove_repeated_windows(docs: DataFrame, window: int = 50, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Drop every word covered by a window that also starts in a document with a smaller id.

    Returns one row per input row: ``doc_id, n_words, n_removed, kept_text`` (kept words
    joined by one space) and ``removed`` (maximal word intervals, end exclusive).

    Windows are judged on the input. A null text has no words. Rows with the same id
    remove nothing from each other; a null id counts as larger than every id. Repeats
    inside one document stay. Texts shorter than the window stay whole. Columns other
    than ``doc_id`` and ``text`` are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = -(-total // chunk_chars) or 1
    buckets = -(-total // (6 * BUCKET_WINDOWS)) or 1  # about six bytes a word
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    asked = dealt.groupBy("chunk").applyInArrow(
        _ask(window, buckets), "bucket long, chunk long, hashes binary, owners binary"
    )
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, late binary")
    return (
        dealt.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(_cut(window, buckets), KEPT)
    )
