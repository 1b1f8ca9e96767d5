"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a question with other values
in it has the same template. Windows of template tokens are hashed, and each window also with its
values left in, so that copies are found whatever they are made of; a table of fixed size
of the benchmark's hashes drops nearly all windows of a document where they are made, and
the rest is joined. Windows of one document and item on the same diagonal form a match if
their slots agree: each value of the item stands for one value of the document. Where they
do not, the match falls apart at the slots that disagree, and tokens in a row with the
item's own values are a match in any case.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.words import Rolling, each_text, mixed
from stayline.session import checkpointed

# fixed values: words that count as units after a number
_UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds "
    "ounce ounces ton tons ml l liter liters litre litres cup cups gallon gallons s sec secs second seconds "
    "min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars cent cents euro euros usd eur gbp mph kmh kwh watt watts volt volts"
).split()
_UNIT_NAMES = frozenset(_UNITS)
UNITS = frozenset(u.encode() for u in _UNITS)
LITERAL, NUMBER, UNIT, NAME, MEASURE = range(5)
WINDOW, LEAST_LITERALS, LEAST_TOKENS = 8, 4, 13
SLOTS = 1 << 22
GROUP_WORDS = 100_000
_KEPT_WORDS = 150_000
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*[%$€£]?")
_MEASURE = re.compile(r"[+-]?\d[\d.,]*([a-z]+)")
# what may stand before and after a number without being part of it
_BEFORE = "\"'`()[]{}<>|*#&!?;_\\“”„«»¿¡"
_AFTER = _BEFORE + ".,:/–—-"
_EDGE_BYTES = b"\"'`()[]{}<>|*#$%&!?.,;:-_/\\"
_EDGES = "\"'`()[]{}<>|*#$%&!?.,;:–—-_/\\“”„«»¿¡"
_BASE = 0x9E3779B97F4A7C15
_KINDS = np.array([xxhash.xxh3_64_intdigest(f"<{k}>") for k in ("", "number", "unit", "name", "measure")], np.uint64)
HIT = "place long, size long, hash long, slots array<long>"
Batches = Iterator[pa.RecordBatch]


def _letters(core: str | bytes) -> int:
    if core.lower() in (UNITS if isinstance(core, bytes) else _UNIT_NAMES):
        return UNIT
    return NAME if len(core) > 1 and core[:1].isupper() and core[1:].islower() else LITERAL


class _Kinds(dict):
    """A number for each word; ``value``, ``kind`` and ``ends`` hold what it is by itself."""

    def __init__(self) -> None:
        self.value, self.kind, self.ends = array("Q"), bytearray(), bytearray()

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_EDGE_BYTES)
        if core.isalpha():  # plain words, by far the most
            kind, low = _letters(core), core.lower()
        else:
            text = word.decode()
            number = text.lstrip(_BEFORE).rstrip(_AFTER)
            core = number if _NUMBER.fullmatch(number) else text.strip(_EDGES)
            low = core.lower()
            if core.isalpha():
                kind = _letters(core)
            elif _NUMBER.fullmatch(low):
                kind = NUMBER
            elif (m := _MEASURE.fullmatch(low)) and m[1].encode() in UNITS:
                kind = MEASURE
            else:
                kind = LITERAL
        self.value.append(xxhash.xxh3_64_intdigest(low) if core else 0)
        self.kind.append(kind)
        self.ends.append(word[-1] in b".!?:;|")
        number = self[word] = len(self.kind) - 1
        return number


class Tokens:
    """The template tokens of several texts in a row; pure punctuation is no token."""

    def __init__(self, kinds: _Kinds, texts: list[list[bytes]]):
        codes = np.fromiter(map(kinds.__getitem__, chain.from_iterable(texts)), np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        value = np.array(kinds.value, np.uint64)[codes]
        there = np.flatnonzero(value)
        codes, self.text, self.value = codes[there], text[there], value[there]
        kind = np.frombuffer(bytes(kinds.kind), np.uint8)[codes]
        ends = np.frombuffer(bytes(kinds.ends), np.bool_)[codes]
        same = np.zeros(len(codes), bool)
        same[1:] = self.text[1:] == self.text[:-1]
        first, after_number = ~same, same.copy()
        first[1:] |= ends[:-1]
        after_number[1:] &= kind[:-1] == NUMBER
        kind = np.where((kind == NAME) & first | (kind == UNIT) & ~after_number, LITERAL, kind)
        self.slot = kind != LITERAL
        self.hash = np.where(self.slot, _KINDS[kind], self.value)
        self.literals = np.concatenate(([0], np.cumsum(~self.slot)))
        self.start = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def windows(self, rolling: Rolling) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """(exact, places, hashes) of the windows inside one text, in both forms.

        The exact form of every window holds its values; the other has placeholders, for
        windows with a slot and enough literal tokens.
        """
        size = rolling.window
        count = max(len(self.hash) - size + 1, 0)
        inside = self.text[:count] == self.text[size - 1 :] if count else np.empty(0, bool)
        literals = self.literals[size:] - self.literals[:count] if count else np.empty(0, np.int64)
        for exact, tokens in ((True, self.value), (False, self.hash)):
            fits = inside if exact else inside & (literals >= LEAST_LITERALS) & (literals < size)
            places = np.flatnonzero(fits)
            yield exact, places, mixed(rolling.of(tokens)[places] + np.uint64(size))

    def row(self, place: int, size: int, h: np.uint64, bare: bool = False) -> tuple:
        """``place`` (in its text), ``size, hash, slots`` of a window; ``bare``: without slots."""
        own = slice(place, place + (0 if bare else size))
        slots = np.where(self.slot[own], self.value[own], 0).view(np.int64)
        return place - self.start[self.text[place]], size, h.astype(np.int64), slots


def _groups(texts: Iterator[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of the texts, in groups of many words; each with the number of its first text."""
    group, words, first = [], 0, 0
    for k, text in enumerate(texts):
        group.append((text or b"").split())
        words += len(group[-1])
        if words >= GROUP_WORDS:
            yield first, group
            group, words, first = [], 0, k + 1
    if group:
        yield first, group


def _item_windows(batches: Batches) -> Batches:
    rolling = {size: Rolling(size, _BASE) for size in range(1, WINDOW + 1)}
    kinds = _Kinds()
    for batch in batches:
        rows: list[tuple] = []
        for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            tokens = Tokens(kinds, [(text or b"").split()])
            size = min(WINDOW, len(tokens.hash))
            if item is None or not size:
                continue
            key = int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))
            for _, places, hashes in tokens.windows(rolling[size]):
                for place, h in zip(places, hashes, strict=True):
                    rows.append((item, key, len(tokens.hash), *tokens.row(place, size, h)))
        yield _batch(rows, ["item_id", "item_key", "n_tokens", "place", "size", "hash", "slots"])


def _doc_windows(sizes: list[int], wanted) -> Callable[[Batches], Batches]:
    def find(batches: Batches) -> Batches:
        rolling = [Rolling(size, _BASE) for size in sizes]
        kinds = _Kinds()
        for batch in batches:
            rows: list[tuple] = []
            ids, keys = batch["doc_id"].to_pylist(), batch["text_key"].to_pylist()
            for first, texts in _groups(each_text(batch["text"])):
                if len(kinds) > _KEPT_WORDS:
                    kinds = _Kinds()
                tokens = Tokens(kinds, texts)
                for windows in rolling:
                    for exact, places, hashes in tokens.windows(windows):
                        for k in np.flatnonzero(wanted.value[hashes % np.uint64(SLOTS)]):
                            doc = first + tokens.text[places[k]]
                            rows.append((ids[doc], keys[doc], *tokens.row(places[k], windows.window, hashes[k], exact)))
            yield _batch(rows, ["doc_id", "text_key", "place", "size", "hash", "slots"])

    return find


def _stretches(there: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each maximal stretch of true places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], there, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _standing(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the slots agree: a value of the item stands for one of the document.

    If it stands for several, those places agree that hold the value of more than half of
    its places, or none.
    """
    agree = np.ones(len(item), bool)
    slots = np.flatnonzero(item)
    for value in np.unique(item[slots]):
        places = slots[item[slots] == value]
        values, counts = np.unique(doc[places], return_counts=True)
        if len(values) > 1:
            main = counts.argmax()
            agree[places] = (doc[places] == values[main]) & (2 * counts[main] > len(places))
    return agree


def best_match(windows: list[dict], size: int, least: int) -> tuple[int, bool, int, int] | None:
    """``covered, same_values, first, last`` of the best match on one diagonal, in item places.

    A match is all windows, if their slots agree; else a stretch of tokens in a row, up to
    the slots that disagree in it, or of tokens in a row whose values are the item's own.
    """
    base = min(w["item_place"] for w in windows)
    width = max(w["item_place"] for w in windows) + size - base
    item, doc, there = np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width, bool)
    for w in windows:
        own = slice(w["item_place"] - base, w["item_place"] - base + size)
        # a window in the exact form has no slots of its own: its values are the item's
        item[own], doc[own], there[own] = w["item_slots"], w["slots"] or w["item_slots"], True
    same = item == doc
    stretches = _stretches(there & same)
    if _standing(item, doc).all():
        found = [(int(there.sum()), bool(same.all()), base, base + width - 1)]
    else:
        found = []
        for a, z in _stretches(there):
            agree = _standing(item[a : z + 1], doc[a : z + 1])
            stretches += [(a + b, a + y) for b, y in _stretches(agree)]
    found += [(z - a + 1, bool(same[a : z + 1].all()), base + a, base + z) for a, z in stretches]
    best = max(found, default=None)
    return best if best and best[0] >= least else None


def _judged(least_tokens: int) -> Callable[[Batches], Batches]:
    names = ["doc_id", "text_key", "item_id", "n_tokens", "covered", "same_values", "first", "last"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 2

    def judge(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                best = best_match(r["windows"], r["size"], min(least_tokens, r["n_tokens"]))
                if best:
                    covered, same, first, last = best
                    rows.append((*(r[n] for n in names[:4]), covered, same, first + r["diagonal"], last + r["diagonal"]))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return judge


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    kinds = [pa.int64()] * (len(names) - 1) + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names
    )


def template_matches(docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """The matches of documents with benchmark items, one row per document and item.

    ``doc_id, text_key, item_id, covered`` (the item's tokens in the longest match),
    ``n_tokens`` (of the item), ``first, last`` (the match's first and last token in the
    document) and ``same_values`` (false: re-parameterised).
    """
    spark = docs.sparkSession
    items = checkpointed(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
        .mapInArrow(_item_windows, f"item_id long, item_key long, n_tokens long, {HIT}")
    )
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    wanted = np.zeros(SLOTS, bool)
    # the hash is unsigned where it is made
    slots = items.select((F.col("hash").bitwiseAND(SLOTS - 1)).alias("slot")).distinct().toArrow()
    wanted[slots["slot"].to_numpy()] = True
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.col("text").cast("binary").alias("text"),
    )
    hits = rows.mapInArrow(
        _doc_windows(sizes, spark.sparkContext.broadcast(wanted)), f"doc_id long, text_key long, {HIT}"
    )
    # equal rows have the same hits; one of them is enough
    found = hits.join(
        items.select("size", "hash", "item_id", "item_key", "n_tokens", F.col("place").alias("item_place"), F.col("slots").alias("item_slots")),
        ["size", "hash"],
    ).withColumn("diagonal", F.col("place") - F.col("item_place"))
    window = F.struct("item_place", "item_slots", "slots")
    diagonals = (
        found.groupBy("doc_id", "text_key", "item_id", "item_key", "n_tokens", "size", "diagonal")
        .agg(F.collect_set(window).alias("windows"))
        .where(F.size("windows") * F.col("size") >= F.least(F.lit(least_tokens), "n_tokens"))
        .drop("item_key")
    )
    best = diagonals.mapInArrow(
        _judged(least_tokens),
        "doc_id long, text_key long, item_id long, n_tokens long, covered long, same_values boolean, first long, last long",
    ).groupBy("doc_id", "text_key", "item_id", "n_tokens")
    return best.agg(F.max(F.struct("covered", "same_values", "first", "last")).alias("m")).select(
        "doc_id", "text_key", "item_id", "n_tokens", "m.covered", "m.first", "m.last", "m.same_values"
    )


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """Every document row with the benchmark items it holds, values changed or not.

    Returns ``doc_id, text_key`` (hash of the text), ``contaminated`` (boolean), ``items``
    (ascending item ids) and ``reparameterised`` (those whose values differ).

    A document holds an item if one match covers ``least_tokens`` of its template tokens,
    or all of a shorter item. Where a value of the item stands for several of the document,
    the match ends at the places that disagree; tokens in a row with the item's own values
    are a match in any case. A match is made of windows of eight tokens, an item of fewer is
    one window; a window matches with its values, and with others if it has at least four
    literal tokens. Null and empty texts hold nothing and are in no document. Each row is judged by
    its own text, also where ids repeat or are null; items with a null id are left out, and
    rows of items that share an id count as one. Other columns are ignored.
    """
    matches = template_matches(docs, benchmark, least_tokens)
    verdicts = matches.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.array_sort(F.collect_set(F.when(~F.col("same_values"), F.col("item_id")))).alias("reparameterised"),
    )
    verdicts = checkpointed(
        verdicts.select(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key"), "items", "reparameterised")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    none = F.array().cast("array<long>")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key"))
    return rows.join(verdicts, same, "left").select(
        "doc_id",
        "text_key",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("reparameterised", none).alias("reparameterised"),
    )
