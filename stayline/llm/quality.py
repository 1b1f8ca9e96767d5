"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

Both are logistic models of a bounded sample of labelled rows, which the driver holds, and
of all unlabelled rows, of which each view hands its surest ones, with the label it sees,
to the other. The unlabelled rows stay where they are: histograms of the logits choose the
rows, and the partitions' sums of slopes and curvatures fit the models. Which rows have been
handed over follows from the models and bounds of the rounds before. Held-out labelled rows
calibrate each view and weigh the two. All documents are then scored in one pass without a
shuffle.

The view of the text holds its shape and its words: what the labelled texts that hold a word
say of each target. A second target, of documents that are unwanted whatever their quality,
is trained the same way on the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.words import each_text
from stayline.session import checkpointed

LABELLED = 20_000
ROUNDS = 4
HANDED = 0.05
SURE = float(np.log(9))
BINS, MOST_LOGIT = 6000, 30
# sums of so many partitions meet in a task
FAN = 256
_SUMS = "place long, total array<double>"
RIDGE = 1.0
SOURCE_SLOTS, LANG_SLOTS = 32, 16
# places of hashed words, parts of the labelled rows that are left out in turn, and the
# labelled texts without evidence that stand beside every word's own
WORD_SLOTS, FOLDS, DOUBT = 1 << 17, 4, 10.0
Batches = Iterator[pa.RecordBatch]

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()", b"!?", b"|<>{}[]\\/_=~^`", b"#$%&*@+", b" \t\r\x0b\x0c", b"\n"]
_MEMBER = np.zeros((256, len(_CLASSES) + 1))
for _k, _chars in enumerate(_CLASSES):
    _MEMBER[list(_chars), _k] = 1
_MEMBER[128:, len(_CLASSES)] = 1


def text_features(text: bytes | None) -> list[float]:
    """What the text itself shows: shares of kinds of characters, repetition, lengths."""
    text = text or b""
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MEMBER / max(len(text), 1)
    words, lines = text.split(), text.split(b"\n")
    distinct = set(words)
    n = max(len(words), 1)
    length = len(text) - text.count(b" ") - len(lines) + 1
    return [
        *np.sqrt(shares),
        np.log1p(len(words)),
        len(distinct) / n,
        len(distinct) / np.sqrt(n),
        np.log1p(length / n),
        np.log1p(sum(map(len, distinct)) / max(len(distinct), 1)),
        len(set(lines)) / len(lines),
        np.log1p(len(words) / len(lines)),
    ]


_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def _word_places(text: bytes | None) -> np.ndarray:
    """The places of a text's different words (runs of letters and digits, A to Z in lower case), in order."""
    words = set((text or b"").translate(_PLAIN).split())
    places = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & np.uint64(WORD_SLOTS - 1)
    places.sort()
    return places.astype(np.int64)


@dataclass
class Words:
    """What words say of each target: log odds of the labelled texts that hold them, above all texts'.

    ``odds[0]`` is of all labelled texts, ``odds[1 + f]`` of all but those of fold ``f``, so
    that no text is told its own label; each has a row per target.
    """

    odds: np.ndarray

    @classmethod
    def count(cls, rows: DataFrame, targets: int) -> Words:
        """From ``text, fold`` and the labels ``mark_0`` onward; sums by word and fold reach the driver."""
        names = [f"{what}_{k}" for k in range(targets) for what in ("held", "marked")]

        def add(batches: Batches) -> Batches:
            # the last place counts the texts
            total = np.zeros((2 * targets, FOLDS, WORD_SLOTS + 1))
            for batch in batches:
                marks = zip(*(batch[f"mark_{k}"].to_pylist() for k in range(targets)), strict=True)
                for text, fold, mark in zip(each_text(batch["text"]), batch["fold"].to_pylist(), marks, strict=True):
                    places = np.append(_word_places(text), WORD_SLOTS)
                    for k, value in enumerate(mark):
                        if value is not None:
                            total[2 * k, fold, places] += 1
                            total[2 * k + 1, fold, places] += value
            fold, place = np.nonzero(total[::2].any(axis=0))
            arrays = [fold, place, *(t[fold, place] for t in total)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["fold", "place", *names])

        sums = rows.mapInArrow(add, "fold long, place long, " + ", ".join(f"{n} double" for n in names))
        found = sums.groupBy("fold", "place").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        total = np.zeros((2 * targets, FOLDS, WORD_SLOTS + 1))
        at = found["fold"].to_numpy(), found["place"].to_numpy()
        for own, name in zip(total, names, strict=True):
            own[at] = found[name].to_numpy()
        everything = total.sum(axis=1, keepdims=True)
        return cls(_log_odds(np.concatenate((everything, everything - total), axis=1)).astype(np.float32))

    def features(self, text: bytes | None, fold: int | None) -> list[float]:
        """Of each target the largest, the smallest and the mean log odds of the words."""
        places = _word_places(text)
        if not len(places):
            return [0.0] * (3 * self.odds.shape[1])
        own = self.odds[0 if fold is None else 1 + fold][:, places]
        return np.stack((own.max(axis=1), own.min(axis=1), own.mean(axis=1)), axis=1).ravel().tolist()


def _log_odds(total: np.ndarray) -> np.ndarray:
    """(fold, target, place) from the numbers of texts and of marked ones, (2 x target, fold, place)."""
    held, marked = total[::2], total[1::2]
    texts, share = held[..., -1:], marked[..., -1:] / np.maximum(held[..., -1:], 1)
    known = (texts > 0) & (share > 0) & (share < 1)
    share = np.where(known, share, 0.5)
    odds = np.log((marked + DOUBT * share) / (held - marked + DOUBT * (1 - share))) - np.log(share / (1 - share))
    return np.where(known, odds, 0.0)[..., :-1].swapaxes(0, 1)


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What the page says about itself: language and source as hashed places, stated length."""
    row = np.zeros(LANG_SLOTS + SOURCE_SLOTS + 2)
    row[0 if lang is None else 1 + xxhash.xxh3_64_intdigest(lang) % (LANG_SLOTS - 1)] = 1
    row[LANG_SLOTS + (0 if source is None else 1 + xxhash.xxh3_64_intdigest(source) % (SOURCE_SLOTS - 1))] = 1
    row[-2] = np.log1p(max(n_chars or 0, 0))
    row[-1] = n_chars is None
    return list(row)


@dataclass
class Logistic:
    """A ridge logistic model of standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    # loss and weights before the last step
    before: tuple[float, np.ndarray] | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Logistic:
        model = cls(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), np.zeros(2 * x.shape[1] + 1))
        for _ in range(25):
            if model.step(model.sums(x, y), ridge) < 1e-6:
                break
        return model

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The slope of the loss, below it its curvature and the loss, summed over the rows."""
        total = np.zeros((len(self.weights) + 2, len(self.weights)))
        for rows in np.array_split(np.arange(len(x)), len(x) // 4096 + 1):
            design = self._design(x[rows])
            logit = np.clip(design @ self.weights, -30, 30)
            p = 1 / (1 + np.exp(-logit))
            total[0] += design.T @ (p - y[rows])
            total[1:-1] += (design * (p * (1 - p) + 1e-6)[:, None]).T @ design
            total[-1, 0] += (np.logaddexp(0, logit) - y[rows] * logit).sum()
        return total

    def step(self, total: np.ndarray, ridge: float = RIDGE) -> float:
        """One Newton step by the sums over all rows, or half the last one back if it went too far.

        Returns the largest change of a weight.
        """
        penalty = np.full(len(self.weights), ridge)
        penalty[0] = 1e-6
        loss = total[-1, 0] + (penalty * self.weights**2).sum() / 2
        if self.before is not None and loss > self.before[0] + 1e-9 * abs(self.before[0]):
            change = (self.before[1] - self.weights) / 2
        else:
            change = -np.linalg.solve(total[1:-1] + np.diag(penalty), total[0] + penalty * self.weights)
            self.before = loss, self.weights
        self.weights = self.weights + change
        return float(np.abs(change).max())

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack((np.ones((len(z), 1)), z, z * z))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -30, 30)


def _bins(logit: np.ndarray) -> np.ndarray:
    return np.clip((logit + MOST_LOGIT) * (BINS / (2 * MOST_LOGIT)), 0, BINS - 1).astype(np.int64)


def _bound(counts: np.ndarray, wanted: float) -> tuple[int, float]:
    """The bin up to which ``wanted`` rows lie, counted from the first, and the share of it."""
    sums = np.cumsum(counts)
    at = int(np.searchsorted(sums, wanted))
    if wanted <= 0 or at >= len(counts):
        return (-1, 0.0) if wanted <= 0 else (len(counts), 0.0)
    return at, float((wanted - (sums[at] - counts[at])) / counts[at])


@dataclass
class Round:
    """The views of a round and, for each, the bins (with a share of the last) that it hands over."""

    views: tuple[Logistic, Logistic]
    low: list[tuple[int, float]]
    high: list[tuple[int, float]]
    # logits beyond which a row may be handed over
    bars: tuple[float, float]

    @classmethod
    def choose(cls, views: tuple[Logistic, Logistic], counts: np.ndarray, good: float, handed: float) -> Round:
        """As many of each label as the labels' own shares, the surest first."""
        low, high = [], []
        for own in counts:
            take = handed * own.sum()
            low.append(_bound(own, take * (1 - good)))
            at, share = _bound(own[::-1], take * good)
            high.append((BINS - 1 - at, share))
        # a rare label is not handed over, nor a common one, by a view that knows no more than their shares
        usual = float(np.log(good / (1 - good)))
        return cls(views, low, high, (min(0.0, usual) - SURE, max(0.0, usual) + SURE))

    def given(self, parts: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> list[np.ndarray]:
        """For each view 1 and -1 where it hands the row over as good and bad, else 0."""
        out = []
        for view, part, (low, low_share), (high, high_share) in zip(self.views, parts, self.low, self.high, strict=True):
            logit = view.logit(part)
            bins = _bins(logit)
            good = (logit > self.bars[1]) & ((bins > high) | (bins == high) & (place < high_share))
            bad = (logit < self.bars[0]) & ((bins < low) | (bins == low) & (place < low_share))
            out.append(good.astype(np.int64) - bad)
        return out


def _state(rounds: list[Round], parts: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows are not handed over yet, and for each view the labels it was given (1, -1, or 0)."""
    free, labels = np.ones(len(place), bool), [np.zeros(len(place), np.int64) for _ in range(2)]
    for r in rounds:
        one, two = r.given(parts, place)
        labels[0][free], labels[1][free] = two[free], one[free]
        free &= (one == 0) & (two == 0)
    return free, labels


class Pool:
    """The unlabelled rows: ``place`` (from 0 to 1, by hash), ``by_text`` and ``by_metadata``."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("place", "by_text", "by_metadata")

    def total(self, of: Callable[[tuple[np.ndarray, np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray | None:
        """The sum of ``of(parts, place)`` over all rows.

        All partitions work at once and return one sum each; ``FAN`` of these meet in a
        group, and the groups' on the driver, always in the order of the partitions.
        """

        def add(batches: Batches) -> Batches:
            total = None
            for batch in batches:
                if len(batch):
                    parts = tuple(batch[c].flatten().to_numpy().reshape(len(batch), -1) for c in ("by_text", "by_metadata"))
                    own = of(parts, batch["place"].to_numpy())
                    total = own if total is None else total + own
            if total is not None:
                place = pa.array([TaskContext.get().partitionId()], pa.int64())
                yield pa.RecordBatch.from_arrays([place, pa.array([total], pa.list_(pa.float64()))], names=["place", "total"])

        def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"place": [key[0]], "total": [_in_order(list(frame["place"]), list(frame["total"]))]})

        sums = self.rows.mapInArrow(add, _SUMS)
        found = sums.groupBy(F.expr(f"place div {FAN}")).applyInPandas(join, _SUMS).collect()
        return _in_order([r.place for r in found], [r.total for r in found]) if found else None

    def moments(self, rounds: list[Round]) -> list[np.ndarray]:
        """``_moments`` of each view over the rows that it was given."""

        def of(parts, place):
            _, labels = _state(rounds, parts, place)
            return np.concatenate([_moments(x[y != 0]).ravel() for x, y in zip(parts, labels, strict=True)])

        found = self.total(of)
        first = 3 * len(rounds[0].views[0].mean)
        return [part.reshape(3, -1) for part in np.split(found, [first])]

    def counts(self, views: tuple[Logistic, Logistic], rounds: list[Round]) -> np.ndarray | None:
        """The histogram of each view's logits of the rows not handed over yet."""

        def of(parts, place):
            free, _ = _state(rounds, parts, place)
            return np.concatenate([np.bincount(_bins(v.logit(x[free])), minlength=BINS) for v, x in zip(views, parts, strict=True)]).astype(float)

        found = self.total(of)
        return None if found is None else found.reshape(2, BINS)

    def sums(self, views: tuple[Logistic, Logistic], rounds: list[Round]) -> list[np.ndarray]:
        """``Logistic.sums`` of each view over the rows that it was given."""

        def of(parts, place):
            _, labels = _state(rounds, parts, place)
            return np.concatenate([v.sums(x[y != 0], (y[y != 0] > 0).astype(float)).ravel() for v, x, y in zip(views, parts, labels, strict=True)])

        found = self.total(of)
        first = len(views[0].weights) * (len(views[0].weights) + 2)
        return [part.reshape(-1, len(v.weights)) for v, part in zip(views, np.split(found, [first]), strict=True)]


def _in_order(places: Sequence[int], totals: Sequence[np.ndarray]) -> np.ndarray:
    """The sum of arrays in the order of their places, so that rounding is the same every time."""
    return reduce(np.add, [np.asarray(totals[i]) for i in np.argsort(np.asarray(places))])


def _moments(x: np.ndarray) -> np.ndarray:
    """Number, sum and sum of squares of each column."""
    return np.stack((np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)))


@dataclass
class CoTrained:
    """The two views, each calibrated, and the weights of their calibrated logits."""

    views: tuple[Logistic, Logistic]
    calibrations: tuple[Logistic, Logistic]
    combined: Logistic
    words: Words | None = None
    # the model of the second target
    unwanted: CoTrained | None = None

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Columns: probability by text, by metadata, by both."""
        logits = self._calibrated(text, metadata)
        both = self.combined.logit(logits)
        return 1 / (1 + np.exp(-np.column_stack((logits, both))))

    def _calibrated(self, *x: np.ndarray) -> np.ndarray:
        return np.column_stack(
            [c.logit(v.logit(part)[:, None]) for v, c, part in zip(self.views, self.calibrations, x, strict=True)]
        )

    @classmethod
    def fit(cls, x: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Pool, rounds: int, handed: float) -> CoTrained:
        """The labelled rows must come in a random order; every fourth is held out."""
        held = np.arange(len(y)) % 4 == 3
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held = np.zeros(len(y), bool)
        known, label = tuple(part[~held] for part in x), y[~held]
        views = [Logistic.fit(part, label) for part in known]
        past: list[Round] = []
        for _ in range(rounds):
            fixed = tuple(Logistic(v.mean, v.scale, v.weights) for v in views)
            counts = pool.counts(fixed, past)
            if counts is None or not counts.any():
                break
            past.append(Round.choose(fixed, counts, y.mean(), handed))
            for view, part, given in zip(views, known, pool.moments(past), strict=True):
                n, total, squares = _moments(part) + given
                view.mean, view.before = total / n, None
                view.scale = np.maximum(np.sqrt(np.maximum(squares / n - view.mean**2, 0)), 1e-6)
            for _ in range(25):
                given = pool.sums(tuple(views), past)
                if max([v.step(v.sums(part, label) + g) for v, part, g in zip(views, known, given, strict=True)]) < 1e-2:
                    break
        check = held if held.any() else np.ones(len(y), bool)
        calibrations = [Logistic.fit(v.logit(part[check])[:, None], y[check]) for v, part in zip(views, x, strict=True)]
        model = cls(tuple(views), tuple(calibrations), calibrations[0])
        model.combined = Logistic.fit(model._calibrated(*(part[check] for part in x)), y[check])
        return model


def _arrays(batch: pa.RecordBatch | pa.Table, words: Words) -> tuple[np.ndarray, np.ndarray]:
    folds = batch["fold"].to_pylist() if "fold" in batch.schema.names else [None] * len(batch)
    text = [text_features(t) + words.features(t, f) for t, f in zip(each_text(batch["text"]), folds, strict=True)]
    meta = [metadata_features(*r) for r in zip(*(batch[k].to_pylist() for k in ("lang", "source", "n_chars")), strict=True)]
    return np.array(text).reshape(len(text), -1), np.array(meta).reshape(len(meta), -1)


def _features(words) -> Callable[[Batches], Batches]:
    def features(batches: Batches) -> Batches:
        for batch in batches:
            text, meta = _arrays(batch, words.value)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["place"], *(pa.array(list(x), pa.list_(pa.float64())) for x in (text, meta))],
                names=["doc_id", "place", "by_text", "by_metadata"],
            )

    return features


def _columns(docs: DataFrame) -> list:
    return [
        F.col("text").cast("binary").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
    ]


def train(
    docs: DataFrame,
    labels: DataFrame,
    target: str = "quality",
    labelled: int = LABELLED,
    unlabelled: int | None = None,
    rounds: int = ROUNDS,
    handed: float = HANDED,
    unwanted: str | None = None,
) -> CoTrained | None:
    """Fit on at most ``labelled`` rows with a label, taken by a hash of the id, and all others.

    ``unlabelled`` bounds those others too. Of an id's labels the largest counts. Rows
    without an id have no label. None if the labels do not show both classes. ``unwanted``
    names a second label, whose model (none without both classes) is trained beside the first.
    """
    targets = [target] if unwanted is None else [target, unwanted]
    marks = [f"mark_{k}" for k in range(len(targets))]
    order = F.xxhash64(F.lit("quality"), "doc_id")
    key = F.col("doc_id").cast("long").alias("doc_id")
    marked = labels.where(f"doc_id IS NOT NULL AND {target} IS NOT NULL").groupBy(key)
    marked = marked.agg(*(F.max(F.col(t).cast("double")).alias(m) for t, m in zip(targets, marks, strict=True)))
    # the sample has a bound, so that it may be sent to the texts
    known = marked.join(docs.select(key).distinct(), "doc_id", "left_semi").withColumn("order", order)
    chosen = known.orderBy("order", "doc_id").limit(labelled).withColumn("fold", F.pmod("order", F.lit(FOLDS)).cast("int"))
    chosen = checkpointed(chosen.drop("order"))
    place = F.xxhash64(F.lit("place"), "doc_id", "text").bitwiseAND((1 << 52) - 1) / F.lit(float(1 << 52))
    read = docs.select(key, place.alias("place"), *_columns(docs))
    words = Words.count(read.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), len(targets))
    shared = docs.sparkSession.sparkContext.broadcast(words)
    features = read.join(F.broadcast(chosen.select("doc_id", "fold")), "doc_id", "left").mapInArrow(
        _features(shared), "doc_id long, place double, by_text array<double>, by_metadata array<double>"
    )
    # only the features of the texts meet the labels and are read again
    rows = checkpointed(features.join(marked, "doc_id", "left").withColumn("order", order))
    sample = rows.where("mark_0 IS NOT NULL").groupBy("doc_id", "order").agg(
        *(F.max(m).alias(m) for m in marks), F.min(F.struct("by_text", "by_metadata")).alias("f")
    )
    found = sample.orderBy("order", "doc_id").limit(labelled).select("f.*", *marks, "order", "doc_id").toArrow()
    found = found.sort_by([("order", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    # without Python objects: the driver holds the sample as plain matrices
    x = tuple(_matrix(found[c]) for c in ("by_text", "by_metadata"))
    y = [found[m].to_numpy() for m in marks]
    del found
    others = rows.where("mark_0 IS NULL")
    if unlabelled is not None:
        others = others.orderBy("order", "place").limit(unlabelled)
    models = []
    for own in y:
        told = ~np.isnan(own)
        both = len(set(own[told])) == 2
        models.append(CoTrained.fit(tuple(part[told] for part in x), own[told], Pool(others), rounds, handed) if both else None)
    if models[0] is None:
        return None
    models[0].words, models[0].unwanted = words, models[1] if unwanted else None
    return models[0]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _score(model) -> Callable[[Batches], Batches]:
    def score(batches: Batches) -> Batches:
        for batch in batches:
            p, bad = np.empty((0, 3)), pa.nulls(len(batch), pa.float64())
            if len(batch):
                x = _arrays(batch, model.value.words)
                p = model.value.scores(*x)
                if model.value.unwanted is not None:
                    bad = pa.array(model.value.unwanted.scores(*x)[:, 2])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(p[:, k]) for k in range(3)), bad],
                names=["doc_id", "by_text", "by_metadata", "score", "unwanted"],
            )

    return score


def score_documents(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``doc_id, by_text, by_metadata, score, unwanted`` of every row.

    The first three are the probability of good quality, ``unwanted`` that of the second
    target (null where it has no model).

    Null texts and empty ones are scored as such, null metadata has places of its own, and
    rows that repeat an id are scored one by one. Without a model (no labels, or of one
    class) the probabilities are null. Other columns are ignored.
    """
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(nothing.alias(c) for c in ("by_text", "by_metadata", "score", "unwanted")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_columns(docs))
    return rows.mapInArrow(_score(shared), "doc_id long, by_text double, by_metadata double, score double, unwanted double")


def good_documents(docs: DataFrame, model: CoTrained | None, least: float = 0.5, most: float = 0.5) -> DataFrame:
    """The rows, as they are, whose score is at least ``least``; all of them without a model.

    Of a model with a second target, only those stay whose probability of it is below ``most``.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Batches) -> Batches:
        for batch in batches:
            if len(batch):
                own = {n: batch[n] for n in ("lang", "source", "n_chars")}
                table = pa.table({"text": batch["text"].cast(pa.binary()), **own})
                x = _arrays(table, shared.value.words)
                good = shared.value.scores(*x)[:, 2] >= least
                if shared.value.unwanted is not None:
                    good &= shared.value.unwanted.scores(*x)[:, 2] < most
                batch = batch.filter(pa.array(good))
            yield batch

    return docs.mapInArrow(kept, docs.schema)
