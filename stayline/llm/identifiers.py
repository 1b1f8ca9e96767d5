"""Personal data by fixed patterns, and by the contexts these induce.

The fixed patterns find the seeds. The words around a seed are lexical patterns; a pattern
also holds other words with digits, its instances. Words that look like keys start as seeds,
too, but are judged by their patterns as other words are. Patterns are scored by the
instances they hold and instances by their patterns, in rounds over the graph of both; a
word with a high score in patterns with enough different seeds is personal data, too.

All of it is DataFrame functions. Texts are read once: spans and contexts are stored per
row, the graph is summed from them, and what it finds goes back by row number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.session import checkpointed

SPACE = r"\x20\x09-\x0D"
LOCAL = r"A-Za-z0-9._%+-"
# Possessive forms of the plain patterns, matching the same text without recursion or
# repeated tries: a match begins where a run begins or the last match ended.
KINDS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FOUND = "context"
WORD = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"
GAP = rf"[{SPACE}]+"
# letters and digits without a break, as keys and tokens have them
KEY = "^(?=[0-9]*+[A-Za-z_+=-])(?=[^0-9]*+[0-9])[A-Za-z0-9_+=-]{32,}+$"
ROUNDS = 3
LEAST_SEEDS = 3
LEAST_SCORE = 0.8
SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _is_ip(text: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

    return F.forall(F.split(text, r"\."), small)


def _is_card(text: Column) -> Column:
    digits = _digits(text)

    def value(digit: Column, place: Column) -> Column:
        plain = F.ascii(digit) - 48
        return F.when(place % 2 == 0, plain).when(plain > 4, 2 * plain - 9).otherwise(2 * plain)

    values = F.transform(F.split(F.reverse(digits), ""), value)
    total = F.aggregate(values, F.lit(0), lambda x, y: x + y)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def _is_phone(text: Column) -> Column:
    return F.length(_digits(text)).between(9, 15)


VALID = {"ip": _is_ip, "card": _is_card, "phone": _is_phone}
# what a text must hold before its pattern is tried; the others need a digit
SIGN = {"email": "@", "phone": "+"}


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,text:string,first:int,last:int>>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, also inside functions of elements."""
    return F.transform(F.array(value), body)[0]


def _moved(state: Column, piece: Column) -> Column:
    """The place and the word reached behind a piece."""
    return F.struct(
        (state["at"] + piece["before"] + piece["length"]).alias("at"),
        (state["word"] + piece["gaps_before"] + piece["gaps"]).alias("word"),
    )


def _placed(state: Column, piece: Column) -> Column:
    start, first = state["at"] + piece["before"], state["word"] + piece["gaps_before"]
    end, last = start + piece["length"], first + piece["gaps"]
    match = F.struct(
        start.alias("start"), end.alias("end"), piece["text"].alias("text"), first.alias("first"), last.alias("last")
    )
    return F.struct(end.alias("at"), last.alias("word"), F.concat(state["found"], F.array(match)).alias("found"))


def _matches(pattern: str) -> Column:
    """``start, end, text`` of each match in ``text``, and its ``first`` and ``last`` word.

    Words are numbered as the pieces between runs of spaces. Places are running sums over
    the pieces between matches, in blocks of about the root of their number, so that a text
    with many matches does not copy what was found so far again for each.
    """
    def piece(part: Column, hit: Column) -> Column:
        return F.struct(
            F.length(part).alias("before"),
            F.coalesce(F.length(hit), F.lit(0)).alias("length"),
            F.regexp_count(part, F.lit(GAP)).alias("gaps_before"),
            F.coalesce(F.regexp_count(hit, F.lit(GAP)), F.lit(0)).alias("gaps"),
            hit.alias("text"),
        )

    origin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("word"))

    def starts(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, origin, _moved))

        def add(done: Column, total: Column) -> Column:
            last = F.element_at(done, -1)
            place = F.struct((last["at"] + total["at"]).alias("at"), (last["word"] + total["word"]).alias("word"))
            return F.concat(done, F.array(place))

        return F.aggregate(totals, F.array(origin), add, lambda all: F.slice(all, F.lit(1), F.size(all) - 1))

    def in_block(block: Column, start: Column) -> Column:
        state = F.struct(start["at"].alias("at"), start["word"].alias("word"), _none().alias("found"))
        return F.aggregate(block, state, _placed, lambda s: s["found"])

    def located(pieces: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / width).cast("int"))
        blocks = F.transform(numbers, lambda k: F.slice(pieces, k * width + 1, width))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, starts(b), in_block)))

    def of(hits: Column) -> Column:
        pieces = F.zip_with(F.split("text", pattern, -1), hits, piece)
        found = F.filter(_let(pieces, located), lambda m: m["text"].isNotNull())
        return F.when(F.size(hits) > 0, found).otherwise(_none())

    return _let(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), of)


def _seeds(kind: str) -> Column:
    found = _matches(KINDS[kind])
    if kind in VALID:
        found = F.filter(found, lambda m: VALID[kind](m["text"]))
    there = F.contains(F.col("text"), F.lit(SIGN[kind])) if kind in SIGN else F.rlike("text", F.lit("[0-9]"))
    return F.when(there, found).otherwise(_none())


def _patterns(match: Column, words: Column) -> Column:
    """The two words before, and the words on either side, in lower case."""
    def word(place: Column) -> Column:
        return F.lower(F.get(words, place))

    before, last, after = word(match["first"] - 2), word(match["first"] - 1), word(match["last"] + 1)
    two = F.when((before != "") & (last != ""), F.concat(before, F.lit(" "), last, F.lit(" _")))
    round_it = F.when((last != "") & (after != ""), F.concat(last, F.lit(" _ "), after))
    return F.array_compact(F.array(two, round_it))


def _words() -> Column:
    """The words with digits that are no part of a seed, without punctuation at their ends.

    Words and what seeds cover are put in one order; a word is clear unless an entry of the
    same number comes before it.
    """
    def entry(number: Column, m: Column | None = None) -> Column:
        text = m["text"] if m is not None else F.lit(None).cast("string")
        start = m["start"] if m is not None else F.lit(-1)
        return F.struct(number.alias("first"), start.alias("start"), text.alias("text"))

    def clear(entries: Column) -> Column:
        def free(e: Column, k: Column) -> Column:
            before = F.get(entries, k - 1)["first"]
            return e["text"].isNotNull() & (before.isNull() | (before != e["first"]))

        return F.filter(entries, free)

    def bare(e: Column) -> Column:
        headless = F.regexp_replace(e["text"], "^[^A-Za-z0-9]+", "")
        body = F.regexp_replace(headless, "(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
        start = e["start"] + F.length(e["text"]) - F.length(headless)
        return F.struct(
            start.alias("start"),
            (start + F.length(body)).alias("end"),
            body.alias("text"),
            e["first"].alias("first"),
            e["first"].alias("last"),
        )

    taken = [F.flatten(F.transform(kind, lambda m: F.transform(F.sequence(m["first"], m["last"]), lambda n: entry(n)))) for kind in KINDS]
    entries = F.array_sort(F.concat(*taken, F.transform(_matches(WORD), lambda m: entry(m["first"], m))))
    return F.when(F.rlike("text", F.lit("[0-9]")), F.transform(_let(entries, clear), bare)).otherwise(_none())


def _span(kind: str, place: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(
        m["start"].alias("start"), F.lit(place).alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind")
    )


def _instances(words: Column) -> Column:
    """All seeds and other words with digits, with their patterns."""
    def instance(known: bool) -> Callable[[Column], Column]:
        return lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lower(m["text"]).alias("instance"),
            F.lit(known).alias("known"),
            (F.lit(known) | F.rlike(m["text"], F.lit(KEY))).alias("seed"),
            _patterns(m, words).alias("patterns"),
        )

    return F.concat(*[F.transform(kind, instance(True)) for kind in KINDS], F.transform("words", instance(False)))


def _spans(docs: DataFrame) -> DataFrame:
    """Each row with a number of its own, its seeds' spans, and all instances with their patterns."""
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({kind: _seeds(kind) for kind in KINDS})
    named = [F.transform(kind, _span(kind, place)) for place, kind in enumerate(KINDS)]
    rows = rows.withColumn("base", F.array_sort(F.concat(*named).cast(SPAN)))
    rows = rows.withColumn("words", _words()).withColumn("instances", _let(F.split("text", GAP, -1), _instances))
    return checkpointed(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "instances")
    )


def instance_scores(edges: DataFrame, rounds: int, least_seeds: int) -> DataFrame:
    """``instance, known, score, mean`` from ``pattern, instance, known, seed, n``.

    A pattern's score is the mean of its different instances' scores, with one more of score
    0, if it has ``least_seeds`` different seeds; else 0, or none if it has fewer instances
    than that. An instance's is the mean of its scored patterns' by the number of places, 0
    if there are none; a seed's score is 1, whatever its mean.
    """
    start = edges.groupBy("instance").agg(F.max("known").alias("known"), F.max("seed").alias("seed"))
    scores = checkpointed(start.withColumn("score", F.col("seed").cast("double")).withColumn("mean", F.lit(0.0)))
    for _ in range(rounds):
        patterns = (
            edges.join(scores.select("instance", "score"), "instance")
            .groupBy("pattern")
            .agg(
                (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("pattern_score"),
                F.count(F.lit(1)).alias("instances"),
                F.count(F.when(F.col("seed"), 1)).alias("seeds"),
            )
        )
        judged = F.when(F.col("seeds") >= least_seeds, F.col("pattern_score")).when(F.col("instances") >= least_seeds, 0.0)
        patterns = checkpointed(patterns.select("pattern", judged.alias("pattern_score")))
        told = F.when(F.col("pattern_score").isNotNull(), F.col("n"))
        scores = checkpointed(
            edges.join(patterns, "pattern")
            .groupBy("instance")
            .agg(
                F.max("known").alias("known"),
                F.max("seed").alias("seed"),
                F.coalesce(F.sum(F.col("pattern_score") * F.col("n")) / F.sum(told), F.lit(0.0)).alias("mean"),
            )
            .select("instance", "known", F.when(F.col("seed"), 1.0).otherwise(F.col("mean")).alias("score"), "mean")
        )
    return scores


def find_identifiers(
    docs: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE
) -> DataFrame:
    """Every row with its spans of personal data.

    Returns ``doc_id``, ``base`` (spans of the fixed patterns) and ``spans`` (those and the
    discovered ones), arrays of ``start, place, end, kind`` by start, then kind, in code
    points, end exclusive. Discovered spans have the kind ``context`` and do not overlap
    base spans. They are words with a digit, of any length. A context is taken from the whole
    text, whatever stands next to the word or the seed.

    A null text counts as empty; rows that repeat an id, or have none, are searched one by
    one, though equal instances in them count once for a pattern. Other columns are ignored.
    """
    rows = _spans(docs)
    found = rows.select("row", F.explode("instances").alias("i")).select("row", "i.*")
    edges = checkpointed(
        found.select("instance", "known", "seed", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.max("known").alias("known"), F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    )
    scores = instance_scores(edges, rounds, least_seeds)
    sure = checkpointed(scores.where(~F.col("known") & (F.col("mean") >= least_score)).select("instance"))
    more = (
        found.where("NOT known")
        .join(sure, "instance")
        .select("row", F.struct(F.col("start"), F.lit(len(KINDS)).alias("place"), F.col("end"), F.lit(FOUND).alias("kind")).alias("span"))
        .groupBy("row")
        .agg(F.collect_list("span").alias("more"))
    )
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return rows.select("row", "doc_id", "base").join(checkpointed(more), "row", "left").select("doc_id", "base", spans.alias("spans"))


def span_list(spans: str) -> Column:
    """The spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
