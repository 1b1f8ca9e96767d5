"""Merkle manifests and packing against plain Python versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayline.llm.manifest import fold, hex_text, merkle_manifest, proof_text
from stayline.llm.packing import _SLICE, pack_documents, plan, token_ids, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(row, text):
    values = [row[f] for f in FIELDS[:-1]] + [text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes, arity):
    """The top and, for every leaf, its siblings on the left and right of each level."""
    ways, places = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for way, place in zip(ways, places):
            run = place - place % arity
            way.append((hashes[run:place], hashes[place + 1 : run + arity]))
        places = [p // arity for p in places]
        hashes = [digest("".join(hashes[i : i + arity])) for i in range(0, len(hashes), arity)]
    return hashes[0], ways


def manifest_by_hand(rows, arity):
    groups = defaultdict(list)
    for row in rows:
        groups[row["source"]].append((row["doc_id"], row_digest(row, row["text"]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own, tops = {}, []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        top, own[name] = tree([r[1] for r in groups[name]], arity)
        tops.append(top)
    root, upper = tree(tops, arity)
    for name, top, above in zip(names, tops, upper):
        for (doc_id, leaf, row), way in zip(groups[name], own[name]):
            proof = way + above
            folded = row_digest(row, None if row["text"] is None else row["text"].replace("\n", ""))
            for left, right in proof:
                folded = digest("".join(left) + folded + "".join(right))
            flat = "".join(h for step in proof for side in step for h in side)
            yield doc_id, leaf, top, root, digest(flat), folded


def manifest(df, arity):
    changed = F.replace("text", F.lit("\n"), F.lit(""))
    found = merkle_manifest(df, FIELDS, "doc_id", "source", arity, altered=[*FIELDS[:-1], changed])
    steps = F.col("steps")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(steps), 256), fold(F.col("altered_leaf"), steps))


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest_is_that_of_a_plain_version(docs, arity):
    rows = [(i, f"text {i}\nof é" if i % 3 else None, ["hot", "b", None, "", "é"][min(i % 9, 4) if i > 40 else 0]) for i in range(70)]
    rows += [(None, "no id", "hot"), (None, "", "hot"), (7, "the id again", "hot"), (8, "same", "b"), (8, "same", "b")]
    rows += [(99, "alone\n", "lone"), (98, "long " * 50_000, "b")]
    df = docs(*rows).repartition(5)
    assert Counter(map(tuple, manifest(df, arity).collect())) == Counter(manifest_by_hand(df.collect(), arity))


def test_proofs_hold_only_for_the_rows_they_were_made_of(docs):
    df = docs(*[(i, f"line {i}\nend" if i % 2 else f"line {i}", f"s{i % 4}") for i in range(30)])
    changed = F.replace("text", F.lit("\n"), F.lit(""))
    found = merkle_manifest(df, FIELDS, "doc_id", "source", altered=[*FIELDS[:-1], changed])
    right = fold(F.unhex("leaf"), F.col("steps")) == F.col("root")
    wrong = fold(F.col("altered_leaf"), F.col("steps")) == F.col("root")
    for row in found.select("doc_id", right.alias("right"), wrong.alias("wrong")).collect():
        assert row["right"] and row["wrong"] == (row["doc_id"] % 2 == 0)


def test_manifest_of_one_row_and_of_none(docs):
    (row,) = merkle_manifest(docs((5, "x", None)), FIELDS, "doc_id", "source").collect()
    assert row["leaf"] == row["subroot"] == row["root"] and not row["steps"]
    assert merkle_manifest(docs((5, "x")).where("false"), FIELDS, "doc_id", "source").count() == 0


def test_hex_text_is_lower_case(spark):
    assert spark.range(1).select(hex_text(F.lit(b"\xab\x01"))).first()[0] == "ab01"


WORDS = ["a", "B", "é", "  ", " ", "\n", "\t", "\xa0", "\x1c", "\r\n", "!", "'s", " 12", "3", "中文", "<|endoftext|>", "\x85", "　", "\x1f", "½", "́", "\U0001f600"]


def test_ids_are_those_of_tokenizers():
    tokenizer, encoding = Tokenizer.from_file(PATH), vocabulary(PATH)
    draw = random.Random(3)
    texts = ["".join(draw.choices(WORDS, k=draw.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(draw.choices(WORDS, k=_SLICE // 2)), "x" * (_SLICE + 10), "word  next\n" * (_SLICE // 4)]
    for text in texts:
        assert list(token_ids(text, encoding)) == tokenizer.encode(text, add_special_tokens=False).ids


def packed(df, **options):
    """Rows by sequence after checking that no sequence has a gap or an overlap."""
    rows = pack_documents(df, PATH, end_id=2, **options).collect()
    sequences = defaultdict(list)
    for row in rows:
        sequences[row["sequence_id"]].append(row)
    for inside in sequences.values():
        at = 0
        for row in sorted(inside, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
    return rows, sequences


def test_pieces_cover_whole_documents_and_sequences_are_full(docs):
    draw = random.Random(1)
    texts = [" ".join(draw.choices(["the", "cat", "zyx", "12", "\n"], k=int(draw.expovariate(1 / 150)))) for _ in range(400)]
    texts += ["one two three " * 900, None, "", "copy of it"] + ["copy of it"] * 200
    df = docs(*[(i, t) for i, t in enumerate(texts)]).repartition(3)
    rows, sequences = packed(df)
    tokenizer = Tokenizer.from_file(PATH)
    pieces = defaultdict(list)
    for row in rows:
        pieces[row["doc_id"]].append(row)
    total = 0
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert [r["length"] for r in mine[1:]] == [1024] * (len(mine) - 1)
        assert [r["start"] for r in mine] == [sum(m["length"] for m in mine[:k]) for k in range(len(mine))]
        for r in mine:
            own = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in mine) == len(ids)
        total += len(ids)
    assert all(sum(r["length"] for r in s) <= 1024 for s in sequences.values())
    assert len(sequences) <= -(-total // 1024) + 1


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_capacity_holds(docs, by):
    df = docs(*[(i, "w " * (i % 37)) for i in range(300)])
    _, sequences = packed(df, tokens=64, documents=4, cost=1500, weights=(1.0, 0.5, 0.5), by=by)
    for inside in sequences.values():
        lengths = [r["length"] for r in inside]
        assert sum(lengths) <= 64 and len(lengths) <= 4 and sum(n * n for n in lengths) <= 1500


def test_rows_without_id_repeated_rows_and_empty_tables(docs):
    rows, _ = packed(docs((None, "a b"), (None, "a b"), (1, "a b"), (1, "a b"), (1, None)))
    assert Counter(r["doc_id"] for r in rows) == {None: 2, 1: 3}
    assert pack_documents(docs((1, "a")).where("false"), PATH, end_id=2).count() == 0


def one_by_one(lengths, capacities, weights, by):
    """Vector best-fit of single pieces; ties go to the sequence opened first."""
    full = np.array(capacities)
    left = []
    for length in sorted(lengths.elements(), reverse=True):
        item = np.array([length, 1, length * length])
        best, at = np.inf, None
        for i, own in enumerate(left):
            if (own >= item).all():
                score = (((own - item) / full) ** 2 @ weights) if by == "norm" else -((own / full) * (item / full)) @ weights
                if score < best - 1e-12:
                    best, at = score, i
        if at is None:
            left.append(full.copy())
            at = len(left) - 1
        left[at] = left[at] - item
    return Counter(tuple(int(v) for v in own) for own in left)


@pytest.mark.parametrize("capacities", [(64, 64, 4096), (64, 3, 4096), (64, 64, 1500), (64, 5, 2000)])
@pytest.mark.parametrize("by", ["norm", "dot"])
def test_ranges_make_the_choices_of_single_pieces(capacities, by):
    draw = random.Random(sum(capacities))
    for weights in ((1.0, 0.0, 0.0), (1.0, 0.7, 0.3)):
        lengths = Counter(draw.choices(range(1, 38), k=250))
        ranges, used = plan(lengths, capacities, weights, by)
        left = np.array([capacities] * used)
        for length, _, pieces, first, each, _ in ranges:
            for i in range(pieces):
                left[first + i // each] -= (length, 1, length * length)
        assert (left >= 0).all()
        alone = one_by_one(lengths, capacities, np.array(weights), by)
        # equal scores may be resolved differently; the number of sequences is the same
        assert abs(used - sum(alone.values())) <= 1
        assert sum(p for _, _, p, *_ in ranges) == 250
