"""Operators on word sequences, against brute force."""

import hashlib
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stayline.llm.ngrams import similar_documents
from stayline.llm.substrings import remove_repeated_windows
from stayline.session import SHUFFLE_CLEANUP, checkpoint_folder, checkpointed


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(sequence, seed, edits):
    r, out = random.Random(seed), list(sequence)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def kept_by_force(rows, window):
    first = {}
    for i, text in rows:
        w = (text or "").split()
        key = float("inf") if i is None else i
        for k in range(len(w) - window + 1):
            gram = tuple(w[k : k + window])
            first[gram] = min(first.get(gram, float("inf")), key)
    out = []
    for i, text in rows:
        w = (text or "").split()
        key = float("inf") if i is None else i
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=str)


def removal_rows():
    passage = words(1, 70)
    rows = [(k, " ".join(words(100 + k, 30) + passage + words(200 + k, 20 * k))) for k in range(12)]
    rows += [(20, " ".join(passage)), (21, " ".join(passage[:49])), (22, None), (23, ""), (24, " \t\n "), (None, " ".join(passage))]
    rows += [(30, " ".join(words(5, 300))), (30, " ".join(words(5, 300))), (31, "\n".join(words(5, 300)))]
    return [*rows, (40, " ".join(words(6, 9000))), (2, " ".join(words(6, 200))), (41, "ä ö " * 60)]


@pytest.mark.parametrize("chunk_chars", [2_000, 4_000_000])
def test_removal_is_that_of_brute_force(docs, chunk_chars):
    rows = [(i, None if t is None else t.replace(" ", "·")) for i, t in removal_rows()]
    found = remove_repeated_windows(docs(*rows), 50, chunk_chars).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found), key=str)
    assert got == kept_by_force(rows, 50)
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))


def test_removal_keeps_other_spaces_inside_words(docs):
    (row,) = remove_repeated_windows(docs((1, "a\u00a0b c"))).collect()
    assert (row.n_words, row.kept_text) == (2, "a\u00a0b c")


def test_removal_of_nothing(docs):
    assert remove_repeated_windows(docs()).collect() == []


def similar_by_force(rows, size, percent):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    component = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                    continue
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]) and component[b] < component[a]:
                    component[a], changed = component[b], True
    return sorted(((i, len(s), c) for (i, _), s, c in zip(rows, sets, component, strict=True)), key=str)


def similar_rows():
    rows, n = [], 0
    for group in range(4):
        base = words(group, 120 + 40 * group, 10_000)
        for copy in range(12):
            rows.append((n, " ".join(edited(base, 50 * group + copy, copy // 2))))
            n += 1
    chain = words(77, 100, 10_000)
    for k in range(8):  # each close to the next only
        rows.append((n, " ".join(chain[2 * k : 2 * k + 80])))
        n += 1
    rows += [(n, "one two"), (n + 1, "One Two"), (n + 2, "one two three"), (n + 3, None), (n + 4, ""), (n + 5, "\n")]
    rows += [(None, rows[0][1]), (n + 6, rows[0][1].upper()), (n + 7, "x " * 500), (n + 8, "x x x"), (n + 9, " ".join(words(9, 20_000)))]
    random.Random(3).shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_are_those_of_brute_force(docs, size, percent):
    rows = similar_rows()
    found = similar_documents(docs(*rows), size, percent).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == similar_by_force(rows, size, percent)


def test_repeated_ids_and_no_rows(docs):
    text = " ".join(words(4, 60))
    found = similar_documents(docs((5, text), (5, text), (3, text), (5, "other words here")), 3, 90).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (5, 3), (5, 3), (5, 5)]
    assert similar_documents(docs(), 3, 90).collect() == []


def test_only_what_the_result_reads_outlives_the_join(spark, docs):
    """The checkpoint folder keeps the sizes of the rows and the components of the classes."""
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    found = similar_documents(docs(*similar_rows()), 5, 80)
    assert len({p.name for p in folder.iterdir() if list(p.glob("*.parquet"))} - before) == 2
    assert found.count() == len(similar_rows())


def test_shuffle_files_go_when_a_table_is_written(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [Path(d.getPath()) for d in disk.localDirs()]

    def shuffled():
        return {p.name for d in folders for p in d.rglob("shuffle_*.data")}

    before = shuffled()
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    stored = checkpointed(df)
    for _ in range(50):  # they go in the background
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert stored.count() == df.count() == 100
    assert spark.conf.get(SHUFFLE_CLEANUP, None) in (None, "false")


def test_hash_of_kept_text(spark, docs):
    text = " ".join(words(8, 80))
    found = remove_repeated_windows(docs((1, text), (2, text))).selectExpr("doc_id", "sha2(kept_text, 256) AS h").collect()
    assert {r.doc_id: r.h for r in found} == {
        1: hashlib.sha256(text.encode()).hexdigest(),
        2: hashlib.sha256(b"").hexdigest(),
    }
