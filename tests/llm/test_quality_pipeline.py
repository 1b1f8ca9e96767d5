"""The classifier on held-out labels, and the pipeline's stages one by one."""

import numpy as np
import pytest
import xxhash
from corpus_helpers import DOC, counted
from pyspark.sql import functions as F

import corpus_pipeline
from stayline.llm.quality import WORD_SLOTS, Words, good_documents, metadata_features, score_documents, train

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{MEDIUM}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_held_out_labels_are_met(tables):
    labels = tables["labels"]
    model = train(tables["documents"], labels.where("doc_id % 3 <> 0"))
    scores = {r.doc_id: r for r in score_documents(tables["documents"], model).collect()}
    held = [(r.quality, scores[r.doc_id]) for r in labels.where("doc_id % 3 = 0").collect() if r.doc_id in scores]
    right = np.mean([(s.score >= 0.5) == (q == 1) for q, s in held])
    clean_kept = np.mean([s.score >= 0.5 for q, s in held if q == 1])
    assert len(held) > 80 and right >= 0.97 and clean_kept >= 0.98
    assert len(scores) == tables["documents"].count()
    assert all(0 < s.by_metadata < 1 and 0 < s.by_text < 1 for s in scores.values())


def test_views_teach_each_other(tables):
    """Few labels: rows handed over by the other view change what a view learns."""
    labels = tables["labels"].where("doc_id % 4 = 0")
    alone = train(tables["documents"], labels, rounds=0)
    taught = train(tables["documents"], labels, rounds=3)
    assert not np.allclose(alone.views[1].weights, taught.views[1].weights)


def test_the_fit_is_the_same_for_any_partitioning(tables):
    a = train(tables["documents"], tables["labels"])
    b = train(tables["documents"].repartition(7), tables["labels"].repartition(3))
    assert np.allclose(a.combined.weights, b.combined.weights)


def test_odd_rows_are_scored_and_rows_come_back_whole(spark, tables, docs):
    model = train(tables["documents"], tables["labels"])
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "x" * 300_000), (4, "text", None), (4, "text", None)]
    found = score_documents(docs(*rows), model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    odd = docs(*rows).withColumn("lang", F.lit(None).cast("string")).selectExpr("*", "CAST(NULL AS int) AS by_text")
    kept = good_documents(odd, model, least=0.0)
    assert kept.columns == odd.columns and counted(kept) == counted(odd)
    assert score_documents(docs(), model).collect() == [] == good_documents(docs(), model).collect()


def test_without_two_classes_nothing_is_rejected(tables, docs):
    only = tables["labels"].where("quality = 1")
    assert train(tables["documents"], only) is None
    df = docs((1, "a"), (2, None))
    assert counted(good_documents(df, None)) == counted(df)
    assert {r.score for r in score_documents(df, None).collect()} == {None}


def test_a_bounded_sample_is_enough(tables):
    model = train(tables["documents"], tables["labels"], labelled=150, unlabelled=100)
    truth = {r.doc_id: r.quality for r in tables["labels"].collect()}
    found = [r for r in score_documents(tables["documents"], model).collect() if r.doc_id in truth]
    assert np.mean([(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in found]) >= 0.92


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_stages_one_by_one(spark, tables):
    docs = tables["documents"]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "shards"]

    kept = stages["quality"](spark, docs, MEDIUM).cache()
    truth = {r.doc_id: r.quality for r in tables["labels"].collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert np.mean([i in ids for i, q in truth.items() if q == 1]) > 0.98
    assert np.mean([i in ids for i, q in truth.items() if q == 0]) < 0.1

    rows = {r.doc_id: shingles(r.text) for r in kept.collect()}
    alone = stages["near_duplicates"](spark, kept, MEDIUM).cache()
    assert alone.columns == docs.columns
    component, order = {}, sorted(rows)
    for a in order:  # a component's smallest id is reached first
        if a in component:
            continue
        component[a], todo = a, [a]
        while todo:
            x = todo.pop()
            for y in order:
                if y not in component and rows[x] and rows[y] and 5 * len(rows[x] & rows[y]) >= 4 * len(rows[x] | rows[y]):
                    component[y] = a
                    todo.append(y)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(set(component.values()))

    clean = stages["decontamination"](spark, alone, MEDIUM).cache()
    bench = [r.text.lower().split() for r in tables["benchmark"].collect()]
    grams = {tuple(p[i : i + 13]) for p in bench for i in range(max(1, len(p) - 12))}

    def held(text):
        w = text.lower().split()
        return any(tuple(w[i : i + 13]) in grams for i in range(len(w) - 12))

    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in alone.collect() if not held(r.text)}
    assert clean.count() < alone.count()

    mixed = stages["mixing"](spark, clean, MEDIUM).cache()
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3

    sharded = stages["shards"](spark, mixed, MEDIUM)
    assert counted(sharded.select(docs.columns)) == counted(mixed)
    sums = sharded.groupBy("shard").sum("bytes").collect()
    assert all(r[1] <= corpus_pipeline.SHARD_BYTES for r in sums) and len(sums) > 1


def test_stages_take_odd_rows_and_no_rows(spark):
    rows = [(None, "a b c", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "same text here", "en", "s", 9), (3, "same text here", "en", "s", 9)]
    df = spark.createDataFrame(rows, DOC)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SMALL)
        assert out.count() <= 12 and set(df.columns) <= set(out.columns)
        assert stage(spark, df.limit(0), SMALL).count() == 0


def test_the_whole_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 50 and "shard" in out.columns


def test_all_unlabelled_rows_teach(spark):
    """A source that only the last of many unlabelled rows have, which the text shows to be junk."""
    ids = spark.range(26_000).orderBy(F.xxhash64(F.lit("quality"), "id"))
    ids = [r.id for r in ids.collect()]
    good = "The river ran past the old mill and {} people walked along its banks in the evening sun.\nThey talked for long."
    rows = []
    for place, i in enumerate(ids):
        rare = place >= 24_000
        text = f"|| {i} $$ || {i} $$ || {i} ## ||" if rare or i % 3 == 0 else good.format("many" if i % 2 else "some")
        rows.append((i, text, "en", "rare" if rare else "src0", 100))
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in ids[:400]], "doc_id long, quality int")
    model = train(spark.createDataFrame(rows, DOC), labels, rounds=2, handed=0.3)
    usual, rare = (model.views[1].logit(np.array([metadata_features("en", s, 100)]))[0] for s in ("src0", "rare"))
    assert rare < usual - 1


def test_near_duplicates_judges_each_text_of_an_id_by_itself(spark):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    words = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(words), " ".join([*words[:58], "x", "y"]), " ".join(f"z{i}" for i in range(40))
    rows = [
        (1, one, "en", "a", 10), (2, near, "en", "a", 10), (2, other, "en", "a", 20),
        (3, "alone here", "en", "b", 3), (3, "alone here", "de", "b", 3), (3, "alone here", "de", "b", 2),
        (None, "no id", "en", "c", 1), (None, "no id", "en", "c", 1), (None, one, "en", "c", 1),
        (4, None, "en", "d", None), (4, None, "en", "d", None), (4, "", "en", "d", 0), (5, "", "en", "d", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [tuple(r) for r in stage(spark, df, "").collect()]
    expected = [
        (1, one, "en", "a", 10), (2, other, "en", "a", 20), (3, "alone here", "de", "b", 2), (None, "no id", "en", "c", 1),
        (None, one, "en", "c", 1), (4, None, "en", "d", None), (4, "", "en", "d", 0), (5, "", "en", "d", 0),
    ]
    assert sorted(map(str, kept)) == sorted(map(str, expected))
    assert stage(spark, df.where("false"), "").count() == 0


def test_toxic_documents_of_held_out_labels_are_caught(spark):
    """English ones, of whose abusive words the labelled rows hold dozens each; clean documents stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = train(docs, labels.where("doc_id % 3 <> 0"), unwanted="toxic")
    english = docs.where("lang = 'en'")
    scores = {r.doc_id: r.unwanted for r in score_documents(english, model).collect()}
    held = [(r.toxic, scores[r.doc_id] >= 0.5) for r in labels.where("doc_id % 3 = 0").collect() if r.doc_id in scores]
    assert np.mean([found for toxic, found in held if toxic]) >= 0.85
    assert np.mean([found for toxic, found in held if not toxic]) <= 0.04
    kept = {r.doc_id for r in good_documents(english, model, least=0.0).collect()}
    assert kept == {i for i, p in scores.items() if p < 0.5}


def test_word_odds_by_brute_force(spark):
    """Counts of texts per hashed word, with and without each fold, against a plain count."""
    rows = [("Bad bad word", 0, 0.0, 1.0), ("good word", 1, 1.0, 0.0), ("bad, good", 2, 1.0, None), (None, 3, 0.0, 0.0), ("", 0, 1.0, 1.0)]
    words = Words.count(spark.createDataFrame(rows, "text string, fold int, mark_0 double, mark_1 double").withColumn("text", F.col("text").cast("binary")).repartition(3), 2)
    for target in range(2):
        for left_out in (None, 0, 1, 2, 3):
            own = [(t or "", r[target]) for t, f, *r in rows if f != left_out and r[target] is not None]
            share = sum(m for _, m in own) / len(own)
            for word in ("bad", "good", "word"):
                held = [m for t, m in own if word in t.lower().replace(",", " ").split()]
                if share in (0, 1):  # one class tells nothing
                    assert not words.odds[0 if left_out is None else 1 + left_out, target].any()
                    continue
                odds = np.log((sum(held) + 10 * share) / (len(held) - sum(held) + 10 * (1 - share))) - np.log(share / (1 - share))
                place = xxhash.xxh3_64_intdigest(word.encode()) % WORD_SLOTS
                assert abs(words.odds[0 if left_out is None else 1 + left_out, target, place] - odds) < 1e-5
    assert words.features(None, None) == [0.0] * 6


def test_a_second_target_of_one_class_rejects_nothing(tables):
    model = train(tables["documents"], tables["labels"].withColumn("toxic", F.lit(0)), unwanted="toxic")
    assert model.unwanted is None and {r.unwanted for r in score_documents(tables["documents"], model).collect()} == {None}
