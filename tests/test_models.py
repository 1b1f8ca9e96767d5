import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import evaluate, models, prep, ranking, triangles
from stayline.plans import presets
from tests.conftest import one, rows


def test_hash_rank_is_a_permutation_of_every_group(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "big").otherwise("small"))
    for bits in (2, 12):
        ranked = ranking.hash_rank(df, "g", "id", seed=3, bits=bits)
        got = {g: sorted(r["rank"] for r in ranked.filter(F.col("g") == g).collect())
               for g in ("big", "small")}
        assert got == {"big": list(range(900)), "small": list(range(100))}
        assert rows(ranked.select("g", "group_size").distinct()) == [("big", 900), ("small", 100)]
    again = ranking.hash_rank(df.repartition(7), "g", "id", seed=3)
    assert rows(again) == rows(ranking.hash_rank(df, "g", "id", seed=3))


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_match_a_loop(spark, descending):
    random.seed(1)
    data = [(random.random() ** 4, i % 5) for i in range(500)]
    got = ranking.running_totals(
        spark.createDataFrame(data, "x double, n long"), "x", ["n"], descending
    )
    total, expected = 0, []
    for x, n in sorted(data, reverse=descending):
        total += n
        expected.append((x, n, total))
    ordered = sorted(rows(got, "x", "n", "cum_n"), reverse=descending)
    assert ordered == expected
    assert rows(got.select("all_n").distinct()) == [(total,)]


def test_exact_quantiles_interpolate(spark):
    values = [1.0, 2.0, 2.0, 3.5, 7.0, 11.0, 13.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probabilities = [0, 0.1, 0.25, 0.5, 0.75, 1]
    got = ranking.exact_quantiles(df, "v", probabilities)
    assert got == pytest.approx(list(np.quantile(values, probabilities)))
    assert ranking.exact_quantiles(df.filter("v > 99"), "v", [0.5]) == []


def labelled(spark, n=200, positives=23):
    return spark.range(n).withColumn("label", (F.col("id") < positives).cast("int"))


def test_split_is_exact_disjoint_and_covering(spark):
    df = labelled(spark)
    split = prep.stratified_split(df, "label", "id", seed=9)
    counts = {(r["label"], r["split"]): r["count"] for r in
              split.groupBy("label", "split").count().collect()}
    assert counts == {
        (0, "train"): math.ceil(177 * 0.7),
        (0, "test"): math.ceil((177 - 124) * 0.5),
        (0, "validation"): 177 - 124 - 27,
        (1, "train"): 17,
        (1, "test"): 3,
        (1, "validation"): 3,
    }
    assert rows(split, "id") == rows(df, "id")
    assert rows(split) == rows(prep.stratified_split(df.repartition(5), "label", "id", seed=9))
    train, validation = prep.pick_split(split, validate=True)
    _, test = prep.pick_split(split, validate=False)
    assert (train.count(), test.count(), validation.count()) == (141, 30, 29)


def test_numeric_strata_are_quantile_bins(spark):
    df = spark.range(101).select(F.col("id"), F.col("id").cast("double").alias("y"))
    got = prep.quantile_strata(df, "y").groupBy("stratum").count()
    assert rows(got) == [(0, 26), (1, 25), (2, 25), (3, 25)]


def test_class_balance(spark):
    split = labelled(spark, 10, 4).withColumn(
        "split", F.when(F.col("id") % 2 == 0, "train").otherwise("test")
    )
    assert rows(prep.class_balance(split, "label")) == [
        ("all", 0, 6, 0.6),
        ("all", 1, 4, 0.4),
        ("test", 0, 3, 0.6),
        ("test", 1, 2, 0.4),
        ("train", 0, 3, 0.6),
        ("train", 1, 2, 0.4),
    ]


def test_upsample_equalises_and_spreads_copies(spark):
    grown = prep.upsample(labelled(spark), "label", "id")
    assert rows(grown.groupBy("label").count()) == [(0, 177), (1, 177)]
    copies = [r["count"] for r in grown.filter("label = 1").groupBy("id").count().collect()]
    assert len(copies) == 23 and set(copies) == {177 // 23, 177 // 23 + 1}
    assert grown.columns == ["id", "label"]
    lone = prep.upsample(labelled(spark, 5000, 1), "label", "id")
    assert rows(lone.groupBy("label").count()) == [(0, 4999), (1, 4999)]


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = 1.5 + 2.0 * x[:, 0] - 0.7 * x[:, 1] + rng.normal(scale=0.5, size=400)
    z = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 1.2 * x[:, 0])))).astype(int)
    data = [(*map(float, r), float(r[0] + 2 * r[1]), float(v), int(w)) for r, v, w in zip(x, y, z)]
    frame = spark.createDataFrame(data, "a double, b double, c double, dep double, y double, z int")
    return frame.repartition(3).cache(), x, y, z


def test_gram_equals_the_product_of_the_centred_columns(regression):
    df, x, *_ = regression
    full = np.column_stack([np.ones(len(x)), x - x.mean(axis=0)])
    assert np.allclose(prep.gram(df, ["a", "b", "c"]), full.T @ full)
    w = np.exp(x[:, 2])
    assert np.allclose(prep.gram(df, ["a", "b", "c"], F.exp("c")), full.T @ (full * w[:, None]))


def test_aliased_finds_later_dependent_columns(regression):
    df, *_ = regression
    wide = df.withColumn("const", F.lit(3.0)).withColumn("zero", F.lit(0.0))
    names = ["a", "b", "dep", "const", "c", "zero"]
    assert prep.aliased(prep.gram(wide, names), names) == ["dep", "const", "zero"]


def test_columns_far_from_zero_are_no_copies(spark):
    random = np.random.default_rng(2)
    data = [(1e5 + float(v), float(w), 1e5 + float(v)) for v, w in random.standard_normal((300, 2))]
    df = spark.createDataFrame(data, "far double, near double, copy double")
    names = ["far", "near", "copy"]
    cross = prep.gram(df, names)
    assert prep.aliased(cross, names) == ["copy"]
    corr = np.corrcoef(np.array(data)[:, :2].T)
    factors = prep.variance_inflation(prep.gram(df, names[:2]))
    assert np.allclose(factors, np.diag(np.linalg.inv(corr)), rtol=1e-6)


def test_linear_steps_agree_with_stepwise_fits(spark):
    random = np.random.default_rng(8)
    x = random.standard_normal((150, 6)) + [0, 50, 0, 0, -3, 1000]
    y = 2 * x[:, 0] + 0.3 * x[:, 1] + random.standard_normal(150)
    names = list("abcdef")
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{n} double" for n in [*names, "y"]))
    left, dropped = models.linear_steps(triangles.column_triangle(df, [*names, "y"]), names, [], 0.05)
    expected, gone = list(names), []
    while True:
        p_values = models.fit(df, expected, "y", "gaussian").p_values
        worst = max(expected, key=lambda n: p_values[n])
        if p_values[worst] <= 0.05:
            break
        gone.append((worst, p_values[worst]))
        expected.remove(worst)
    assert left == expected
    assert [n for n, _ in dropped] == [n for n, _ in gone]
    assert [p for _, p in dropped] == pytest.approx([p for _, p in gone], abs=1e-6)


def test_rows_without_a_group_stay(spark):
    df = spark.range(100).withColumn("label", F.when(F.col("id") >= 20, (F.col("id") < 40).cast("int")))
    split = prep.stratified_split(df, "label", "id")
    assert split.count() == 100
    assert split.filter("label IS NULL").groupBy("split").count().count() == 3
    grown = prep.upsample(df, "label", "id")
    assert {r["label"]: r["count"] for r in grown.groupBy("label").count().collect()} == {None: 60, 0: 60, 1: 60}


def test_copies_of_one_row_fill_many_tasks(spark):
    df = spark.range(20_001).withColumn("label", (F.col("id") == 0).cast("int"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        grown = prep.upsample(df, "label", "id").filter("label = 1").withColumn("part", F.spark_partition_id())
        parts = {r["part"]: r["count"] for r in grown.groupBy("part").count().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(parts.values()) == 20_000 and len(parts) == 4


def test_scores_that_are_no_numbers_are_counted_apart(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0.9, 1), (None, 1), (nan, 0), (inf, 1), (-inf, 0), (0.1, 0), (0.5, 1)]
    sweep = evaluate.cutoff_sweep(spark.createDataFrame(data, "score double, label int"), "score", "label")
    got = {r["cutoff"]: r for r in sweep.collect()}
    assert sorted(got) == [-inf, 0.1, 0.5, 0.9, inf]
    assert {r["unscored"] for r in got.values()} == {2}
    assert got[-inf]["recall"] == 1.0 and got[inf]["tp"] == 1
    assert one(evaluate.auc(sweep))["auc"] == 1.0


def test_auc_of_more_pairs_than_a_long_holds(spark):
    sweep = spark.createDataFrame(
        [(0.5, 4 * 10**9, 4 * 10**9, 4 * 10**9, 4 * 10**9)], "cutoff double, tp long, fp long, pos long, neg long"
    )
    assert one(evaluate.auc(sweep))["auc"] == pytest.approx(0.5)


def test_vif_without_weights_is_the_classic_one(regression):
    df, x, *_ = regression
    mixed = df.withColumn("m", F.col("a") + 0.3 * F.col("b") + 0.2 * F.col("c"))
    factors = prep.variance_inflation(prep.gram(mixed, ["a", "b", "m"]))
    m = x[:, 0] + 0.3 * x[:, 1] + 0.2 * x[:, 2]
    corr = np.corrcoef(np.column_stack([x[:, 0], x[:, 1], m]).T)
    assert np.allclose(factors, np.diag(np.linalg.inv(corr)))


def test_collinearity_report(spark, regression):
    df, *_ = regression
    got = {r["term"]: r for r in models.collinearity(spark, df, ["a", "b", "dep"], "z", "binomial").collect()}
    assert got["dep"]["is_aliased"] and got["dep"]["vif"] is None
    assert 1.0 <= got["a"]["vif"] < 1.3


def test_linear_fit_equals_the_normal_equations(regression):
    df, x, y, _ = regression
    full = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.solve(full.T @ full, full.T @ y)
    result = models.fit(df, ["a", "b", "c"], "y", "gaussian")
    assert result.model.intercept == pytest.approx(beta[0])
    assert list(result.model.coefficients) == pytest.approx(list(beta[1:]))


def test_backward_elimination_keeps_what_matters(spark, regression):
    df, x, y, z = regression
    linear = models.backward(df, ["a", "b", "c", "dep"], "y", "gaussian", 0.05)
    assert linear.features == ["a", "b"]
    assert linear.aliased == ["dep"]
    assert [n for n, _ in linear.dropped] == ["c"]
    assert all(p <= 0.05 for p in linear.p_values.values())
    got = one(evaluate.rmse(models.score(linear, df), "y"))
    full = np.column_stack([np.ones(len(x)), x[:, :2]])
    beta = np.linalg.solve(full.T @ full, full.T @ y)
    assert got["rmse"] == pytest.approx(np.sqrt(np.mean((y - full @ beta) ** 2)))

    logit = models.backward(df, ["a", "b", "c"], "z", "binomial", 0.01)
    assert "a" in logit.features and all(p <= 0.01 for p in logit.p_values.values())
    terms = {r["term"]: r for r in models.coefficients(spark, logit).collect()}
    assert set(terms) == {*logit.features, "(Intercept)"}
    assert terms["a"]["odds_ratio"] == pytest.approx(math.exp(terms["a"]["coefficient"]))
    scored = models.score(logit, df)
    assert scored.filter("prediction < 0 OR prediction > 1").count() == 0


def brute_sweep(pairs):
    out = {}
    for cut in {s for s, _ in pairs}:
        tp = sum(s >= cut and y == 1 for s, y in pairs)
        fp = sum(s >= cut and y == 0 for s, y in pairs)
        fn = sum(s < cut and y == 1 for s, y in pairs)
        tn = sum(s < cut and y == 0 for s, y in pairs)
        out[cut] = (tp, fp, fn, tn, 2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    return out


def test_sweep_best_cutoff_and_auc(spark):
    random.seed(2)
    pairs = [(random.choice([0.1, 0.2, 0.2, 0.5, random.random()]), random.randint(0, 1))
             for _ in range(300)]
    sweep = evaluate.cutoff_sweep(
        spark.createDataFrame(pairs, "score double, label int"), "score", "label"
    )
    expected = brute_sweep(pairs)
    got = {r["cutoff"]: r for r in sweep.collect()}
    assert set(got) == set(expected)
    for cut, (tp, fp, fn, tn, f1) in expected.items():
        row = got[cut]
        assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (tp, fp, fn, tn)
        assert row["f1"] == pytest.approx(f1)
        assert row["accuracy"] == pytest.approx((tp + tn) / 300)
    assert got[min(got)]["recall"] == 1.0 and got[min(got)]["specificity"] == 0.0
    best = one(evaluate.best_cutoff(sweep))
    top = max(v[4] for v in expected.values())
    assert best["f1"] == pytest.approx(top)
    assert best["cutoff"] == max(c for c, v in expected.items() if math.isclose(v[4], top))
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    right = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert one(evaluate.auc(sweep))["auc"] == pytest.approx(right / len(pos) / len(neg))


def test_sweep_with_equal_scores_or_one_class(spark):
    same = spark.createDataFrame([(0.4, 1), (0.4, 0), (0.4, 1)], "score double, label int")
    sweep = evaluate.cutoff_sweep(same, "score", "label")
    assert rows(sweep, "cutoff", "tp", "fp", "fn", "tn") == [(0.4, 2, 1, 0, 0)]
    assert one(evaluate.auc(sweep))["auc"] == 0.5
    lone = evaluate.cutoff_sweep(same.filter("label = 0"), "score", "label")
    assert rows(lone, "f1", "recall") == [(0.0, None)]
    assert one(evaluate.auc(lone))["auc"] is None


def test_clusters(spark):
    df = spark.createDataFrame(
        [(f"t{i}", float(i % 2) * 100 + i / 100, 1.0 * (i % 3)) for i in range(40)],
        "teacher string, a double, b double",
    )
    got = models.clusters(df, ["a"], k=2, seed=1)
    assert got.columns == ["teacher", "a", "b", "cluster"]
    assert got.select((F.col("a") > 50).alias("g"), "cluster").distinct().count() == 2


def model_rows(spark):
    columns = {c: "double" for c in (*presets.PREDICTORS, *presets.OUTCOMES)}
    columns.update(usage_label_initial="string", audience_label="string")
    schema = "teacher string, usage_label_later string, " + ", ".join(
        f"{c} {t}" for c, t in columns.items()
    )
    data = []
    for i in range(60):
        initial = ["Never Used", "Tested Product Only", "Used Product", "Used Product"][i % 4]
        later = ["Never Used", "Tested Product Only", "Used Product"][i % 3]
        values = {c: float((i * 7 + j) % 11) for j, c in enumerate(columns)}
        values.update(
            usage_label_initial=initial,
            audience_label=["None", "Light", "Heavy"][i % 3],
            premiumtrial_later=float(i % 10 == 0),
            used_later=float(i % 2),
        )
        if i == 59:
            values["slide_diversity"] = None
        data.append((f"t{i}", later, *[values[c] for c in columns]))
    return spark.createDataFrame(data, schema)


def test_presets_choose_rows_and_columns(spark):
    table = model_rows(spark)
    excluded = spark.createDataFrame([("t2",), ("nobody",)], "hashed_coach_id string")
    binary = presets.model_rows(table, presets.PRESETS["used_later"], excluded)
    ids = {int(r[0][1:]) for r in rows(binary, "teacher")}
    assert ids == {i for i in range(60) if i % 4 > 1 and i % 10 and i not in (2, 59)}
    count = presets.model_rows(table, presets.PRESETS["presentations_later"], excluded)
    ids = {int(r[0][1:]) for r in rows(count, "teacher")}
    assert ids == {i for i in range(60) if i % 4 and i % 3 != 1 and i % 10 and i not in (2, 59)}
    trial = presets.model_rows(table, presets.PRESETS["premiumtrial_later"], excluded)
    assert "t10" in {r[0] for r in rows(trial, "teacher")}

    frame, names = presets.model_frame(table, presets.PRESETS["used_later"], excluded)
    assert frame.columns[-1] == "label"
    assert "audience_label_Heavy" in names and "audience_label_Light" not in names
    assert not {"share_high", "used_initial", "usage_label_initial", "free_later"} & set(names)
    frame, names = presets.model_frame(table, presets.PRESETS["presentations_later"], excluded)
    assert "usage_label_initial_Never Used" in names and "audience_label_None" not in names
    assert "usage_label_initial_Used Product" not in names
    frame, names = presets.model_frame(table, presets.PRESETS["clusters"], excluded)
    assert "label" not in frame.columns and "free_later" in names
    rows_, numeric = presets.screening_frame(table, excluded)
    assert "audience_label" not in numeric and rows_.columns == ["teacher", *numeric]
    by_later, _ = presets.screening_frame(table, excluded, by_later_usage=True)
    assert by_later.count() != rows_.count()


def test_split_frame_balances_training_rows_only(spark):
    table = model_rows(spark)
    excluded = spark.createDataFrame([], "hashed_coach_id string")
    preset = presets.PRESETS["used_later"]
    frame, _ = presets.model_frame(table, preset, excluded)
    train, held_out = presets.split_frame(frame, preset)
    sizes = [r["count"] for r in train.groupBy("label").count().collect()]
    assert len(set(sizes)) == 1
    ids = {r[0] for r in rows(train, "teacher")}, [r[0] for r in rows(held_out, "teacher")]
    assert not ids[0] & set(ids[1]) and len(set(ids[1])) == len(ids[1])
