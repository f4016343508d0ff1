import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import catalog
from loanscope.operators import calibrate as K
from loanscope.operators import forest
from loanscope.operators import metrics as M
from loanscope.operators import scoring as Z
from loanscope.plans import service as A
from loanscope.schemas import APPLICATION_SCHEMA, SCORED_SCHEMA, TARGET

TINY = Z.ModelSizes(logistic_iterations=20, forest_trees=5, forest_depth=4, boosted_rounds=3, boosted_depth=3)


@pytest.fixture(scope="module")
def trained(credits):
    return Z.train_models(credits, sizes=TINY)


def scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "label int, proba double")


def by_hand(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, tp_before = 0.0, 0
    for cut in sorted({p for _, p in pairs}, reverse=True):
        at_least = [y for y, p in pairs if p >= cut]
        tp = sum(at_least)
        ap += (tp - tp_before) / len(pos) * tp / len(at_least)
        tp_before = tp
    return auc, ap


CASES = {
    "distinct": [(i % 3 == 0, (i * 37 % 101) / 101) for i in range(80)],
    "tied": [(i % 4 == 0, (i % 5) / 5) for i in range(60)],
    "all equal": [(i % 2, 0.5) for i in range(10)],
    "perfect": [(i >= 5, i / 10) for i in range(10)],
    "many ranges": [((i * i) % 7 < 3, (i * 7919 % 1009) / 1009) for i in range(900)],
}


@pytest.mark.parametrize("name", CASES)
def test_ranking_metrics(spark, name):
    got = M.ranking_metrics(scored(spark, CASES[name]), "proba").first()
    auc, ap = by_hand([(int(y), p) for y, p in CASES[name]])
    assert got.auc == pytest.approx(auc)
    assert got.avg_precision == pytest.approx(ap)


def test_auc_of_the_complement(spark):
    df = scored(spark, CASES["tied"])
    a = M.ranking_metrics(df, "proba").first().auc
    b = M.ranking_metrics(df, 1 - F.col("proba")).first().auc
    assert a + b == pytest.approx(1)


def test_one_class_only(spark):
    got = M.ranking_metrics(scored(spark, [(0, 0.1), (0, 0.2)]), "proba").first()
    assert got.auc is None and got.avg_precision is None


def test_class_report_without_predicted_positives(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(1, 0)], "label int, prediction int")
    r = {x.classe: x for x in M.class_report(df).collect()}
    assert (r["1"].precision, r["1"].recall, r["1"].f1_score, r["1"].support) == (0.0, 0.0, 0.0, 1)
    assert r["accuracy"].precision == 0.75
    assert M.confusion_counts(df).first().asDict() == {
        "vrais_negatifs": 3, "faux_positifs": 0, "faux_negatifs": 1, "vrais_positifs": 0}


def test_encoding_order_unknown_and_missing(spark, credits):
    base = credits.limit(1)
    named = lambda names: base.drop("ville").crossJoin(
        spark.createDataFrame([(n,) for n in names], "ville string"))
    encoders = Z.fit_encoders(named(["Oyem", "Écully", "Libreville", None]))
    got = {r.ville: r.ville_enc for r in Z.encode(named(["Libreville", "Oyem", "Écully", None, "?"]), encoders).collect()}
    # plain order, accents last; a missing name is a label of its own
    assert got == {"Libreville": 0, "Oyem": 1, None: 2, "Écully": 3, "?": -1}


def test_split_is_exact_and_repeatable(credits):
    split = Z.with_split(credits)
    got = {(r.is_test, r.defaut): r["count"] for r in split.groupBy("is_test", "defaut").count().collect()}
    n = sum(got.values())
    assert got[(True, 0)] + got[(True, 1)] == math.ceil(n / 4)
    for c in (0, 1):
        whole = got[(True, c)] + got[(False, c)]
        assert abs(got[(True, c)] - whole / 4) <= 1
    again = Z.with_split(credits.repartition(5))
    assert again.filter("is_test").exceptAll(split.filter("is_test")).count() == 0
    other = Z.with_split(credits, seed=7)
    assert other.filter("is_test").exceptAll(split.filter("is_test")).count() > 0


def test_split_sizes_by_largest_remainder():
    assert Z.stratified_sizes({0: 10, 1: 3}, 0.25) == {0: 3, 1: 1}
    assert Z.stratified_sizes({0: 7, 1: 0}, 0.5) == {0: 4, 1: 0}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "defaut int")
    assert {r.defaut: r.poids for r in Z.class_weights(df).collect()} == {0: pytest.approx(2 / 3), 1: 2.0}


def test_models_learn_and_the_best_is_chosen(trained):
    m = {r.modele: r for r in trained.metrics.collect()}
    assert set(m) == set(Z.MODEL_NAMES)
    assert all(r.auc > 0.6 for r in m.values())
    assert trained.best_name == max(m, key=lambda k: m[k].auc)
    for r in m.values():
        assert 0 <= r.precision <= 1 and 0 <= r.recall <= 1


def test_confusion_facts_meet_the_metrics_in_one_join(spark, sf_dir, credits, monkeypatch):
    small = {name: Z.train_models(credits, (name,), TINY) for name in Z.MODEL_NAMES}
    monkeypatch.setattr(catalog, "_trained", lambda spark, sf_dir, name: small[name])
    facts = catalog.ml_confusion_facts(spark, sf_dir)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and plan.count("HashJoin") == 1
    got = {r.modele: r for r in facts.collect()}
    assert set(got) == set(Z.MODEL_NAMES)
    assert all(r.nb_test > 0 and r.nb_ecarts == 0 and r.nb_classes_fausses == 0 for r in got.values())


@pytest.mark.parametrize("name", Z.MODEL_NAMES)
def test_importance_sums_to_100(trained, credits, name):
    imp = Z.importance(trained.models[name], credits).toPandas()
    assert sorted(imp.feature) == sorted(Z.FEATURES)
    assert imp.importance_pct.sum() == pytest.approx(100, abs=0.2)
    assert list(imp.importance) == sorted(imp.importance, reverse=True)


def test_saved_model_gives_the_same_scores(trained, credits, tmp_path):
    Z.save_model(trained.best, str(tmp_path / "model"))
    again = Z.load_model(str(tmp_path / "model"))
    total = lambda m: Z.predict(credits, m).agg(F.sum("proba")).first()[0]
    assert total(again) == pytest.approx(total(trained.best), rel=1e-12)


def test_unknown_category_is_an_error_only_in_strict_scoring(trained, credits):
    odd = credits.drop(TARGET).limit(3).withColumn("ville", F.lit("nulle part"))
    assert Z.predict(odd, trained.best).count() == 3
    with pytest.raises(Exception, match="(?i)unseen|invalid"):
        Z.score_strict(odd, trained.best).collect()


def test_profiles_keep_their_order_of_risk(spark, sf_dir):
    got = {r.profil: r.probabilite_defaut for r in catalog.score_strict_three_profiles(spark, sf_dir).collect()}
    assert got["risque"] > got["moyen"] > got["excellent"]


def test_service_contract(spark, trained):
    example = (35, "NATION_1", "BUILDING", "2-HIGH", 48, 600_000, "PROMO", 2_000_000, 36, 11.5, "AF", None, None)
    df = spark.createDataFrame([example], APPLICATION_SCHEMA)
    out = A.score_applications(df, trained.best)
    wanted = {f.name: f.dataType for f in SCORED_SCHEMA.fields}
    assert {f.name: f.dataType for f in out.schema.fields if f.name in wanted} == wanted
    r = out.first()
    assert 0 <= r.score <= 1000 and r.nb_incidents_24m == 0
    info = Z.model_info(trained.models[Z.LOGISTIC], df).toPandas()
    assert len(info) == 10 and info.importance_pct.sum() == 0


def test_one_client(spark, trained, credits):
    known = credits.first().asDict()
    one = Z.score_client(spark, known, trained.best)
    same = Z.score_strict(credits, trained.best).filter(
        (F.col("montant_credit_fcfa") == known["montant_credit_fcfa"])
        & (F.col("revenu_mensuel_fcfa") == known["revenu_mensuel_fcfa"]) & (F.col("age") == known["age"])).first()
    assert one["score"] == same.score and one["decision"] == same.decision
    with pytest.raises(Exception, match="(?i)unseen|invalid"):
        Z.score_client(spark, {**known, "garantie": "?"}, trained.best)


def test_batch_result(spark, trained, raw):
    batch = A.score_batch(raw.select([f.name for f in APPLICATION_SCHEMA.fields]), trained.best)
    n = batch.total.first().total
    assert n == batch.resultats.count() > 0
    assert A.batch_summary(batch.resultats).agg(F.sum("total")).first()[0] == n


def test_batch_query_gives_every_result_and_the_total(spark, trained, monkeypatch):
    """Not a summary alone: every valid application with all fields, and the total of the batch."""
    names = ["client_id", *[f.name for f in APPLICATION_SCHEMA.fields]]
    loan = (35, "NATION_1", "BUILDING", "2-HIGH", 48, 600_000, "PROMO", 2_000_000, 36, 11.5, "AF", None, None)
    rows = [(f"c{i}", 20 + i, *loan[1:5], 400_000 + 90_000 * i, *loan[6:]) for i in range(30)]
    rows += [rows[0], (None, *loan), ("too young", 17, *loan[1:])]
    fields = ["client_id string", *[f"{f.name} {f.dataType.simpleString()}" for f in APPLICATION_SCHEMA.fields]]
    df = spark.createDataFrame(rows, ", ".join(fields)).select(*names)
    monkeypatch.setattr(catalog, "applications", lambda spark, sf_dir: df)
    monkeypatch.setattr(catalog, "model", lambda spark, sf_dir: trained.best)
    got = catalog.registered()["serve_score_batch"](spark, "nowhere").collect()
    want = A.score_applications(df, trained.best).collect()
    key = lambda r: tuple(str(r[c]) for c in ("client_id", *A.RESULT_FIELDS))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 32
    assert {r.total for r in got} == {32} and all(r.recommandation for r in got)
    for r in got:
        same = [x.probabilite_defaut for x in want if (x.categorie, x.decision) == (r.categorie, r.decision)]
        assert r.total_categorie == len(same) and r.probabilite_moyenne == pytest.approx(sum(same) / len(same), abs=0.01)


def test_zones_partition_the_portfolio(credits):
    h = K.score_histogram(credits.withColumn("score", F.floor(F.rand(1) * 1001).cast("int")))
    z = K.zones(h).toPandas()
    assert z.nb.sum() == credits.count()
    assert z.part_defauts_pct.sum() == pytest.approx(100, abs=0.05)
    assert K.bands(h).toPandas().nb.sum() == credits.count()


def test_training_rows_are_dealt_evenly(spark, credits, monkeypatch):
    """Every slot takes the same share of the rows, however few files they come from."""
    assert [Z.training_parts(n, 12) for n in (0, 100_000, 354_801, 2_128_806, 12_000_000, 12_000_001, 21_288_060)] == [
        1, 5, 12, 12, 12, 24, 24]
    shares, write = [], Z.staged

    def recorded(df, name, *more):
        out = write(df, name, *more)
        if name == "training":
            shares.append([r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()])
        return out

    monkeypatch.setattr(Z, "staged", recorded)
    train = credits.coalesce(1)
    encoders = Z.fit_encoders(train)
    Z.fit_model(train, Z.BOOSTED, encoders, TINY)
    assert len(shares.pop()) == 1  # a small table stays as it is
    monkeypatch.setattr(Z, "DEALT_FROM", 1)
    monkeypatch.setattr(Z, "LEAST_ROWS", 100)
    Z.fit_model(train, Z.BOOSTED, encoders, TINY)
    slots, rows = spark.sparkContext.defaultParallelism, train.filter(F.col(TARGET).isNotNull()).count()
    assert len(shares[0]) == slots and sum(shares[0]) == rows and max(shares[0]) - min(shares[0]) <= slots


def test_forest_votes_are_those_of_spark(spark, trained, credits, monkeypatch):
    """Blocks of rows go through one tree after the other, once, and give the probabilities of the model's own stage to the last bit."""
    model = trained.models[Z.FOREST]
    monkeypatch.setattr(forest, "BLOCK_ROWS", 7)
    out = Z.predict(credits, model)
    plan = out.filter("proba > 0.2 AND prediction = 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "probability" not in plan
    own = model.transform(credits).select(vector_to_array("probability")[1].alias("p"), F.col("prediction").cast("int").alias("c"))
    assert sorted((r.proba, r.prediction) for r in out.select("proba", "prediction").collect()) == sorted((r.p, r.c) for r in own.collect())
    assert out.schema["proba"].dataType == T.DoubleType() and out.schema["prediction"].dataType == T.IntegerType()
    assert Z.predict(credits.limit(0), model).count() == 0


def test_votes_of_odd_rows_and_trees(spark):
    """Trees of one leaf, thresholds that are met, missing and infinite numbers."""
    rows = [((i * 37) % 11 - 5.0, (i * 13) % 7 * 1.0, float(i % 11 > 6)) for i in range(60)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, y double"))
    odd = [(v, w) for v in (-5.0, -0.5, 0.0, 2.5, 5.0, math.inf, -math.inf, math.nan) for w in (0.0, 3.0, 3.5, 6.0, math.nan)]
    asked = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(spark.createDataFrame(odd, "a double, b double"))
    for depth in (0, 1, 4):
        model = RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=depth, seed=3).fit(df)
        x = np.array([r.features.toArray() for r in asked.select("features").collect()])
        votes = forest.votes(forest.flat_forest(spark, model), x)
        raw = [r.rawPrediction.toArray() for r in model.transform(asked).select("rawPrediction").collect()]
        assert np.array_equal(np.stack(votes, axis=1), np.array(raw))
    cut = RandomForestClassifier(labelCol="y", numTrees=3).setThresholds([0.9, 0.1]).fit(df)
    assert forest.flat_forest(spark, cut) is None  # classes by cuts are left to the model


def test_forest_is_trained_in_groups(spark, credits, monkeypatch, tmp_path):
    """What training stores for a row does not grow with the forest, and the groups make one forest."""
    assert Z.tree_groups(200, 99_999) == [200]
    assert Z.tree_groups(200, 354_801) == [200]
    assert Z.tree_groups(200, 2_128_806) == [67, 67, 66]
    assert Z.tree_groups(200, 21_288_060) == Z.tree_groups(200, 130_000_000) == [10] * 20
    assert Z.tree_groups(5, 130_000_000) == [5]
    fitted, stages, join = [], Z._classifier_stages, Z.joined_forest

    def recorded(name, n, sizes):
        out = stages(name, n, sizes)
        assert out[0].getCheckpointInterval() == -1  # node numbers of all rows and trees are not written again
        return out

    def kept(spark, groups):
        fitted.append(list(groups))
        return join(spark, groups)

    monkeypatch.setattr(Z, "_classifier_stages", recorded)
    monkeypatch.setattr(Z, "joined_forest", kept)
    monkeypatch.setattr(Z, "DEALT_FROM", 1)
    monkeypatch.setattr(Z, "GROUP_COUNTS", 1)
    monkeypatch.setattr(Z, "LEAST_TREES", 2)
    encoders = Z.fit_encoders(credits)
    model = Z.fit_model(credits, Z.FOREST, encoders, TINY)
    groups, whole = fitted[0], model.stages[-1]
    assert [g.getNumTrees for g in groups] == [2, 2, 1]
    assert whole.getNumTrees == 5 and len({t.toDebugString for t in whole.trees}) == 5
    mean = sum(g.featureImportances.toArray() * g.getNumTrees for g in groups) / 5
    assert whole.featureImportances.toArray() == pytest.approx(mean, abs=0.2) and sum(whole.featureImportances.toArray()) == pytest.approx(1)
    some = credits.limit(200).cache()
    votes = lambda m: [r.proba for r in Z.predict(some, m).select("proba").collect()]
    of_groups = [votes(Z.PipelineModel([*model.stages[:-1], g])) for g in groups]
    assert votes(model) == pytest.approx([(2 * a + 2 * b + c) / 5 for a, b, c in zip(*of_groups)])
    Z.save_model(model, str(tmp_path / "model"))
    again = Z.load_model(str(tmp_path / "model"))
    assert again.stages[-1].getNumTrees == 5 and votes(again) == pytest.approx(votes(model))
    assert Z.model_info(model, credits).first().type_modele == "RandomForestClassificationModel"
