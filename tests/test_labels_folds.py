"""Label tables of any size, exact shares with ties, folds, the optimum of the logistic model, wide tables without a pivot."""

import pytest
from pyspark.sql import functions as F

from loanscope.operators import calibrate as K
from loanscope.operators import labels as N
from loanscope.operators import scoring as Z
from loanscope.operators import segments as S
from loanscope.schemas import TARGET


def test_a_million_labels(spark):
    """Codes follow the text order; a third of the rows hold one label."""
    n = 1_000_000
    df = spark.range(n * 3 // 2).select(F.when(F.col("id") % 3 == 0, F.lit("label 0")).otherwise(
        F.concat(F.lit("label "), (F.col("id") - F.floor(F.col("id") / 3) - 1).cast("string"))).alias("v"))
    table = N.label_table(df, "v")
    one = table.agg(F.count("*"), F.countDistinct("label"), F.min("code"), F.max("code"), F.countDistinct("code")).first()
    assert tuple(one) == (n, n, 0, n - 1, n)
    some = {r.label: r.code for r in table.filter(F.col("label").isin("label 0", "label 1", "label 10", "label 999999")).collect()}
    order = sorted(f"label {i}" for i in range(n))
    assert some == {v: order.index(v) for v in some} and len(some) == 4
    coded = N.encode_labels(df.union(spark.createDataFrame([("none",)], "v string")), {"v": table})
    assert coded.filter("v = 'label 0'").select("v_enc").distinct().collect()[0].v_enc == some["label 0"]
    assert coded.filter("v_enc = -1").count() == 1


def test_label_edges(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("B", 4), ("é", 5), ("b", 6)], "v string, _code_v int")
    table = N.label_table(df, "v")
    assert {r.label: r.code for r in table.collect()} == {"B": 0, "a": 1, "b": 2, "nan": 3, "é": 4}
    assert N.label_table(df.limit(0), "v").count() == 0
    plain = df.select("v")
    assert sorted((r.v or "", r.v_enc) for r in N.encode_labels(plain, {"v": N.label_table(plain.limit(0), "v")}).collect())[0][1] == -1


def test_encoders_agree_with_label_tables(credits):
    tables = N.label_tables(credits, Z.CATEGORICAL)
    codes = [f"{c}_enc" for c in Z.CATEGORICAL]
    a = N.encode_labels(credits, tables).select(*Z.CATEGORICAL, *codes)
    b = Z.encode(credits, Z.fit_encoders(credits)).select(*Z.CATEGORICAL, *codes)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


@pytest.mark.parametrize("share", [0.25, 0.1, 0.6])
def test_shares_hold_with_ties(spark, credits, share):
    """A third of all rows are one loan, and every loan is there twice."""
    part = credits.limit(300)
    hot = credits.filter(f"{TARGET} = 0").limit(1)
    many = hot.crossJoin(spark.range(300).drop()).select(*credits.columns)
    df = part.union(part).union(many).union(credits.limit(1).withColumn(TARGET, F.lit(None).cast("int")))
    counts = {r[TARGET]: r["count"] for r in df.filter(F.col(TARGET).isNotNull()).groupBy(TARGET).count().collect()}
    split = Z.with_split(df, share)
    assert split.columns == [*df.columns, "is_test"] and split.count() == df.count()
    got = {r[TARGET]: r["count"] for r in split.filter("is_test").groupBy(TARGET).count().collect()}
    assert got == Z.stratified_sizes(counts, share)
    assert split.filter("is_test IS NULL").count() == 1
    assert split.drop("is_test").exceptAll(df).count() == 0


def test_no_loan_is_scored_by_a_model_that_has_seen_it(credits, monkeypatch):
    seen = []
    fit = Z.fit_model

    def recording(train, name, encoders, sizes):
        seen.append(train)
        return fit(train, name, encoders, sizes)

    monkeypatch.setattr(Z, "fit_model", recording)
    models = Z.fit_folds(credits, Z.LOGISTIC, folds=3)
    scored = K.score_out_of_fold(credits, models)
    assert scored.count() == credits.count() and scored.select(credits.columns).exceptAll(credits).count() == 0
    folded = credits.withColumn("fold", Z.fold_of(3))
    for i, train in enumerate(seen):
        outside = folded.filter(F.col("fold") != i).drop("fold")
        assert train.count() == outside.count()
        assert train.select(Z.IDENTITY).intersect(folded.filter(F.col("fold") == i).select(Z.IDENTITY)).join(
            outside.select(Z.IDENTITY), Z.IDENTITY, "left_anti").count() == 0
    zones = K.compared_zones(K.score_histogram(scored), K.score_histogram(scored)).collect()
    assert [r.zone for r in zones] == [z for z in K.ZONES if z in {r.zone for r in zones}]
    assert sum(r.nb_hors_pli for r in zones) == credits.count()


def test_folds_are_hashed_encoded_and_written_once(spark, credits, monkeypatch):
    """One table serves all models and the scoring; they are the models that the loans alone give, and a loan without label is only scored."""
    names, write = [], Z.staged

    def recorded(df, name, *more, **by):
        names.append(name)
        return write(df, name, *more, **by)

    monkeypatch.setattr(Z, "staged", recorded)
    loans = credits.withColumn(TARGET, F.when(F.col("montant_credit_fcfa") % 10 != 0, F.col(TARGET)))
    assert 0 < loans.filter(F.col(TARGET).isNull()).count() < loans.count()
    folded = Z.fold_loans(loans, 3)
    models = Z.fit_folds(folded, Z.LOGISTIC)
    scored = K.score_out_of_fold(folded, models)
    assert names == ["folds"] and len(models) == 3
    assert scored.count() == loans.count() and scored.filter("proba_defaut IS NULL").count() == 0
    assert scored.select(loans.columns).exceptAll(loans).count() == 0
    assert scored.columns == K.score_out_of_fold(loans, models).columns
    alone = Z.fit_model(folded.rows.filter("fold <> 1").select(loans.columns), Z.LOGISTIC, folded.encoders)
    assert models[1].stages[-1].coefficients.toArray() == pytest.approx(alone.stages[-1].coefficients.toArray(), rel=1e-4, abs=1e-6)


def test_scores_of_a_histogram_are_worked_out_once(spark, credits):
    model = Z.fit_model(credits, Z.LOGISTIC, Z.fit_encoders(credits), Z.ModelSizes(logistic_iterations=2))
    scored = K.score_portfolio(credits, model)
    plan = K.score_histogram(scored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bround") == 1
    odd = spark.createDataFrame([(5, 1), (5, None), (7, 0), (None, 1), (None, None)], f"score int, {TARGET} int")
    assert sorted(map(tuple, K.score_histogram(odd).collect())) == [(5, 2, 1, 1), (7, 1, 1, 0)]
    assert K.score_histogram(odd).columns == ["score", "n", "n_cible", "nb_defauts"]


def test_the_logistic_model_stands_at_its_optimum(credits):
    model = Z.fit_model(credits, Z.LOGISTIC, Z.fit_encoders(credits))
    row = Z.logistic_gradient(credits, model).first()
    assert row.nb_train == credits.count() and row.plus_grande_derivee < 1e-4
    hasty = Z.fit_model(credits, Z.LOGISTIC, Z.fit_encoders(credits), Z.ModelSizes(logistic_iterations=1))
    assert Z.logistic_gradient(credits, hasty).first().plus_grande_derivee > 1e-3


def test_sparse_crosstab_has_no_pivot_limit(spark, credits):
    n = 12_000  # above spark.sql.pivotMaxValues
    assert n > int(spark.conf.get("spark.sql.pivotMaxValues"))
    df = spark.range(2 * n).crossJoin(credits.limit(1)).withColumns({
        "a": (F.col("id") % 2).cast("string"), "b": F.floor(F.col("id") / 2).cast("string"), TARGET: (F.col("id") % 5 == 0).cast("int")})
    wide = {r.a: r.taux_defaut for r in S.crosstab_sparse(df, "a", "b").collect()}
    assert {a: len(m) for a, m in wide.items()} == {"0": n, "1": n}
    pairs = {(r.a, r.b): r.taux_defaut for r in S.crosstab(df, "a", "b").limit(500).collect()}
    assert all(wide[a][b] == v for (a, b), v in pairs.items())
    assert S.crosstab_sparse(df.limit(0), "a", "b").count() == 0
