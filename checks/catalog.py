"""Registered queries: name -> (spark, sf_dir) -> DataFrame, every one over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import loans as L
from loanscope.functions.rules import (
    class_by_arrears,
    classify_masks,
    classify_sql,
    decision,
    grade,
    provision,
    score_rounded,
    score_truncated,
)
from loanscope.operators import calibrate as K
from loanscope.operators import clean as C
from loanscope.operators import derive as D
from loanscope.operators import labels as N
from loanscope.operators import metrics as M
from loanscope.operators import profile as P
from loanscope.operators import scoring as Z
from loanscope.operators import segments as S
from loanscope.operators import validate as V
from loanscope.plans import dashboard as B
from loanscope.plans import eda as E
from loanscope.plans import reporting as R
from loanscope.plans import service as A
from loanscope.plans import sql_reports as Q
from loanscope.schemas import AGE_BANDS, APPLICATION_SCHEMA, DECISIONS_V1, GRADES_V1, INCOME_BANDS, TARGET
from loanscope.session import shared_root, staged
from loanscope.sources import loans as IO
from loanscope.streaming import alerts as T

Query = Callable[[SparkSession, str], DataFrame]

CUTOFF = 0.35
DASH = B.Filters(secteur="BUILDING", produit=B.ALL, defaut=B.ALL)
DASH_ALL = B.Filters()


def surrogate() -> Column:
    """Deterministic probability for checks that must agree across engines: the composite score without noise."""
    return D.risk_score(F.col("risque_produit"), L.sector_weight("secteur_activite"),
                        F.least(F.col("ratio_endettement"), F.lit(1.5)))


def with_surrogate(credits: DataFrame) -> DataFrame:
    return credits.withColumn("proba", surrogate()).withColumn("label", F.col(TARGET)).withColumn(
        "prediction", (F.col("proba") > CUTOFF).cast("int"))


def model(spark: SparkSession, sf_dir: str) -> PipelineModel:
    """The forest of the comparison, shared by the queries that only need some fitted model."""
    return _trained(spark, sf_dir, Z.FOREST).best


def _on_credits(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(L.credits(spark, sf_dir))


def _on_raw(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(L.loans_raw(spark, sf_dir))


def _on_surrogate(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_credits(lambda c: f(with_surrogate(c)))


def _on_histogram(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_credits(lambda c: f(K.score_histogram(c.withColumn("score", score_rounded(surrogate())))))


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"))


# ---- sources -----------------------------------------------------------------------------------------------

def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = L.loans_raw(spark, sf_dir)
    path = f"{shared_root(spark)}/csv-{uuid.uuid4().hex[:12]}"
    IO.write_csv(raw, path)
    return IO.read_raw(spark, path)


def csv_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as loan CSV in which the texts of some fields are spoiled by rule; rejected lines per reason."""
    path = f"{shared_root(spark)}/csv-{uuid.uuid4().hex[:12]}"
    raw = L.loans_raw(spark, sf_dir)
    spoiled = raw.withColumns({
        "age": F.when(F.col("montant_credit_fcfa") % 13 == 0, F.lit("7.9")).otherwise(F.col("age").cast("string")),
        "duree_mois": F.when(F.col("montant_credit_fcfa") % 17 == 0, F.lit("bad")).otherwise(F.col("duree_mois").cast("string")),
        "nb_credits_en_cours": F.concat(F.col("nb_credits_en_cours").cast("string"), F.lit(".0"))})
    IO.write_csv(spoiled, path)
    return _counted(IO.rejected_csv(spark, path).select(F.array_join("bad_columns", ";").alias("colonnes")), "colonnes")


def load_table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Q.LoanTables(spark)
    tables.publish(L.credits(spark, sf_dir), "credits")
    return tables.query("SELECT count(*) AS n FROM credits")


# ---- derivations -------------------------------------------------------------------------------------------

def _order_number() -> Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def derive_client_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "lineitem").select(D.client_id(_order_number(), "CLI").alias("client_id"))


def derive_grant_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = _order_number()
    return L.table(spark, sf_dir, "lineitem").select(
        position.alias("position"), D.grant_date(position).alias("date_octroi"))


def derive_debt_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.loans_base(spark, sf_dir).select(
        "montant_credit_fcfa", "duree_mois", "revenu_mensuel_fcfa", D.raw_debt_ratio().alias("ratio_endettement"))


def derive_product_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = L.loans_base(spark, sf_dir)
    return _counted(base.withColumn("risque_produit", D.product_risk(L.PRODUCT_WEIGHTS)),
                    "type_produit", "risque_produit")


def derive_sector_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = L.loans_base(spark, sf_dir)
    return _counted(base.withColumn("risque_secteur", D.sector_risk(L.SECTOR_WEIGHTS)),
                    "secteur_activite", "risque_secteur")


def risk_score_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.loans_base(spark, sf_dir).select("client_id", F.bround("score_risque", 9).alias("score_risque"))


def label_by_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.loans_labelled(spark, sf_dir).groupBy("defaut").agg(
        F.count(F.lit(1)).alias("nb"),
        F.bround(F.min("score_risque"), 9).alias("score_min"), F.bround(F.max("score_risque"), 9).alias("score_max"))


def derive_arrears(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = F.lit(30) + (F.col("h") * 17) % 470
    return _counted(L.loans_labelled(spark, sf_dir).withColumn("jours_retard", D.arrears_days(draw)),
                    "defaut", "jours_retard")


def class_by_arrears_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = L.loans_raw(spark, sf_dir)
    return raw.groupBy(class_by_arrears("jours_retard").alias("classe")).agg(
        F.count(F.lit(1)).alias("nb"), F.min("jours_retard").alias("jours_min"), F.max("jours_retard").alias("jours_max"))


def provision_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = L.loans_raw(spark, sf_dir)
    return D.provision_by_class(raw.withColumn(
        "provision_fcfa", provision("montant_credit_fcfa", "classification_cobac")))


# ---- cleaning ----------------------------------------------------------------------------------------------

def _clean_step(f: Callable[[DataFrame, C.Thresholds], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(L.loans_raw(spark, sf_dir), L.cleaned(spark, sf_dir).thresholds)
    return run


def _survivors(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("nb"), F.sum("defaut").cast("bigint").alias("nb_defauts"),
        F.min("age").alias("age_min"), F.max("age").alias("age_max"),
        F.max("revenu_mensuel_fcfa").alias("revenu_max"), F.max("montant_credit_fcfa").alias("montant_max"),
        F.max("ratio_endettement").alias("ratio_max"))


def _band_counts(band: str, value: str) -> Query:
    return _on_credits(lambda c: c.groupBy(band).agg(
        F.count(F.lit(1)).alias("nb"), F.min(value).alias("valeur_min"), F.max(value).alias("valeur_max")))


def clean_impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps punched into two clean columns by a fixed rule, then filled."""
    holed = L.credits(spark, sf_dir).select(
        F.when(F.col("montant_credit_fcfa") % 7 != 0, F.col("duree_mois")).alias("duree_mois"),
        F.when(F.col("montant_credit_fcfa") % 11 != 0, F.col("taux_effort")).alias("taux_effort"),
        "garantie")
    return _counted(C.impute_median(holed).withColumns({
        "duree_mois": F.col("duree_mois").cast("double")}), "duree_mois", "taux_effort", "garantie")


# ---- models ------------------------------------------------------------------------------------------------

def ml_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    credits = L.credits(spark, sf_dir)
    return N.encode_labels(credits, N.label_tables(credits, Z.CATEGORICAL)).select(
        *Z.CATEGORICAL, *Z.FEATURES[len(Z.NUMERIC_FEATURES):], "age", "montant_credit_fcfa")


def ml_encode_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoders fitted without one sector and without missing guarantees, applied to all loans."""
    credits = L.credits(spark, sf_dir)
    known = credits.filter((F.col("secteur_activite") != "FURNITURE") & F.col("garantie").isNotNull())
    return _counted(N.encode_labels(credits, N.label_tables(known, Z.CATEGORICAL)),
                    "secteur_activite", "secteur_activite_enc", "garantie", "garantie_enc")


def ml_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.with_split(L.credits(spark, sf_dir)).groupBy("is_test", "defaut").agg(
        F.count(F.lit(1)).alias("nb"), F.sum("montant_credit_fcfa").alias("encours"))


def _encoders(spark: SparkSession, sf_dir: str) -> PipelineModel:
    return L.once(spark, sf_dir, "encoders", lambda: Z.fit_encoders(L.credits(spark, sf_dir)))


def _parts(spark: SparkSession, sf_dir: str) -> Z.SplitLoans:
    return L.once(spark, sf_dir, "split", lambda: Z.split_loans(L.credits(spark, sf_dir), encoders=_encoders(spark, sf_dir)))


def _trained(spark: SparkSession, sf_dir: str, name: str) -> Z.TrainingResult:
    return L.once(spark, sf_dir, f"trained {name}", lambda: Z.train_models(_parts(spark, sf_dir), (name,)))


def _model_metrics(name: str) -> Query:
    return lambda spark, sf_dir: _trained(spark, sf_dir, name).metrics


def _all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in Z.MODEL_NAMES:
        m = _trained(spark, sf_dir, name).metrics
        out = m if out is None else out.unionByName(m)
    return out


def ml_class_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = [_trained(spark, sf_dir, name).reports for name in Z.MODEL_NAMES]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


def ml_test_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every model's evaluation, whatever it has learned: rows and defaults of the test part from the
    confusion cells and from the class report, and areas between 0 and 1."""
    reports = ml_class_reports(spark, sf_dir).groupBy("modele").agg(
        F.sum(F.when(F.col("classe").isin("0", "1"), F.col("support"))).cast("bigint").alias("nb_rapport"))
    return _all_metrics(spark, sf_dir).join(reports, "modele").select(
        "modele", (F.col("vrais_negatifs") + F.col("faux_positifs") + F.col("faux_negatifs") + F.col("vrais_positifs")).alias("nb_test"),
        (F.col("faux_negatifs") + F.col("vrais_positifs")).alias("nb_defauts"), "nb_rapport",
        (F.col("auc").between(0, 1) & F.col("avg_precision").between(0, 1)).alias("bornes_ok"))


def ml_score_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans scored by the forest per sector, and how many scores do not follow from their probability."""
    scored = K.score_portfolio(L.credits(spark, sf_dir), model(spark, sf_dir))
    wrong = (F.col("score") != score_rounded("proba_defaut")) | ~F.col("proba_defaut").between(0, 1)
    return scored.groupBy("secteur_activite").agg(F.count(F.lit(1)).alias("nb"), F.count_if(wrong).alias("nb_faux"))


def serve_score_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications served, and how many grades or decisions do not follow from their score."""
    served = serve_score(spark, sf_dir)
    wrong = (F.col("categorie") != grade("score")) | (F.col("decision") != decision("score"))
    return served.agg(F.count(F.lit(1)).alias("nb"), F.countDistinct("client_id").alias("nb_clients"),
                      F.count_if(wrong).alias("nb_faux"))


def ml_logreg_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the training part, and whether the logistic model stands at the optimum of its convex loss."""
    trained = _trained(spark, sf_dir, Z.LOGISTIC)
    parts = _parts(spark, sf_dir)
    return Z.logistic_gradient(parts.train, trained.models[Z.LOGISTIC]).select(
        "nb_train", (F.col("plus_grande_derivee") < 1e-4).alias("optimum"))


def ml_confusion_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model: loans of the test part, and how far the confusion counted again from its predictions, and the classes that
    follow from the probabilities, are from what it reported."""
    parts = _parts(spark, sf_dir)
    counted = []
    for name in Z.MODEL_NAMES:
        counted.append(Z.predict(parts.test, _trained(spark, sf_dir, name).models[name]).agg(
            F.count(F.lit(1)).alias("nb_test"),
            *[F.count_if((F.col(TARGET) == label) & (F.col("prediction") == p)).alias(f"c{label}{p}") for label in (0, 1) for p in (0, 1)],
            F.count_if((F.col("proba") > 0.5) != (F.col("prediction") == 1)).alias("nb_classes_fausses")).select(F.lit(name).alias("modele"), "*"))
    told = _all_metrics(spark, sf_dir).select("modele", "vrais_negatifs", "faux_positifs", "faux_negatifs", "vrais_positifs")
    apart = sum(F.abs(F.col(a) - F.col(b)) for a, b in (("c00", "vrais_negatifs"), ("c01", "faux_positifs"),
                                                         ("c10", "faux_negatifs"), ("c11", "vrais_positifs")))
    # one row per model on both sides
    return reduce(DataFrame.unionByName, counted).join(F.broadcast(told), "modele").select(
        "modele", "nb_test", apart.cast("bigint").alias("nb_ecarts"), "nb_classes_fausses")


FOLDS = 4


def _folded(spark: SparkSession, sf_dir: str) -> Z.FoldedLoans:
    return L.once(spark, sf_dir, "folded", lambda: Z.fold_loans(L.credits(spark, sf_dir), FOLDS, _encoders(spark, sf_dir)))


def _folds(spark: SparkSession, sf_dir: str) -> list[PipelineModel]:
    return L.once(spark, sf_dir, "folds", lambda: Z.fit_folds(_folded(spark, sf_dir), Z.LOGISTIC))


def calib_zones_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of the logistic model over the loans it was trained on, next to zones where no model has seen the loan it scores."""
    whole = _trained(spark, sf_dir, Z.LOGISTIC).models[Z.LOGISTIC]
    scored = (K.score_portfolio(L.credits(spark, sf_dir), whole), K.score_out_of_fold(_folded(spark, sf_dir), _folds(spark, sf_dir)))
    # zones read a histogram twice
    return K.compared_zones(*[staged(K.score_histogram(s), "histogram") for s in scored])


def calib_fold_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans scored out of fold per sector: each once, with a score that follows from its probability, equal loans in one fold."""
    scored = K.score_out_of_fold(_folded(spark, sf_dir), _folds(spark, sf_dir))
    wrong = (F.col("score") != score_rounded("proba_defaut")) | ~F.col("fold").between(0, FOLDS - 1)
    return scored.groupBy("secteur_activite").agg(
        F.count(F.lit(1)).alias("nb"), F.sum("montant_credit_fcfa").alias("encours"), F.count_if(wrong).alias("nb_faux"))


def eda_crosstab_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default rates per product and city as text: one entry per city, in hundredths of a percent."""
    maps = S.crosstab_sparse(L.credits(spark, sf_dir), "type_produit", "ville")
    entry = F.transform(F.map_entries("taux_defaut"), lambda e: F.concat(e["key"], F.lit(":"), F.bround(e["value"] * 100, 0).cast("bigint").cast("string")))
    return maps.select("type_produit", F.size("taux_defaut").alias("nb_villes"), F.array_join(entry, ";").alias("taux"))


def ml_importance_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of features, and whether their shares sum to 100 and fall."""
    ranked = ml_importance(spark, sf_dir)
    return ranked.agg(
        F.count(F.lit(1)).alias("nb_features"), (F.abs(F.sum("importance_pct") - 100) < 0.5).alias("somme_ok"),
        (F.min("importance") >= 0).alias("positif"))


def ml_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.importance(_trained(spark, sf_dir, Z.FOREST).best, L.credits(spark, sf_dir))


def score_strict_three_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The riskiest, a middling and the best loan by composite score, scored with the fitted forest."""
    credits = L.credits(spark, sf_dir).drop(TARGET)
    loan = F.struct(*credits.columns)
    p = surrogate()
    picked = credits.agg(
        F.max(F.struct(p, loan.alias("loan"))).alias("risque"),
        F.min(F.struct(F.abs(p - 0.2), loan.alias("loan"))).alias("moyen"),
        F.min(F.struct(p, loan.alias("loan"))).alias("excellent"))
    profiles = picked.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("profil"), F.col(f"{name}.loan").alias("loan"))
        for name in ("risque", "moyen", "excellent")]))).select("profil", "loan.*")
    return Z.score_strict(profiles, model(spark, sf_dir)).select(
        "profil", "probabilite_defaut", "score", "categorie", "decision")


def metric_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.ranking_metrics(with_surrogate(L.credits(spark, sf_dir)), "proba")
    return m.select(F.round("auc", 9).alias("auc"))


def metric_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.ranking_metrics(with_surrogate(L.credits(spark, sf_dir)), "proba")
    return m.select(F.round("avg_precision", 9).alias("avg_precision"))


def metric_class_report(df: DataFrame) -> DataFrame:
    r = M.class_report(df)
    return r.select("classe", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score")], "support")


def calib_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.score_portfolio(L.credits(spark, sf_dir), model(spark, sf_dir)).select(
        "secteur_activite", "type_produit", "montant_credit_fcfa", TARGET, "proba_defaut", "score")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.credits(spark, sf_dir).select(surrogate().alias("p"))


def _score_counts(value: Callable[[], Column], name: str) -> Query:
    return lambda spark, sf_dir: _counted(_scores(spark, sf_dir).withColumn(name, value()), name)


def _by_score(make: Callable[[str], Column], name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = _scores(spark, sf_dir).withColumn("score", score_truncated("p")).withColumn(name, make("score"))
        return scored.groupBy(name).agg(
            F.count(F.lit(1)).alias("nb"), F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    return run


def decision_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = A.with_decision(_scores(spark, sf_dir), "p")
    return scored.groupBy("decision", "recommandation").agg(
        F.count(F.lit(1)).alias("nb"), F.min("score").alias("score_min"), F.max("score").alias("score_max"))


# ---- service -----------------------------------------------------------------------------------------------

def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.loans_raw(spark, sf_dir).drop("ratio_endettement", TARGET, "jours_retard", "classification_cobac",
                                           "provision_fcfa", "date_octroi")


def validate_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.quarantine(applications(spark, sf_dir)).select(
        "client_id", "age", F.array_join("violations", ";").alias("violations"))


def serve_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.score_applications(applications(spark, sf_dir), model(spark, sf_dir)).select(
        "client_id", "probabilite_defaut", "score", "categorie", "decision", "recommandation")


def serve_score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applications as one batch: every result with all its fields, the total of the batch, and total and mean probability of its grade and decision."""
    batch = A.score_batch(applications(spark, sf_dir), model(spark, sf_dir))
    summary = A.batch_summary(batch.resultats).withColumnRenamed("total", "total_categorie")
    # one row, and one row per grade and decision
    return batch.resultats.crossJoin(F.broadcast(batch.total)).join(F.broadcast(summary), ["categorie", "decision"], "left").select(
        "client_id", *A.RESULT_FIELDS, "total", "total_categorie", "probabilite_moyenne")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lot, payload: the loans of 25 consecutive orders as one document, in a fixed order.

    Some documents are cut off, some have no list, some are longer than accepted, and some keep the applications that break a rule.
    """
    loans = V.with_violations(L.loans_labelled(spark, sf_dir)).withColumn(
        "lot", F.floor(F.substring("client_id", 4, 20).cast("bigint") / 200)).filter(
        (F.size("violations") == 0) | (F.col("lot") % 13 == 3))
    client = F.struct(*[f.name for f in APPLICATION_SCHEMA.fields])
    order = F.struct("client_id", "montant_credit_fcfa", "duree_mois", "h")
    clients = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("order"), client.alias("client")))), lambda c: c["client"])
    document = F.to_json(F.struct("clients"))
    return loans.groupBy("lot").agg(clients.alias("clients")).select(
        "lot", F.when(F.col("lot") % 50 == 7, F.substring(document, 1, 40)).when(F.col("lot") % 41 == 5, "{}").otherwise(document).alias("payload"))


def serve_batch_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with many applications each: total, or why the document is refused, and instalments in the order of the list."""
    read = staged(A.read_payloads(payloads(spark, sf_dir)).select("lot", "clients", "erreur"), "payloads")
    rows = A.payload_clients(read, "lot").withColumn(
        "mensualite", F.floor(F.col("montant_credit_fcfa").cast("double") / F.col("duree_mois")).cast("bigint"))
    out = A.payload_results(rows, read, "lot", ["mensualite"])
    return out.select("lot", "total", F.array_join(F.transform("resultats", lambda r: r["mensualite"].cast("string")), ",").alias("mensualites"), "erreur")


def serve_batch_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by the forest: how many are refused, results given, and results whose decision does not follow from their score."""
    out = A.score_payloads(payloads(spark, sf_dir), model(spark, sf_dir), "lot")
    wrong = F.size(F.filter("resultats", lambda r: (r["decision"] != decision(r["score"])) | (r["categorie"] != grade(r["score"]))))
    return out.agg(F.count(F.lit(1)).alias("nb_lots"), F.count("erreur").alias("nb_refuses"), F.sum("total").alias("nb_resultats"),
                   F.sum(F.when(F.col("erreur").isNull(), wrong)).alias("nb_faux"))


# ---- alerts --------------------------------------------------------------------------------------------------

RULE = T.AlertRule()


def segment_events(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Events with the sector of their customer; errors are incidents. Works on a stream alike."""
    sectors = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return events.join(sectors, "user_id").select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"), "segment", (F.col("event_type") == "error").alias("incident"))


def _shown(alerts: DataFrame) -> DataFrame:
    return alerts.select("segment", "window_start", "window_end", "events", "incidents", F.round("rate", 9).alias("rate"),
                         F.round("baseline", 9).alias("baseline"), F.round("errors", 6).alias("errors"), "level")


def stream_segment_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events replayed as a stream: alerts of all windows that the watermark has closed."""
    folder = f"{shared_root(spark)}/alerts-{uuid.uuid4().hex[:12]}"
    table = L.table(spark, sf_dir, "events")
    table.write.parquet(f"{folder}/events")  # a stream reads folders, the table may be one file
    events = spark.readStream.schema(table.schema).parquet(f"{folder}/events")
    sectors = L.table(spark, sf_dir, "customer")
    base = staged(T.baseline(L.credits(spark, sf_dir), "secteur_activite"), "alert-baseline")
    T.start_alerts(segment_events(events, sectors), base, f"{folder}/alerts", f"{folder}/checkpoint", RULE, available_now=True).awaitTermination()
    columns = "segment string, window_start timestamp, window_end timestamp, events long, incidents long, rate double, baseline double, errors double, level string"
    return _shown(spark.read.schema(columns).parquet(f"{folder}/alerts"))


def batch_segment_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all windows over the whole table, open ones too."""
    events = segment_events(L.table(spark, sf_dir, "events"), L.table(spark, sf_dir, "customer"))
    return _shown(T.segment_alerts(T.segment_windows(events, RULE), T.baseline(L.credits(spark, sf_dir), "secteur_activite"), RULE))


def api_kpis(credits: DataFrame) -> DataFrame:
    k = A.portfolio_kpis(credits)
    return k.withColumn("taux_interet_moyen", F.round("taux_interet_moyen", 9)).withColumn(
        "montant_moyen_fcfa", F.round("montant_moyen_fcfa", 4))


def _dash(f: Callable[..., DataFrame], filters: B.Filters = DASH, *args) -> Query:
    return _on_credits(lambda c: f(c, *args, filters=filters))


def _mean9(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.round("mean", 9))


def eda_decile_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = L.cleaned(spark, sf_dir).dated
    return _mean9(S.decile_evolution(dated, F.unix_micros("date_octroi"), Z.loan_hash()))


def sql_export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of the ten reports when all are taken from one pass over the loans: one row per number."""
    parts = []
    for name, df in Q.all_reports(L.credits(spark, sf_dir)).items():
        texts = [c for c, kind in df.dtypes if kind == "string"]
        numbers = [c for c, kind in df.dtypes if kind != "string"]
        line = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in texts]) if texts else F.lit("")
        pairs = [F.struct(F.lit(c).alias("colonne"), F.col(c).cast("double").alias("valeur")) for c in numbers] or [
            F.struct(F.lit("").alias("colonne"), F.lit(None).cast("double").alias("valeur"))]
        parts.append(df.select(F.lit(name).alias("rapport"), line.alias("ligne"), F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, parts)


def registered() -> dict[str, Query]:
    rate = lambda key, order=None: _on_credits(
        lambda c: _mean9(S.segment_default_rate(c, key, order)))
    q: dict[str, Query] = {
        # sources
        "src_csv_roundtrip": csv_roundtrip,
        "src_csv_rejected": csv_rejected,
        "load_table_count": load_table_count,
        "credits_clean": _on_credits(lambda c: c),
        # derivations
        "derive_client_id": derive_client_id,
        "derive_debt_ratio": derive_debt_ratio,
        "derive_product_risk": derive_product_risk,
        "derive_sector_risk": derive_sector_risk,
        "risk_score_composite": risk_score_composite,
        "label_by_percentile": label_by_percentile,
        "derive_arrears": derive_arrears,
        "class_by_arrears": class_by_arrears_counts,
        "provision_by_class": provision_by_class,
        "derive_grant_date": derive_grant_date,
        # profile
        "profile_shape": _on_raw(P.shape),
        "profile_dtypes": _on_raw(P.dtypes),
        "profile_missing": _on_raw(P.missing),
        "profile_duplicates": _on_raw(P.duplicates),
        "profile_target": _on_raw(lambda r: P.target_distribution(r).withColumn(
            "taux_defaut", F.round("taux_defaut", 9))),
        "profile_numeric": _on_raw(P.numeric_stats),
        "profile_cardinality": _on_raw(P.cardinality),
        "profile_constants": _on_raw(lambda r: P.constants(r.withColumns({
            "devise": F.lit("FCFA"), "vide": F.lit(None).cast("string")}))),
        # cleaning
        "clean_drop_leakage": _on_raw(C.drop_leakage),
        "clean_age_filter": _clean_step(lambda r, t: _survivors(r.filter(C.age_valid()))),
        "clean_income_filter": _clean_step(lambda r, t: _survivors(r.filter(C.age_valid() & C.income_valid(t)))),
        "clean_amount_filter": _clean_step(
            lambda r, t: _survivors(r.filter(C.age_valid() & C.income_valid(t) & C.amount_valid(t)))),
        "clean_ratio_filter": _clean_step(lambda r, t: _survivors(C.filtered(r, t))),
        "clean_dedupe": _clean_step(lambda r, t: C.deduplicated(C.drop_leakage(C.filtered(r, t)))),
        "feat_ratio_effort": _on_credits(lambda c: c.select(
            "montant_credit_fcfa", "revenu_mensuel_fcfa", "duree_mois", "ratio_endettement", "taux_effort")),
        "feat_age_band": _band_counts("tranche_age", "age"),
        "feat_income_band": _band_counts("tranche_revenu", "revenu_mensuel_fcfa"),
        "feat_amount_band": _band_counts("tranche_montant", "montant_credit_fcfa"),
        "feat_log": _on_credits(lambda c: c.select(
            "revenu_mensuel_fcfa", "montant_credit_fcfa", "revenu_log", "montant_log")),
        "clean_impute_median": clean_impute_median,
        "clean_report": lambda spark, sf_dir: L.cleaned(spark, sf_dir).report(),
        # exploratory tables
        "eda_global": _on_credits(lambda c: E.global_analysis(c).withColumn(
            "montant_moyen_fcfa", F.round("montant_moyen_fcfa", 4))),
        "eda_rate_by_age": rate("tranche_age", AGE_BANDS.labels),
        "eda_rate_by_sector": rate("secteur_activite"),
        "eda_rate_by_product": rate("type_produit"),
        "eda_rate_by_income": rate("tranche_revenu", INCOME_BANDS.labels),
        "eda_rate_by_city": rate("ville"),
        "eda_rate_by_incident": _on_credits(lambda c: _mean9(E.by_incident(c))),
        "eda_rate_by_guarantee": rate("garantie"),
        "eda_histogram": _on_credits(lambda c: E.amount_histogram(c).withColumns({
            "borne_basse": F.round("borne_basse", 4), "borne_haute": F.round("borne_haute", 4)})),
        "eda_correlation": _on_credits(lambda c: S.correlation(c).withColumn(
            "correlation", F.round("correlation", 6))),
        "eda_crosstab": _on_credits(lambda c: S.crosstab(c, "secteur_activite", "garantie").withColumn(
            TARGET, F.round(TARGET, 9))),
        "eda_crosstab_wide": _on_credits(lambda c: S.crosstab_wide(c, "secteur_activite", "garantie")),
        "eda_crosstab_sparse": eda_crosstab_sparse,
        "eda_decile_evolution": eda_decile_evolution,
        # portfolio reports
        "sql_kpi": _on_credits(lambda c: Q.report(c, "kpi_globaux")),
        "sql_by_sector": _on_credits(lambda c: Q.report(c, "defaut_par_secteur")),
        "sql_by_product": _on_credits(lambda c: Q.report(c, "defaut_par_produit")),
        "sql_by_income": _on_credits(lambda c: Q.report(c, "defaut_par_revenu")),
        "sql_incidents": _on_credits(lambda c: Q.report(c, "impact_incidents")),
        "sql_geo": _on_credits(lambda c: Q.report(c, "analyse_geographique")),
        "sql_critical_segments": _on_credits(lambda c: Q.report(c, "segments_critiques")),
        "sql_critical_segments_150": _on_credits(lambda c: Q.critical_segments(min_n=150).run(c)),
        "sql_class_matrix": _on_credits(lambda c: Q.report(c, "matrice_cobac")),
        "sql_top_segments": _on_credits(lambda c: Q.report(c, "top_segments_risque")),
        "sql_summary": _on_credits(Q.summary),
        "sql_export_all": sql_export_all,
        "class_rules_grid": _on_credits(lambda c: c.groupBy(
            classify_sql().alias("classe_sql"), classify_masks().alias("classe_masques"), "nb_incidents_24m").agg(
            F.count(F.lit(1)).alias("nb"), F.min("taux_effort").alias("effort_min"),
            F.max("taux_effort").alias("effort_max"))),
        # models
        "ml_encode": ml_encode,
        "ml_encode_unknown": ml_encode_unknown,
        "ml_split_counts": ml_split_counts,
        "ml_class_weights": _on_credits(lambda c: Z.class_weights(c).withColumn("poids", F.round("poids", 9))),
        "ml_logreg_metrics": _model_metrics(Z.LOGISTIC),
        "ml_forest_metrics": _model_metrics(Z.FOREST),
        "ml_gbt_metrics": _model_metrics(Z.BOOSTED),
        "ml_model_selection": lambda spark, sf_dir: Z.select_best(_all_metrics(spark, sf_dir)),
        "ml_importance": ml_importance,
        "ml_class_reports": ml_class_reports,
        "ml_test_facts": ml_test_facts,
        "ml_score_facts": ml_score_facts,
        "ml_importance_facts": ml_importance_facts,
        "ml_logreg_optimality": ml_logreg_optimality,
        "ml_confusion_facts": ml_confusion_facts,
        "serve_score_facts": serve_score_facts,
        "metric_auc": metric_auc,
        "metric_average_precision": metric_average_precision,
        "metric_class_report": _on_surrogate(metric_class_report),
        "metric_confusion": _on_surrogate(M.confusion_counts),
        "score_from_probability": _score_counts(lambda: score_rounded("p"), "score"),
        "score_truncated": _score_counts(lambda: score_truncated("p"), "score"),
        "grade_v1": _by_score(lambda s: grade(s, GRADES_V1), "categorie"),
        "grade_v2": _by_score(lambda s: grade(s), "categorie"),
        "decision_v1": _by_score(lambda s: decision(s, DECISIONS_V1), "decision"),
        "decision_v2": decision_v2,
        "score_strict_three_profiles": score_strict_three_profiles,
        # calibration
        "calib_scored": calib_scored,
        "calib_describe": _on_histogram(K.describe),
        "calib_deciles": _on_histogram(K.deciles),
        "calib_bands": _on_histogram(K.bands),
        "calib_thresholds": _on_histogram(K.thresholds),
        "calib_zones": _on_histogram(K.zones),
        "calib_avoided": _on_histogram(K.avoided),
        "calib_zones_out_of_fold": calib_zones_out_of_fold,
        "calib_fold_facts": calib_fold_facts,
        # regulatory report
        "report_kpis": _on_credits(lambda c: R.kpis(c).withColumns({
            "montant_moyen_fcfa": F.round("montant_moyen_fcfa", 4),
            "perte_potentielle_fcfa": F.round("perte_potentielle_fcfa", 2)})),
        "report_sector": _on_credits(R.sector_table),
        "report_sector_extremes": _on_credits(R.sector_extremes),
        "report_product": _on_credits(R.product_table),
        "report_class": _on_credits(R.class_table),
        "report_sheet_kpis": _on_credits(lambda c: R.sheet_kpis(c).withColumn("Valeur", F.round("Valeur", 2))),
        "report_sheet_sector": _on_credits(R.sheet_sector),
        "report_sheet_product": _on_credits(R.sheet_product),
        "report_sheet_class": _on_credits(R.sheet_class),
        "report_text_rows": _on_credits(lambda c: R.text_rows(c, "2024-03-31")),
        # service
        "validate_ok": lambda spark, sf_dir: V.valid(applications(spark, sf_dir)),
        "validate_quarantine": validate_quarantine,
        "validate_rule_counts": lambda spark, sf_dir: V.rule_counts(applications(spark, sf_dir)),
        "validate_batch_size": lambda spark, sf_dir: V.batch_verdicts(
            applications(spark, sf_dir), ["ville", "type_produit", "type_emploi"]),
        "serve_features": lambda spark, sf_dir: A.serve_features(applications(spark, sf_dir)).select(
            "client_id", "montant_credit_fcfa", "duree_mois", "revenu_mensuel_fcfa", "ratio_endettement",
            "taux_effort"),
        "serve_score": serve_score,
        "serve_score_batch": serve_score_batch,
        "serve_batch_payloads": serve_batch_payloads,
        "serve_batch_facts": serve_batch_facts,
        # alerts
        "stream_segment_alerts": stream_segment_alerts,
        "batch_segment_alerts": batch_segment_alerts,
        "api_kpis": _on_credits(api_kpis),
        "api_by_sector": _on_credits(A.by_sector),
        "api_by_product": _on_credits(A.by_product),
        "model_info": lambda spark, sf_dir: Z.model_info(model(spark, sf_dir), L.credits(spark, sf_dir)),
        # dashboard
        "dash_filtered": _on_credits(lambda c: B.filtered(c, B.Filters("BUILDING", "PROMO", 1))),
        "dash_filter_values": _on_credits(B.filter_values),
        "dash_kpis": _dash(B.kpis),
        "dash_by_sector": _on_credits(lambda c: _mean9(B.rate_by(c, "secteur_activite", DASH_ALL))),
        "dash_by_product": _on_credits(lambda c: _mean9(B.rate_by(c, "type_produit", DASH))),
        "dash_incidents": _dash(B.by_incident),
        "dash_income": _dash(B.by_income),
        "dash_class": _dash(B.class_matrix),
        "dash_top_segments": _dash(B.top_segments, DASH_ALL),
    }
    return q
