"""Default-probability models: encoding, split, training, selection, importance, scoring.

Encoders, assembler and classifier live in one ``PipelineModel``, so that training, batch scoring and streaming apply
the same stages. Nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.functions.expressions import HASH_RANGE, half_even, row_hash
from loanscope.functions.rules import decision, grade, score_truncated
from loanscope.operators.forest import with_votes
from loanscope.operators.metrics import class_report, confusion_counts, ranking_metrics
from loanscope.operators.order_stats import SeriesSet
from loanscope.schemas import (
    BOOSTED,
    BOOSTED_DEPTH,
    BOOSTED_RATE,
    BOOSTED_ROUNDS,
    CATEGORICAL,
    CLEAN_SCHEMA,
    DECISIONS_V1,
    FOREST,
    FOREST_DEPTH,
    FOREST_TREES,
    GRADES_V1,
    IDENTITY,
    LOGISTIC,
    LOGISTIC_ITERATIONS,
    MODEL_NAMES,
    MODEL_SEED,
    NUMERIC_FEATURES,
    TARGET,
)
from loanscope.session import ensure_checkpoint_dir, release, staged

FEATURES = NUMERIC_FEATURES + [f"{c}_enc" for c in CATEGORICAL]
MAX_LABELS = 100_000
DEALT_FROM = 100_000  # training rows
LEAST_ROWS, TRAINING_ROWS = 20_000, 1_000_000  # of a partition of the training rows
GROUP_COUNTS, LEAST_TREES = 200_000_000, 10  # rows times trees of a forest that are trained together, and trees at least
SEED_STEP = 1_000_003  # bootstraps add the number of the partition to their seed
FEATURES_COLUMN = "features"
MISSING_LABEL = "nan"  # a missing category is a category of its own


# ---- encoding ----------------------------------------------------------------------------------------------

def _labels_sql() -> str:
    return "SELECT *, " + ", ".join(
        f"coalesce(cast({c} AS string), '{MISSING_LABEL}') AS {c}_label" for c in CATEGORICAL) + " FROM __THIS__"


def _codes_sql(sizes: Mapping[str, int]) -> str:
    """The indexer gives unseen labels the index after the last one; that index becomes -1."""
    return "SELECT *, " + ", ".join(
        f"CASE WHEN {c}_index < {sizes[c]} THEN cast({c}_index AS int) ELSE -1 END AS {c}_enc" for c in CATEGORICAL
    ) + " FROM __THIS__"


def fit_encoders(df: DataFrame) -> PipelineModel:
    """Integer codes in label order for the five categorical columns; unseen labels get -1.

    The labels become part of the model, so their number is checked before they come to the driver.
    """
    labelled = SQLTransformer(statement=_labels_sql())
    sketch = df.agg(*[F.approx_count_distinct(c).alias(c) for c in CATEGORICAL]).first().asDict()
    wide = {c: n for c, n in sketch.items() if n > MAX_LABELS}
    if wide:
        raise ValueError(f"more than {MAX_LABELS} labels: {wide}")
    indexer = StringIndexer(
        inputCols=[f"{c}_label" for c in CATEGORICAL], outputCols=[f"{c}_index" for c in CATEGORICAL],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(labelled.transform(df))
    sizes = {c: len(labels) for c, labels in zip(CATEGORICAL, indexer.labelsArray)}
    return PipelineModel([labelled, indexer, SQLTransformer(statement=_codes_sql(sizes))])


def encode(df: DataFrame, encoders: PipelineModel) -> DataFrame:
    """The encoded columns next to the input columns."""
    helpers = [f"{c}_{kind}" for c in CATEGORICAL for kind in ("label", "index")]
    return encoders.transform(df).drop(*helpers)


def strict(model: PipelineModel) -> PipelineModel:
    """The same stages, but an unseen category is an error."""
    stages = []
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            stage = stage.copy().setHandleInvalid("error")
        elif isinstance(stage, PipelineModel):
            stage = strict(stage)
        stages.append(stage)
    return PipelineModel(stages)


# ---- split and weights -------------------------------------------------------------------------------------

def loan_hash(seed: int = 42) -> Column:
    """Row key of a clean loan. Built from integers and texts, and the rate in hundredths, so it has one spelling."""
    rate = half_even(F.col("taux_interet") * 100, 0).cast("bigint")
    return row_hash([F.lit(seed), *IDENTITY, rate])


def stratified_sizes(counts: Mapping[int, int], share: float) -> dict[int, int]:
    """Rows per class in the test part: the total is rounded up, classes share it by largest remainder."""
    n = sum(counts.values())
    total = -int(-(n * share) // 1)
    exact = {c: k * total / n for c, k in counts.items()}
    out = {c: int(e) for c, e in exact.items()}
    by_remainder = sorted(exact, key=lambda c: (-(exact[c] - out[c]), c))
    for c in by_remainder[: total - sum(out.values())]:
        out[c] += 1
    return out


def with_split(df: DataFrame, share: float = 0.25, seed: int = 42, target: str = TARGET) -> DataFrame:
    """Add ``is_test``: per class, exactly its share of the rows, those with the smallest hashes.

    The bound of a class is an order statistic of its hashes, so no class is sorted or gathered. Of the rows that stand on the bound
    itself, which a hot row may make many, those with the smallest row numbers are taken, up to another order statistic: the
    shares hold exactly whatever the ties. A row without label belongs to neither part: its ``is_test`` is missing.
    """
    # hash and number are worked out once per row; the passes that follow read stored columns
    numbered = staged(df.withColumns({"_hash": loan_hash(seed), "_row": F.monotonically_increasing_id()}), "split_rows")
    counts = {r[target]: r["n"] for r in numbered.filter(F.col(target).isNotNull()).groupBy(target)
              .agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    sizes = {c: k for c, k in stratified_sizes(counts, share).items() if k > 0}
    series = {f"class{c}": F.when(F.col(target) == c, F.col("_hash")) for c in sizes}
    extent = {f"class{c}": (counts[c], *HASH_RANGE) for c in sizes}
    bounds = SeriesSet(numbered, series, extent).values_at({f"class{c}": [k - 1] for c, k in sizes.items()})
    on_bound = {c: bounds[(f"class{c}", k - 1)] for c, k in sizes.items()}
    # of the rows on a bound, how many belong to the test part, and the row number of the last of them
    wanted = {c: sizes[c] - hit.below for c, hit in on_bound.items()}
    tied = [c for c, hit in on_bound.items() if wanted[c] < hit.rows]
    last = {}
    if tied:
        rows = {f"tie{c}": F.when((F.col(target) == c) & (F.col("_hash") == on_bound[c].value), F.col("_row")) for c in tied}
        search = SeriesSet(numbered, rows)
        search.measure()
        found = search.values_at({f"tie{c}": [wanted[c] - 1] for c in tied})
        last = {c: found[(f"tie{c}", wanted[c] - 1)].value for c in tied}
    inside = F.lit(False)
    for c, hit in on_bound.items():
        on = F.col("_hash") == hit.value
        within = (F.col("_hash") < hit.value) | ((on & (F.col("_row") <= last[c])) if c in last else on)
        inside = F.when(F.col(target) == c, within).otherwise(inside)
    return numbered.withColumn("is_test", F.when(F.col(target).isNotNull(), inside)).drop("_hash", "_row")


def class_weights(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Balanced weight of each class: rows / (classes * rows of the class)."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("nb"))
    whole = counts.agg(F.sum("nb").alias("_n"), F.count(F.lit(1)).alias("_k"))
    # one row against one row per class
    return counts.crossJoin(F.broadcast(whole)).select(
        target, "nb", (F.col("_n").cast("double") / (F.col("_k") * F.col("nb")).cast("double")).alias("poids"))


def _weight_column(weights: Mapping[int, float]) -> Column:
    out = F.lit(1.0)
    for c, w in weights.items():
        out = F.when(F.col(TARGET) == c, F.lit(float(w))).otherwise(out)
    return out


# ---- training ----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class ModelSizes:
    """Sizes of the three models; the defaults are for real training, small ones suit checks."""

    logistic_iterations: int = LOGISTIC_ITERATIONS
    forest_trees: int = FOREST_TREES
    forest_depth: int = FOREST_DEPTH
    boosted_rounds: int = BOOSTED_ROUNDS
    boosted_depth: int = BOOSTED_DEPTH
    boosted_rate: float = BOOSTED_RATE
    seed: int = MODEL_SEED


def _classifier_stages(name: str, n_train: int, sizes: ModelSizes) -> list:
    common = {"labelCol": TARGET, "weightCol": "weight", "featuresCol": "features"}
    if name == LOGISTIC:
        # the L2 penalty is per unit of total weight here; balanced weights sum to the number of rows
        return [
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
            LogisticRegression(**{**common, "featuresCol": "scaled"}, maxIter=sizes.logistic_iterations,
                               standardization=False, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0),
        ]
    if name == FOREST:
        # a group of trees passes over its rows about once a level: no lineage that a checkpoint of all node numbers should cut
        return [RandomForestClassifier(**common, numTrees=sizes.forest_trees, maxDepth=sizes.forest_depth,
                                       featureSubsetStrategy="sqrt", maxMemoryInMB=1024, cacheNodeIds=True,
                                       checkpointInterval=-1, seed=sizes.seed)]
    if name == BOOSTED:
        return [GBTClassifier(**common, maxIter=sizes.boosted_rounds, maxDepth=sizes.boosted_depth,
                              stepSize=sizes.boosted_rate, maxMemoryInMB=1024, checkpointInterval=10,
                              seed=sizes.seed)]
    raise ValueError(f"unknown model {name}")


def training_parts(rows: int, slots: int) -> int:
    """Partitions of the training rows: a whole number for every slot of the cluster, of at most ``TRAINING_ROWS`` rows each."""
    return max(1, min(rows // LEAST_ROWS, slots * -(-rows // (slots * TRAINING_ROWS))))


def dealt(training: DataFrame, rows: int) -> DataFrame:
    """Equal shares of the training rows for all slots: every pass of the tree models, which are long and many, waits for its largest partition.

    Tables below ``DEALT_FROM`` rows stay as they are. Bootstraps and split samples of tree models follow partitions.
    """
    if rows < DEALT_FROM:
        return training
    return training.repartition(training_parts(rows, training.sparkSession.sparkContext.defaultParallelism))


def tree_groups(trees: int, rows: int) -> list[int]:
    """Sizes of the groups in which a forest is trained.

    Training stores a bootstrap count and up to three node numbers for every row and tree; a group stores those of its own trees alone,
    so what is stored does not grow with the forest. Tables below ``DEALT_FROM`` rows train the whole forest at once.
    """
    if rows < DEALT_FROM:
        return [trees]
    groups = -(-trees // max(LEAST_TREES, GROUP_COUNTS // rows))
    return [trees // groups + (i < trees % groups) for i in range(groups)]


def joined_forest(
    spark: SparkSession, groups: Sequence[RandomForestClassificationModel]
) -> RandomForestClassificationModel:
    """One forest of the trees of several: trees of a forest do not depend on each other, and all have one vote."""
    if len(groups) == 1:
        return groups[0]
    # pyspark has no constructor of a forest from trees
    kinds = spark.sparkContext._jvm.org.apache.spark.ml.classification
    trees = [t._java_obj for g in groups for t in g.trees]
    array = spark.sparkContext._gateway.new_array(kinds.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    first = groups[0]._java_obj
    whole = kinds.RandomForestClassificationModel(first.uid(), array, first.numFeatures(), first.numClasses())
    params = first.extractParamMap()
    params.put(first.numTrees(), len(trees))
    return RandomForestClassificationModel(first.copyValues(whole, params))


def _fit_forest(prepared: DataFrame, n_train: int, sizes: ModelSizes) -> RandomForestClassificationModel:
    """The forest, group by group; the shuffles of a group go before the next one is trained."""
    groups = []
    for i, trees in enumerate(tree_groups(sizes.forest_trees, n_train)):
        if groups:
            release(prepared.sparkSession)
        one = replace(sizes, forest_trees=trees, seed=sizes.seed + i * SEED_STEP)
        [forest] = _classifier_stages(FOREST, n_train, one)
        groups.append(forest.fit(prepared))
    return joined_forest(prepared.sparkSession, groups)


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol=FEATURES_COLUMN)


def fit_model(
    train: DataFrame, name: str, encoders: PipelineModel, sizes: ModelSizes = ModelSizes()
) -> PipelineModel:
    """Fit one model on loans; the result also holds the encoding stages.

    Loans that come with their ``features`` (``fold_loans``) are stored and encoded already.
    """
    ensure_checkpoint_dir(train.sparkSession)
    train = train.filter(F.col(TARGET).isNotNull())
    counts = {r[TARGET]: r["n"] for r in train.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if name == BOOSTED:
        weights = {1: counts.get(0, 0) / counts[1]}
    else:
        weights = {c: n / (len(counts) * k) for c, k in counts.items()}
    assembler = _assembler()
    # the estimators pass over their input many times: encode and assemble once
    ready = FEATURES_COLUMN in train.columns
    rows = (train if ready else assembler.transform(encode(train, encoders))).select(
        FEATURES_COLUMN, F.col(TARGET).cast("double").alias(TARGET), _weight_column(weights).alias("weight"))
    if name != LOGISTIC:
        rows = dealt(rows, n)
    prepared = rows if ready and name == LOGISTIC else staged(rows, "training")
    if name == FOREST:
        fitted = [_fit_forest(prepared, n, sizes)]
    else:
        fitted = Pipeline(stages=_classifier_stages(name, n, sizes)).fit(prepared).stages
    return PipelineModel([*encoders.stages, assembler, *fitted])


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Input columns plus ``proba`` (of default) and ``prediction``."""
    *before, last = model.stages
    if isinstance(last, RandomForestClassificationModel):
        ready = PipelineModel(before).transform(df).select(*df.columns, vector_to_array(last.getFeaturesCol()).alias("_features"))
        out = with_votes(ready, last)
        if out is not None:
            return out
    out = model.transform(df).withColumn("proba", vector_to_array("probability")[1])
    return out.select(*df.columns, "proba", F.col("prediction").cast("int").alias("prediction"))


def evaluate(predictions: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """One row of test metrics, and the class report (classes, accuracy, macro and weighted means).

    Predictions are written once: four aggregates read them.
    """
    kept = staged(predictions.select(F.col(TARGET).alias("label"), "proba", "prediction"), "predictions")
    report = staged(class_report(kept).select(F.lit(name).alias("modele"), "*"), "class_report")
    of_default = report.filter("classe = '1'").select("precision", "recall", "f1_score")
    # three one-row aggregates
    metrics = ranking_metrics(kept, "proba").crossJoin(F.broadcast(of_default)).crossJoin(
        F.broadcast(confusion_counts(kept))).select(F.lit(name).alias("modele"), "*")
    return metrics, report


def logistic_gradient(train: DataFrame, model: PipelineModel) -> DataFrame:
    """One row: rows, and the largest partial derivative of the training loss at the fitted coefficients.

    The penalised loss of the logistic model is convex, so it has one optimum, and there every derivative is 0. The sums over the rows are
    one pass of column expressions; weights and penalty are those of ``fit_model``.
    """
    fitted = model.stages[-1]
    train = train.filter(F.col(TARGET).isNotNull())
    counts = {r[TARGET]: r["n"] for r in train.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    weights = {c: n / (len(counts) * k) for c, k in counts.items()}
    scored = model.transform(train).select(
        vector_to_array("scaled").alias("x"), (vector_to_array("probability")[1] - F.col(TARGET)).alias("miss"),
        _weight_column(weights).alias("w"))
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("miss")).alias("g"),
        *[F.sum(F.col("w") * F.col("miss") * F.col("x")[i]).alias(f"g{i}") for i in range(len(FEATURES))])
    penalty = fitted.getRegParam()
    parts = [F.abs(F.col("g") / F.col("w"))] + [
        F.abs(F.col(f"g{i}") / F.col("w") + F.lit(penalty * float(c))) for i, c in enumerate(fitted.coefficients.toArray())]
    return sums.select(F.col("n").alias("nb_train"), F.greatest(*parts).alias("plus_grande_derivee"))


# ---- folds ---------------------------------------------------------------------------------------------------

def fold_of(folds: int, seed: int = 7) -> Column:
    """Fold of a loan by the hash of its content: equal loans share a fold, so a copy never sits on both sides."""
    return F.pmod(loan_hash(seed), F.lit(folds)).cast("int")


@dataclass(frozen=True)
class FoldedLoans:
    """Encoders of the whole table, and its loans with ``fold`` and ``features``, one part per fold."""

    encoders: PipelineModel
    rows: DataFrame
    folds: int


def fold_loans(loans: DataFrame, folds: int = 4, encoders: PipelineModel | None = None) -> FoldedLoans:
    """The table is hashed, encoded and written once; every model trains on the files of the other folds, and scores those of its own.

    A loan without label trains no model: its features are left to the scoring.
    """
    encoders = encoders or fit_encoders(loans)
    numbered = loans.withColumn("fold", fold_of(folds))
    known = _assembler().transform(encode(numbered.filter(F.col(TARGET).isNotNull()), encoders)).select(*numbered.columns, FEATURES_COLUMN)
    others = numbered.filter(F.col(TARGET).isNull()).withColumn(FEATURES_COLUMN, F.lit(None).cast(VectorUDT()))
    return FoldedLoans(encoders, staged(known.unionByName(others), "folds", partition_by="fold"), folds)


def fit_folds(
    loans: DataFrame | FoldedLoans, name: str, folds: int = 4, sizes: ModelSizes = ModelSizes()
) -> list[PipelineModel]:
    """For every fold, a model of all loans outside it; encoders see the whole table, labels of the fold do not enter."""
    parts = loans if isinstance(loans, FoldedLoans) else fold_loans(loans, folds)
    return [fit_model(parts.rows.filter(F.col("fold") != i).drop("fold"), name, parts.encoders, sizes) for i in range(parts.folds)]


def predict_out_of_fold(loans: DataFrame | FoldedLoans, models: Sequence[PipelineModel]) -> DataFrame:
    """Input columns plus ``fold``, ``proba``, ``prediction``: every loan is scored by the model that has not seen its fold.

    The fold is worked out once per loan, and each model reads the files of its fold alone.
    """
    if isinstance(loans, FoldedLoans):
        folded = loans.rows.drop(FEATURES_COLUMN)
    else:
        folded = staged(loans.withColumn("fold", fold_of(len(models))), "folds", partition_by="fold")
    return reduce(DataFrame.unionByName, [predict(folded.filter(F.col("fold") == i), m) for i, m in enumerate(models)])


@dataclass(frozen=True)
class TrainingResult:
    models: dict[str, PipelineModel]
    metrics: DataFrame
    best_name: str
    reports: DataFrame  # the class report of every model

    @property
    def best(self) -> PipelineModel:
        return self.models[self.best_name]


def select_best(metrics: DataFrame) -> DataFrame:
    """The model with the highest ROC area; of equal ones, the first in the order of training."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MODEL_NAMES]), F.col("modele")), F.lit(0))
    return metrics.agg(F.max_by("modele", F.struct("auc", -place)).alias("meilleur_modele"), F.max("auc").alias("auc"))


@dataclass(frozen=True)
class SplitLoans:
    """Encoders of the whole table and the two parts of one stratified split."""

    encoders: PipelineModel
    train: DataFrame
    test: DataFrame


def split_loans(
    credits: DataFrame, share: float = 0.25, seed: int = 42, encoders: PipelineModel | None = None
) -> SplitLoans:
    parts = staged(with_split(credits, share, seed), "split", partition_by="is_test")
    return SplitLoans(
        encoders or fit_encoders(credits),
        parts.filter(~F.col("is_test")).drop("is_test"),
        parts.filter("is_test").drop("is_test"))


def train_models(
    loans: DataFrame | SplitLoans, names=MODEL_NAMES, sizes: ModelSizes = ModelSizes(), share: float = 0.25
) -> TrainingResult:
    """Fit and compare the models on one stratified split; encoders see the whole table."""
    parts = loans if isinstance(loans, SplitLoans) else split_loans(loans, share, sizes.seed)
    models = {name: fit_model(parts.train, name, parts.encoders, sizes) for name in names}
    results = [evaluate(predict(parts.test, model), name) for name, model in models.items()]
    metrics = staged(reduce(DataFrame.unionByName, [m for m, _ in results]), "model_metrics")
    reports = reduce(DataFrame.unionByName, [r for _, r in results])
    best = select_best(metrics).first()["meilleur_modele"]
    return TrainingResult(models, metrics, best, reports)


def importance(model: PipelineModel, loans: DataFrame) -> DataFrame | None:
    """Features by falling importance, in percent of the sum; None when the classifier has no importances."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = [float(v) for v in last.featureImportances.toArray()]
    elif hasattr(last, "coefficients"):
        values = [abs(float(v)) for v in last.coefficients.toArray()]
    else:
        return None
    total = sum(values)
    spark = loans.sparkSession
    rows = [(f, v, 100.0 * v / total if total else None, i) for i, (f, v) in enumerate(zip(FEATURES, values))]
    frame = spark.createDataFrame(rows, "feature string, importance double, importance_pct double, place int")
    return frame.withColumn("importance_pct", half_even("importance_pct", 2)).orderBy(
        F.desc("importance"), "place").drop("place")


def model_info(model: PipelineModel, loans: DataFrame, top: int = 10) -> DataFrame:
    """Type, number of features, and the leading importances in percent (zeros if the model has none).

    Features are ranked by the importance itself, equal ones in feature order; only then is it rounded.
    """
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [0.0] * len(FEATURES)
    rows = [(type(last).__name__, len(FEATURES), f, 100.0 * float(v), i) for i, (f, v) in enumerate(zip(FEATURES, values))]
    frame = loans.sparkSession.createDataFrame(
        rows, "type_modele string, nb_features int, feature string, importance_pct double, place int")
    return frame.orderBy(F.desc("importance_pct"), "place").limit(top).withColumn(
        "importance_pct", half_even("importance_pct", 2)).drop("place")


# ---- scoring -----------------------------------------------------------------------------------------------

def score_strict(loans: DataFrame, model: PipelineModel) -> DataFrame:
    """Score prepared loans with the first grade and decision scale; an unseen category is an error."""
    scored = predict(loans, strict(model)).withColumn("score", score_truncated("proba"))
    return scored.select(
        *loans.columns,
        half_even(F.col("proba") * 100, 2).alias("probabilite_defaut"),
        "score",
        grade("score", GRADES_V1).alias("categorie"),
        decision("score", DECISIONS_V1).alias("decision"),
    )


def score_client(spark: SparkSession, client: Mapping[str, object], model: PipelineModel) -> dict:
    """Strict scoring of one client given as a record with its ratios; the same plan as for a portfolio."""
    kinds = {f.name: f.dataType for f in CLEAN_SCHEMA.fields}
    names = [*CATEGORICAL, *NUMERIC_FEATURES]
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    values = tuple(
        float(client[n]) if isinstance(kinds[n], T.DoubleType) else client[n] for n in names)
    scored = score_strict(spark.createDataFrame([values], schema), model)
    return scored.select("probabilite_defaut", "score", "categorie", "decision").first().asDict()


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
