"""Claim probability / severity models with Spark ML, plus the
model-metrics table (D10) and its queries (W5, Q24-Q26).

Training data is cut from its lineage with a reliable checkpoint into the
cluster's shared ``spark.checkpoint.dir`` before the iterative fit, so an
executor loss mid-training recomputes from the checkpoint, not from the raw
scan. Splits and folds go by places in a hash order (deterministic under
repartition and task retry, unlike ``randomSplit``), in each class for itself
where they are stratified. Boosting stops early on a slice of the training
rows that is set aside for it.
"""

from __future__ import annotations

import contextlib
import datetime as _dt
import math
import os
import random
import statistics

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MODEL_METRICS_SCHEMA
from ..sources.tables import cut_lineage, drop_checkpoint
from .evaluation import average_precision, classification_metrics, regression_metrics, roc_auc, score_table
from .features import FEATURE_NAMES

# Reference hyper-parameters (fixed values): probability model 100 trees,
# depth 6, learning rate 0.05; severity model 200 trees, depth 6, 0.05.
PROBABILITY_PARAMS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.05}
SEVERITY_PARAMS = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05}
SEED = 42


def hash_split(df: DataFrame, id_col: str, train_pct: int = 80, seed: int = SEED, out: str = "split") -> DataFrame:
    """M1/M2: deterministic train/test split by id hash."""
    b = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(100))
    return df.withColumn(out, F.when(b < train_pct, F.lit("train")).otherwise(F.lit("test")))


def hash_folds(df: DataFrame, id_col: str, k: int = 5, seed: int = SEED, out: str = "fold") -> DataFrame:
    """M7: fold number 0..k-1 by id hash (for CrossValidator(foldCol=...))."""
    return df.withColumn(out, F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed + 1)), F.lit(k)).cast("int"))


#: rows that a range of the hash order, or a partition of a fit, holds on average
RANGE_ROWS, FIT_ROWS = 50_000, 20_000
#: a tree level shuffles one table of its nodes' histograms for every partition, so a large table has
#: this many partitions and no more, until those hold FIT_MOST rows each
FIT_PARTS, FIT_MOST = 64, 1_000_000
#: rows that fits under way at once may hold in memory
FIT_AT_ONCE = 30_000_000
HASH_BITS = 52


def hash_places(df: DataFrame, id_col: str, strata: str | None = None, seed: int = SEED) -> DataFrame:
    """``df`` plus place (0-based, in the order of a hash of the id, ties by the id) and
    n_class (rows), within each value of ``strata``. The hash is uniform, so equal ranges of it
    hold equally many rows: each is ordered by itself and starts after the rows
    that lower ranges hold; a class with nearly all rows is spread over them all."""
    d = df.withColumn("__h", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, HASH_BITS // 4), 16, 10).cast("long")) \
        .withColumn("__class", F.coalesce(F.col(strata).cast("string"), F.lit("null")) if strata else F.lit(""))
    bits = max(0, math.ceil(math.log2(max(1, df.count() / RANGE_ROWS))))
    d = d.withColumn("__range", F.shiftright("__h", HASH_BITS - bits))
    n = d.groupBy("__class", "__range").agg(F.count(F.lit(1)).alias("__n"))
    below = Window.partitionBy("__class").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("__class", "__range", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__below"),
                 F.sum("__n").over(Window.partitionBy("__class")).alias("n_class"))
    here = Window.partitionBy("__class", "__range").orderBy("__h", F.col(id_col))
    return d.withColumn("__at", F.row_number().over(here)).join(n, ["__class", "__range"]) \
        .withColumn("place", F.col("__below") + F.col("__at") - 1).drop("__h", "__class", "__range", "__at", "__below")


def place_split(df: DataFrame, id_col: str, strata: str | None = None, train: float = 0.8, k: int = 5, validation: float = 0.1,
                seed: int = SEED) -> DataFrame:
    """M1/M2/M7: exact shares of every class. split: the first ``train`` of a class's places
    train, the rest test; fold: training rows dealt to 0..k-1 in turn (null: test);
    is_validation: the last ``validation`` of the training places, for early stopping."""
    d = hash_places(df, id_col, strata, seed)
    quota = F.floor(F.col("n_class") * train + 0.5)
    trains = F.col("place") < quota
    return d.withColumns({
        "split": F.when(trains, F.lit("train")).otherwise(F.lit("test")),
        "fold": F.when(trains, (F.col("place") % k).cast("int")),
        "is_validation": trains & (F.col("place") >= F.floor(quota * (1 - validation) + 0.5)),
    }).drop("place", "n_class")


def fit_partitions(rows: int) -> int:
    return max(1, min(math.ceil(rows / FIT_ROWS), FIT_PARTS), math.ceil(rows / FIT_MOST))


def for_fitting(df: DataFrame, id_col: str, derive=None) -> DataFrame:
    """Partitions by the number of rows, in a fixed order, lineage cut: every boosting round is a
    job per tree level, and a rerun of a fit with row sampling must meet the same rows in the same places.
    ``derive`` adds what follows from each row by itself once the rows are dealt and written, so that
    it is neither shuffled nor kept in the shared folder."""
    dealt = cut_lineage(df.repartition(fit_partitions(df.count()), id_col).sortWithinPartitions(id_col))
    return derive(dealt) if derive else dealt


def split_report(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows and positive rate per split (stratification check)."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives"),
                                 F.avg(label).alias("positive_rate"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """M4: weight = n_neg / n_pos for positives, 1 otherwise (1-row agg, broadcast)."""
    w = df.agg(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("__w"))
    return df.crossJoin(F.broadcast(w)).withColumn(
        out, F.when(F.col(label) == 1, F.coalesce("__w", F.lit(1.0))).otherwise(F.lit(1.0))).drop("__w")


def _assembler(features):
    return VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep")


def _scaler():
    # M3: z-score; Spark divides by the sample std (tree models ignore the scale).
    return StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)


def _stops_early(est):
    """Boosting that ends with the round after which the rows marked is_validation lose nothing more."""
    est.set(est.validationTol, 0.0)
    return est.setValidationIndicatorCol("is_validation")


def probability_estimator(kind: str = "gbt", params: dict | None = None, weight_col: str | None = "weight", early_stop: bool = False):
    """M5/M11 classifiers. ``early_stop``: boosting ends when rows marked is_validation gain no more."""
    p = dict(PROBABILITY_PARAMS if kind == "gbt" else {}, **(params or {}))
    if kind == "gbt":
        est = GBTClassifier(labelCol="label", featuresCol="features", seed=SEED, **p)
    elif kind == "random_forest":
        est = RandomForestClassifier(labelCol="label", featuresCol="features", seed=SEED, numTrees=100, **p)
    elif kind == "logistic_regression":
        est = LogisticRegression(labelCol="label", featuresCol="features", maxIter=100, **p)
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    if weight_col:
        est = est.setWeightCol(weight_col)
    return _stops_early(est) if early_stop and kind == "gbt" else est


def severity_estimator(kind: str = "gbt", params: dict | None = None, early_stop: bool = False):
    """M8/M11 regressors (label is log1p(amount))."""
    p = dict(SEVERITY_PARAMS if kind == "gbt" else {}, **(params or {}))
    if kind == "gbt":
        est = GBTRegressor(labelCol="label", featuresCol="features", seed=SEED, **p)
        return _stops_early(est) if early_stop else est
    if kind == "random_forest":
        return RandomForestRegressor(labelCol="label", featuresCol="features", seed=SEED, numTrees=100, **p)
    if kind in ("linear", "ridge", "lasso"):
        reg = {"linear": (0.0, 0.0), "ridge": (0.1, 0.0), "lasso": (0.1, 1.0)}[kind]
        return LinearRegression(labelCol="label", featuresCol="features", regParam=reg[0], elasticNetParam=reg[1])
    raise ValueError(f"unknown regressor {kind!r}")


def prepare_probability_data(features: DataFrame, label_col: str = "has_claim", id_col: str = "trip_id",
                             checkpoint: bool = True, derive=None) -> DataFrame:
    """Features + label + weight + split, lineage cut into the shared checkpoint dir. ``derive``:
    makes the features of rows that come with their inputs only (see `for_fitting`)."""
    d = features.withColumn("label", F.col(label_col).cast("double"))
    d = with_class_weight(place_split(d, id_col, "label"))
    return for_fitting(d, id_col, derive) if checkpoint else derive(d) if derive else d


TREE_KINDS = ("gbt", "random_forest")


def _stages(features, kind, est):
    """Assembler (+ M3 scaler for linear models; tree splits are scale-invariant,
    so scaling them would only cost a pass over the data)."""
    if kind in TREE_KINDS:
        return [_assembler(features), est.setFeaturesCol("raw_features")]
    return [_assembler(features), _scaler(), est]


def _fits_at_once(train: DataFrame, parallelism: int) -> int:
    """Each fit holds its binned rows in memory: as many at a time as have room, one at least."""
    return max(1, min(parallelism, FIT_AT_ONCE // max(1, train.count())))


def fit_probability(train: DataFrame, kind: str = "gbt", params: dict | None = None,
                    features=FEATURE_NAMES) -> PipelineModel:
    stop = "is_validation" in train.columns
    return Pipeline(stages=_stages(features, kind, probability_estimator(kind, params, early_stop=stop))).fit(train)


def predict_probability(model: PipelineModel, df: DataFrame, keep=("trip_id", "driver_id", "label")) -> DataFrame:
    """Probability of class 1 and the hard label (p > 0.5)."""
    out = model.transform(df)
    p = vector_to_array(F.col("probability"))[1]
    return out.select(*[c for c in keep if c in df.columns], p.alias("claim_probability"),
                      (p > 0.5).cast("int").alias("predicted_label"))


def evaluate_probability(pred: DataFrame) -> DataFrame:
    """V1-V4 on a scored test split: one row of metrics. Both areas come from one table of scores."""
    ev = pred.select(F.col("label").cast("int").alias("label"), F.col("claim_probability").alias("score"),
                     F.col("predicted_label").alias("prediction"))
    t = score_table(ev)
    return classification_metrics(ev).crossJoin(roc_auc(ev, table=t).select("roc_auc")).crossJoin(average_precision(ev, table=t))


def prepare_severity_data(features: DataFrame, amount_col: str = "claim_amount", label_col: str = "has_claim",
                          id_col: str = "trip_id", checkpoint: bool = True, derive=None) -> DataFrame:
    """M8 data: claims only (J7-style filter), label = log1p(amount)."""
    d = features.filter((F.col(label_col) == 1) & (F.col(amount_col) > 0)) \
        .withColumn("label", F.log1p(F.col(amount_col).cast("double")))
    d = place_split(d, id_col)
    return for_fitting(d, id_col, derive) if checkpoint else derive(d) if derive else d


def fit_severity(train: DataFrame, kind: str = "gbt", params: dict | None = None,
                 features=FEATURE_NAMES) -> PipelineModel:
    stop = "is_validation" in train.columns
    return Pipeline(stages=_stages(features, kind, severity_estimator(kind, params, early_stop=stop))).fit(train)


def predict_severity(model: PipelineModel, df: DataFrame, keep=("trip_id", "driver_id", "claim_amount")) -> DataFrame:
    """expm1 back to dollars, floored at 0."""
    out = model.transform(df)
    return out.select(*[c for c in keep if c in df.columns],
                      F.greatest(F.expm1("prediction"), F.lit(0.0)).alias("claim_severity_prediction"))


def evaluate_severity(pred: DataFrame) -> DataFrame:
    return regression_metrics(pred, "claim_amount", "claim_severity_prediction")


def feature_importance(spark: SparkSession, model: PipelineModel, features=FEATURE_NAMES) -> DataFrame:
    """(feature, importance) sorted; the vector is model metadata of
    fixed size (#features), not data."""
    tree = model.stages[-1]
    if hasattr(tree, "featureImportances"):
        imp = tree.featureImportances.toArray().tolist()
    else:
        imp = [abs(float(x)) for x in tree.coefficients.toArray()]
    rows = [(f, float(v), i) for i, (f, v) in enumerate(zip(features, imp))]
    return spark.createDataFrame(rows, "feature string, importance double, position int") \
        .orderBy(F.desc("importance"), "position")


def _evaluator(metric: str):
    """What a setting is judged by in cross-validation."""
    if metric == "f1":
        return MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
    if metric == "roc_auc":
        return BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    return RegressionEvaluator(labelCol="label", metricName=metric)


@contextlib.contextmanager
def _kept(d: DataFrame, assembled: str):
    """What fits on folds read of assembled rows, written to the shared folder while they run: every fit goes over its
    rows several times before its first tree, and would assemble them each time. Not cached: a cached partition holds
    batches of 10,000 rows, of which Java's serializer keeps up to a hundred in memory when they go to disk and come
    back, beside the binned rows that every fit keeps itself. Written rows come back one by one, in the same partitions."""
    d = cut_lineage(d.select(assembled, "label", "fold", *[c for c in ("weight", "is_validation") if c in d.columns]))
    try:
        yield d
    finally:
        drop_checkpoint(d)


def _cross_validate(train: DataFrame, est, settings: list[dict], metrics: list[str], k: int, parallelism: int, features) -> list[list[tuple[float, float]]]:
    """Per setting of a boosted model and metric, (mean, standard deviation) over the folds. Every
    (setting, fold) is one fit, at most `parallelism` of them at a time; none is fitted on all rows.
    The assembled rows are kept in the shared folder while the fits run."""
    from concurrent.futures import ThreadPoolExecutor

    est = est.setFeaturesCol("raw_features")

    def one(d, job):
        setting, fold = job
        model = est.fit(d.filter(F.col("fold") != fold), {est.getParam(n): v for n, v in setting.items()})
        pred = model.transform(d.filter(F.col("fold") == fold))
        return [float(_evaluator(m).evaluate(pred)) for m in metrics]

    with _kept(_assembler(features).transform(train).withColumn("fold", F.col("fold") % k), "raw_features") as d, \
            ThreadPoolExecutor(max_workers=_fits_at_once(d, parallelism)) as ex:
        got = list(ex.map(lambda job: one(d, job), [(s, f) for s in settings for f in range(k)]))
    per = [list(zip(*got[i * k:(i + 1) * k])) for i in range(len(settings))]
    return [[(statistics.fmean(v), statistics.stdev(v) if k > 1 else 0.0) for v in evs] for evs in per]


def cross_validate(train: DataFrame, target: str = "probability", k: int = 5, parallelism: int = 8, features=FEATURE_NAMES,
                   params: dict | None = None) -> DataFrame:
    """M7: k folds (by the fold column, stratified for the claim) of the configured model of a
    target: ROC-AUC and F1 of the claim probability, RMSE of log1p(amount)."""
    est = (probability_estimator if target == "probability" else severity_estimator)("gbt", None, early_stop=True)
    metrics = ["roc_auc", "f1"] if target == "probability" else ["rmse"]
    got, = _cross_validate(train, est, [params or {}], metrics, k, parallelism, features)
    rows = [(target, name, k, mean, std) for name, (mean, std) in zip(metrics, got)]
    return train.sparkSession.createDataFrame(rows, "target string, metric string, folds int, mean double, std double")


def sampled_settings(n: int = 20, seed: int = SEED) -> list[dict]:
    """``n`` seeded draws over seven parameters of Spark's boosted trees."""
    rng = random.Random(seed)
    return [{"maxDepth": rng.randint(3, 6), "maxIter": rng.randint(10, 40), "stepSize": round(math.exp(rng.uniform(math.log(0.01), math.log(0.3))), 4),
             "subsamplingRate": round(rng.uniform(0.6, 1.0), 3), "featureSubsetStrategy": rng.choice(["all", "sqrt", "onethird", "0.6", "0.8"]),
             "minInstancesPerNode": rng.randint(1, 10), "minInfoGain": round(rng.uniform(0.0, 0.01), 5)} for _ in range(n)]


def random_search(train: DataFrame, target: str = "probability", n: int = 20, k: int = 3, parallelism: int = 8, seed: int = SEED,
                  features=FEATURE_NAMES) -> DataFrame:
    """Every sampled setting cross-validated on hash folds: F1 of the claim, RMSE of
    log1p(amount). One row per setting with its mean, deviation and rank (1: best)."""
    settings = sampled_settings(n, seed)
    prob = target == "probability"
    est = (probability_estimator if prob else severity_estimator)("gbt", None, early_stop=True)
    got = _cross_validate(train, est, settings, ["f1" if prob else "rmse"], k, parallelism, features)
    order = sorted(range(n), key=lambda i: (-got[i][0][0] if prob else got[i][0][0], i))
    rows = [(target, i, order.index(i) + 1, str(sorted(p.items())), "f1" if prob else "rmse", m, sd, k)
            for i, (p, ((m, sd),)) in enumerate(zip(settings, got))]
    return train.sparkSession.createDataFrame(
        rows, "target string, trial int, rank int, params string, metric string, mean double, std double, folds int")


class AverageProbability(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of the class-1 entries of probability vectors; its input columns and what made them go."""

    def __init__(self, inputCols=None, outputCol="claim_probability"):
        super().__init__()
        self._set(inputCols=inputCols or [], outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        p = sum((vector_to_array(F.col(c))[1] for c in cols), F.lit(0.0)) / len(cols)
        return df.withColumn(self.getOutputCol(), p).drop(*[c for c in df.columns if c.startswith("__cal_")])


def fit_calibrated_probability(data: DataFrame, k: int = 3, features=FEATURE_NAMES, params: dict | None = None) -> PipelineModel:
    """M6: Platt calibration with k folds, as one pipeline that can be saved. Fold i fits the
    boosted trees on the other folds and a logistic regression on their margin for fold i;
    the last stage averages the k calibrated probabilities. The k fits run
    concurrently where they have room (Spark schedules jobs from several driver threads);
    the assembled rows are kept in the shared folder meanwhile."""
    from concurrent.futures import ThreadPoolExecutor

    assemble = VectorAssembler(inputCols=list(features), outputCol="__cal_features", handleInvalid="keep")

    def one(d, i):
        est = probability_estimator("gbt", params, early_stop="is_validation" in data.columns)
        est = est.setFeaturesCol("__cal_features").setRawPredictionCol(f"__cal_raw{i}").setProbabilityCol(f"__cal_p{i}").setPredictionCol(f"__cal_y{i}")
        trees = est.fit(d.filter(F.col("fold") != i))
        # without weights: the sigmoid maps margins to the rate of claims as it is
        sigmoid = LogisticRegression(labelCol="label", featuresCol=f"__cal_raw{i}", rawPredictionCol=f"__cal_lraw{i}", probabilityCol=f"__cal_lp{i}",
                                     predictionCol=f"__cal_ly{i}", maxIter=100).fit(trees.transform(d.filter(F.col("fold") == i)))
        return [trees, sigmoid]

    with _kept(assemble.transform(data.withColumn("fold", F.col("fold") % k)), "__cal_features") as d, \
            ThreadPoolExecutor(max_workers=_fits_at_once(d, k)) as ex:
        pairs = list(ex.map(lambda i: one(d, i), range(k)))
    return PipelineModel([assemble, *[s for p in pairs for s in p], AverageProbability([f"__cal_lp{i}" for i in range(k)])])


def predict_calibrated(model: PipelineModel, df: DataFrame, keep=("trip_id", "driver_id", "label")) -> DataFrame:
    """Calibrated probability and hard label (p > 0.5), in one narrow plan."""
    d = model.transform(df)
    return d.select(*[c for c in keep if c in df.columns], "claim_probability",
                    (F.col("claim_probability") > 0.5).cast("int").alias("predicted_label"))


def tree_count(model: PipelineModel) -> int:
    """Trees that boosting kept."""
    return model.stages[-1].getNumTrees


def compare_algorithms(data: DataFrame, target: str, kinds, fit=None, features=FEATURE_NAMES) -> DataFrame:
    """Each algorithm fitted on the training rows and evaluated on the test rows: one row with
    its metrics, or with the error that its fit ended with (the others go on)."""
    spark, train, test = data.sparkSession, data.filter("split = 'train'"), data.filter("split = 'test'")
    prob = target == "claim_probability"
    fit = fit or (fit_probability if prob else fit_severity)
    predict, evaluate = (predict_probability, evaluate_probability) if prob else (predict_severity, evaluate_severity)
    rows = None
    for i, kind in enumerate(kinds):
        try:
            met = evaluate(predict(fit(train, kind, features=features), test))
            row = metrics_row(spark, target, i + 1, kind, met, features).withColumn("error", F.lit(None).cast("string"))
        except Exception as e:  # any failure of one algorithm is a result of the comparison
            none = metrics_row(spark, target, i + 1, kind, spark.range(1).select(F.lit(None).cast("double").alias("none")), features)
            row = none.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:500]))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def save_model(model: PipelineModel, name: str, version_no: int, root: str) -> str:
    """PipelineModel under <root>/<name>/v<n>; a version that is there already is an error."""
    path = os.path.join(root, name, f"v{version_no}")
    model.write().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def metrics_row(spark: SparkSession, name: str, version_no: int, algorithm: str, metrics: DataFrame,
                features=FEATURE_NAMES) -> DataFrame:
    """One model-metrics row from a 1-row metrics DataFrame (no collect:
    the numeric columns become a map<string,double>)."""
    num = [c for c, t in metrics.dtypes if t in ("double", "bigint", "int")]
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in num]), F.array(*[F.col(c).cast("double") for c in num]))
    return metrics.select(
        F.lit(name).alias("name"), F.lit(f"v{version_no}").alias("version"), F.lit(version_no).alias("version_no"),
        F.lit(algorithm).alias("algorithm"), F.lit(_dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))
        .cast("timestamp").alias("created_at"),
        m.alias("metrics"), F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        F.lit(len(list(features))).alias("feature_count"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in MODEL_METRICS_SCHEMA.fields])


def latest_versions(metrics: DataFrame) -> DataFrame:
    """Latest (highest integer) version per model."""
    w = Window.partitionBy("name").orderBy(F.desc("version_no"))
    return metrics.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def compare_versions(metrics: DataFrame, name: str) -> DataFrame:
    """Q24: metric x version table for one model (explode map -> pivot)."""
    long = metrics.filter(F.col("name") == name).select("version", F.explode("metrics").alias("metric", "value"))
    return long.groupBy("metric").pivot("version").agg(F.first("value"))


def list_versions(metrics: DataFrame) -> DataFrame:
    """Q25: versions per model, sorted by integer version."""
    return metrics.groupBy("name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("version_no", "version"))), lambda s: s["version"])
        .alias("versions"), F.max("version_no").alias("latest_version_no"))


def get_version(metrics: DataFrame, name: str, version: str | int | None = None) -> DataFrame:
    """Q25: one version of a model ("v2" or 2), the latest where none is named."""
    d = metrics.filter(F.col("name") == name)
    if version is None:
        return latest_versions(d)
    return d.filter((F.col("version") == str(version)) | (F.col("version_no").cast("string") == str(version)))


def normalised_comparison(results: DataFrame, metric: str = "rmse") -> DataFrame:
    """Q26: 1 - metric / max(metric) over the compared algorithms (tiny table); a failed one has nulls and its error."""
    v = F.col("metrics")[metric]
    extra = ["error"] if "error" in results.columns else []
    return results.select("name", "algorithm", F.lit(metric).alias("metric"), v.alias("value"),
                          (1 - F.try_divide(v, F.max(v).over(Window.partitionBy("name")))).alias("normalised"), *extra)
