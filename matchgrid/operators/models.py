"""Model fitting on match tables: pipelines fitted inside each fold, predictions as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchgrid.functions.numbers import interactions, values_at
from matchgrid.operators.forest import FIT_ROWS, Growth, fold_of
from matchgrid.operators.forest import cross_predict as forest_cross_predict
from matchgrid.operators.forest import leave_one_out as forest_leave_one_out


def prepared(features: list[str], estimator) -> Pipeline:
    """Median imputation, assembly and z-scores before an estimator that reads ``x``.

    The median is interpolated as ``exact_medians`` does; a column without any value in a
    fold is filled with 0.
    """
    filled = [f"{f}__i" for f in features]
    return Pipeline(stages=[
        MedianImputer(inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(withMean=True, inputCol="raw", outputCol="x"),
        estimator,
    ])


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: each column's median, the mean of the middle two where their number is even; null without values. No task holds a column's values."""
    each = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "__column", "value")
    middle = values_at(each, ["__column"], {"lower": F.floor((F.col("n") - 1) / 2), "upper": F.floor(F.col("n") / 2)})
    return middle.agg(*(F.avg(F.when(F.col("__column") == c, F.col("value"))).alias(c) for c in columns))


class MedianImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fills nulls and NaN with fixed values."""

    values = Param(Params._dummy(), "values", "value of each input column", typeConverter=TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pairs = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.values), strict=True)
        return dataset.select("*", *(F.coalesce(F.nanvl(F.col(i).cast("double"), F.lit(None)), F.lit(v)).alias(o) for i, o, v in pairs))


class MedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Exact interpolated medians, unlike ``pyspark.ml.feature.Imputer``, whose quantiles are approximate."""

    def __init__(self, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(inputCols=inputCols or [], outputCols=outputCols or [])

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        cols = self.getInputCols()
        row = exact_medians(dataset.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols)), cols).first()
        model = MedianImputerModel()
        return model._set(inputCols=cols, outputCols=self.getOutputCols(), values=[0.0 if v is None else float(v) for v in row])


def forest(label: str = "y", trees: int = 300, depth: int = 6, leaf: int = 4, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="x", labelCol=label, weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)


def upset_forest(label: str = "upset") -> RandomForestClassifier:
    """The model of upsets among lopsided matches: shallower trees with smaller leaves."""
    return forest(label, depth=5, leaf=3)


def boosted(classes: int = 2, label: str = "y", iterations: int = 60, depth: int = 3, seed: int = 42):
    """Gradient-boosted trees; one against the rest for more than two classes."""
    gbt = GBTClassifier(featuresCol="x", labelCol=label, maxIter=iterations, maxDepth=depth, seed=seed)
    return gbt if classes == 2 else OneVsRest(classifier=gbt, featuresCol="x", labelCol=label)


def goal_model(kind: str = "poisson", label: str = "goals"):
    """Poisson regression with a log link, or a tree regressor."""
    if kind == "poisson":
        return GeneralizedLinearRegression(featuresCol="x", labelCol=label, family="poisson", link="log", regParam=0.1, maxIter=50)
    return {"forest": RandomForestRegressor, "boosted": GBTRegressor}[kind](featuresCol="x", labelCol=label, seed=42)


def balanced(df: DataFrame, label: str = "y") -> DataFrame:
    """``df`` with w: rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("__k"))
    total = n.agg(F.sum("__k").alias("__n"), F.count("*").alias("__c"))
    return df.join(F.broadcast(n), label).crossJoin(F.broadcast(total)).withColumn("w", F.col("__n") / (F.col("__c") * F.col("__k"))).drop("__k", "__n", "__c")


def cross_predict(df: DataFrame, estimator: Pipeline, key: str, folds: int = 5, label: str = "y", fit_rows: int | None = None) -> DataFrame:
    """Out-of-fold predictions of any estimator, joined by key, never by place: ``prediction``, and ``p`` (array) for classifiers.

    Folds are dealt by hash of the key, so no task numbers a class; each fits imputer, scaler
    and model on the other folds alone, one after another. Forests of many folds, or with one
    row left out at a time, are one job with ``forest.cross_predict`` and
    ``forest.leave_one_out``. A fit takes at most ``fit_rows`` rows, those whose keys hash
    lowest, where that is given; predictions are always of all rows.
    """
    data = df.withColumn("fold", fold_of(F.col(key), folds)).persist()  # each fold reads it twice; it may spill, and is made again where it is lost
    n = data.count()
    made = []
    for i in range(folds):
        train = data.where(F.col("fold") != i)
        if fit_rows is not None and n > fit_rows:
            every = n // fit_rows
            train = train.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(every)) == 0).orderBy(F.xxhash64(key, F.lit(13)), key).limit(fit_rows)
        train = (balanced(train, label) if "w" not in df.columns else train).persist()  # a fit reads it again and again
        model = estimator.fit(train)
        train.unpersist()
        out = model.transform(data.where(F.col("fold") == i).withColumn("w", F.lit(1.0)))
        p = [vector_to_array("probability").alias("p")] if "probability" in out.columns else []
        made.append(out.select(key, "prediction", *p))
    return reduce(DataFrame.unionByName, made)


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """(feature, impurity importance), largest first."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def permutation_importance(df: DataFrame, model: PipelineModel, features: list[str], label: str = "y", seed: int = 7, rows: int = 1000) -> DataFrame:
    """(feature, drop): what accuracy loses when a feature's values change rows.

    Values move within hash buckets of about ``rows`` rows: each row takes the value of the
    next one in an order that another hash of the rows' numbers gives, so no task sees the
    whole table. ``forest.shapley_ranking`` ranks by Shapley values.
    """
    right = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    base = model.transform(df).agg(right).first()[0]
    buckets = F.lit(max(1, df.count() // rows))
    numbered = df.withColumn("__n", F.monotonically_increasing_id())
    found = []
    for i, f in enumerate(features):
        w = W.partitionBy(F.pmod(F.xxhash64("__n", F.lit(seed)), buckets)).orderBy(F.xxhash64("__n", F.lit(seed + 1 + i)), "__n")
        own = W.partitionBy(F.pmod(F.xxhash64("__n", F.lit(seed)), buckets)).orderBy(F.xxhash64("__n", F.lit(seed + 1 + i)), "__n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        last = F.row_number().over(w) == F.count("*").over(own)
        changed = numbered.withColumn("__v", F.when(last, F.first(f).over(own)).otherwise(F.lead(f).over(w))).withColumn(f, F.col("__v")).drop("__n", "__v")
        found.append((f, float(base - model.transform(changed).agg(right).first()[0])))
    return df.sparkSession.createDataFrame(found, "feature string, drop double")


def accuracy(df: DataFrame, key: str, features: list[str], label: str = "y", folds: int | None = None, how: Growth = Growth(), fit_rows: int = FIT_ROWS) -> float:
    """The share of rows whose class a forest that has not seen them predicts: one row left out at a time, or by folds."""
    found = forest_leave_one_out(df, key, features, label, how, fit_rows) if folds is None else forest_cross_predict(df, key, features, label, folds, how, fit_rows)
    met = found.join(df.select(key, label), key)
    return float(met.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])


def subset_search(df: DataFrame, ranked: list[str], sizes: list[int], key: str, label: str = "y", folds: int | None = None, how: Growth = Growth(), fit_rows: int = FIT_ROWS) -> DataFrame:
    """(size, accuracy, best) of the first features of a ranking, such as ``forest.shapley_ranking``; the first size of the highest accuracy is best."""
    found = [(s, accuracy(df, key, ranked[:s], label, folds, how, fit_rows)) for s in sorted({min(s, len(ranked)) for s in sizes})]
    most = max((a for _, a in found), default=0.0)
    first = next((s for s, a in found if a == most), None)
    return df.sparkSession.createDataFrame([(s, a, s == first) for s, a in found], "size int, accuracy double, best boolean")


#: Interactions of chosen features (fixed values): kind, first and second column.
INTERACTIONS = (
    ("product", "diff_elo_rating", "diff_lg_goals_weighted"), ("product", "diff_elo_rating", "diff_lg_goal_involvement_weighted"),
    ("product", "diff_elo_rating", "diff_nt_xg_sum"), ("product", "diff_lg_goals_weighted", "diff_nt_xg_sum"),
    ("diff", "home_elo_rank", "away_elo_rank"), ("product", "diff_elo_rating", "diff_conf_UEFA"),
    ("square", "diff_elo_rating", "diff_elo_rating"), ("product", "away_elo_rank", "away_lg_goals_weighted"),
)


def retrain(df: DataFrame, chosen: list[str], key: str, label: str = "y", pairs=INTERACTIONS, folds: int | None = None, how: Growth = Growth(), fit_rows: int = FIT_ROWS) -> DataFrame:
    """(step, features, accuracy) of the chosen features, and of them with the interactions whose columns are among them, missing values as medians."""
    own = [p for p in pairs if {p[1], p[2]} <= set(chosen)]
    middle = exact_medians(df, chosen).first().asDict()
    full = df.select(key, label, *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(middle[c] or 0.0))).alias(c) for c in chosen))
    more = interactions(full, own)
    added = more.columns[len(full.columns) :]
    steps = [("selected", full, chosen), ("with_interactions", more, [*chosen, *added])]
    rows = [(step, len(names), accuracy(data, key, names, label, folds, how, fit_rows)) for step, data, names in steps]
    return df.sparkSession.createDataFrame(rows, "step string, features int, accuracy double")


def qualifier(result, elo_home, elo_away, home, away):
    """Who goes through: the predicted winner, for a draw the higher rated, the home side of equals."""
    return F.when(result == 1, home).when(result == -1, away).when(elo_home >= elo_away, home).otherwise(away)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
