"""Baseline models on candidate features (Spark ML)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import OUTCOMES, prior_by_side


def matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Observable features as doubles plus the candidate's direction."""
    doubles = {c: F.col(c).cast("double") for c in [*features, "bias_score"]}
    return df.withColumns(doubles | {"candidate_is_short": (F.col("side") == "SHORT").cast("double")})


def _seen(past: DataFrame, features: Sequence[str]) -> tuple[int, list[str]]:
    """Rows to learn from, and the columns with a value in them (one without any has no median and is left out)."""
    cols = [*features, "bias_score", "candidate_is_short"]
    known = [F.count(F.nanvl(F.col(f"`{c}`"), F.lit(None))).alias(f"_{i}") for i, c in enumerate(cols)]
    n, *counts = matrix(past, features).agg(F.count(F.lit(1)), *known).first()
    return n, [c for c, some in zip(cols, counts) if some]


def _prepared(cols: Sequence[str]) -> list:
    cols = list(cols)
    filled = [f"_f{i}" for i in range(len(cols))]
    return [
        Imputer(strategy="median", inputCols=cols, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
    ]


def fit_ridge(past: DataFrame, features: Sequence[str], *, alpha: float = 100.0, target: str = "net_return") -> PipelineModel | None:
    """Least squares with an L2 penalty ``alpha`` on the sum of squares; None without a row to learn from.

    The library divides its loss by the row count, so the penalty is too.
    """
    n, cols = _seen(past, features)
    if not n:
        return None
    ridge = LinearRegression(
        featuresCol="_x", labelCol=target, predictionCol="ridge", elasticNetParam=0.0, regParam=alpha / n, standardization=False, solver="normal"
    )
    return Pipeline(stages=[*_prepared(cols), ridge]).fit(matrix(past, features))


def with_ridge(model: PipelineModel | None, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Predicted return as ``ridge`` (null without a model)."""
    if model is None:
        return rows.withColumn("ridge", F.lit(None).cast("double"))
    return model.transform(matrix(rows, features)).select(*rows.columns, "ridge")


def _labels() -> StringIndexer:
    return StringIndexer(inputCol="event_outcome", outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip")


def _apply(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """All rows with their predictions, and the learned classes; the indexer would drop rows of a class it never saw."""
    names = next(s.labels for s in model.stages if hasattr(s, "labels"))
    return PipelineModel([s for s in model.stages if not hasattr(s, "labels")]).transform(matrix(rows, features)), names


def fit_logistic(past: DataFrame, features: Sequence[str], *, c: float = 1.0) -> PipelineModel | None:
    """Three-class logistic regression with inverse penalty ``c``; None without a row to learn from."""
    past = past.filter(F.col("event_outcome").isNotNull())
    n, cols = _seen(past, features)
    if not n:
        return None
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200
    )
    return Pipeline(stages=[*_prepared(cols), _labels(), model]).fit(matrix(past, features))


def with_probabilities(model: PipelineModel | None, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Class probabilities as p_<class> columns (null without a model)."""
    if model is None:
        return rows.withColumns({f"p_{c.lower()}": F.lit(None).cast("double") for c in OUTCOMES})
    made, names = _apply(model, rows, features)
    made = made.withColumn("_p", vector_to_array("probability"))
    at = {c: i for i, c in enumerate(names)}
    return made.select(*rows.columns, *[(F.get("_p", at[c]) if c in at else F.lit(0.0)).alias(f"p_{c.lower()}") for c in OUTCOMES])


def fit_boosted(past: DataFrame, features: Sequence[str], *, trees: int = 10, depth: int = 3, rate: float = 0.1, seed: int = 42) -> PipelineModel | None:
    """Boosted trees, one binary ensemble per class; None without a row to learn from."""
    past = past.filter(F.col("event_outcome").isNotNull())
    n, cols = _seen(past, features)
    if not n:
        return None
    gbt = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    many = OneVsRest(classifier=gbt, featuresCol="_x", labelCol="_y", predictionCol="class_index", parallelism=3)
    return Pipeline(stages=[*_prepared(cols), _labels(), many]).fit(matrix(past, features))


def predicted_class(model: PipelineModel | None, rows: DataFrame, features: Sequence[str], out: str = "predicted") -> DataFrame:
    """The likeliest class (null without a model)."""
    if model is None:
        return rows.withColumn(out, F.lit(None).cast("string"))
    made, names = _apply(model, rows, features)
    label = F.get(F.array(*[F.lit(x) for x in names]), F.col("class_index").cast("int"))
    return made.select(*rows.columns, label.alias(out))


def walk_forward_predictions(uses: DataFrame, features: Sequence[str], *, folds: int = 5) -> DataFrame:
    """Out-of-fold ridge and logistic predictions with the side prior beside them (null in a fold without a past)."""
    out = None
    for f in range(1, folds + 1):
        past = uses.filter((F.col("fold") == f) & (F.col("role") == "past")).drop("fold", "role")
        future = uses.filter((F.col("fold") == f) & (F.col("role") == "future")).drop("fold", "role")
        ridge = with_ridge(fit_ridge(past, features), future, features)
        both = with_probabilities(fit_logistic(past, features), ridge, features)
        prior = prior_by_side(past).select("side", "prior_mean")
        part = both.join(prior, "side", "left").withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out
