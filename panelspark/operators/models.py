"""Point and spread regressors on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import metrics as M
from panelspark.operators import panel as P
from panelspark.operators.checks import Split, with_split
from panelspark.session import use_checkpoint_dir

# Default feature set of the point model.
FEATURES = ("prev_points", "pts_avg_3", "pts_avg_5", "was_home", "home_elo", "opponent_elo",
            "now_cost", "ep_next", "had_match", "position_code")


def prepared(df: DataFrame, features: Sequence[str], label: str = "next_points") -> DataFrame:
    """Features and label as doubles."""
    names = [*features, *([label] if label in df.columns else [])]
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def tree_pipeline(features: Sequence[str] = FEATURES, label: str = "next_points", *,
                  rounds: int = 20, depth: int = 5, step: float = 0.1,
                  seed: int = 42) -> Pipeline:
    """Boosted trees; unknown values get a level of their own below all others."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features",
                        handleInvalid="keep"),
        GBTRegressor(featuresCol="features", labelCol=label, predictionCol="pred",
                     maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)])


def ridge_pipeline(features: Sequence[str] = FEATURES, label: str = "next_points", *,
                   reg: float = 1.0) -> Pipeline:
    """Ridge regression with medians of the training rows in place of nulls."""
    filled = [f"{c}__filled" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
        LinearRegression(featuresCol="features", labelCol=label, predictionCol="pred",
                         regParam=reg, elasticNetParam=0.0)])


REGISTRY = {"trees": tree_pipeline, "ridge": ridge_pipeline}
_MISSING = -1.0e9


def _fill(df: DataFrame, features: Sequence[str], model: str) -> DataFrame:
    return df.fillna(_MISSING, subset=list(features)) if model == "trees" else df


def fit(train: DataFrame, model: str = "trees", features: Sequence[str] = FEATURES,
        label: str = "next_points", **params) -> PipelineModel:
    rows = prepared(train, features, label).where(F.col(label).isNotNull())
    use_checkpoint_dir(rows.sparkSession)       # boosting cuts its lineage every few rounds
    return REGISTRY[model](features, label, **params).fit(_fill(rows, features, model))


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES,
            kind: str = "trees", name: str = "pred") -> DataFrame:
    scored = model.transform(_fill(prepared(df, features), features, kind))
    drop = ["features", *[f"{c}__filled" for c in features]]
    out = scored.drop(*drop)
    return out if name == "pred" else out.withColumnRenamed("pred", name)


def fit_sigma(held_out: DataFrame, features: Sequence[str] = FEATURES, **params) -> PipelineModel:
    """Regressor of the absolute residual of (next_points, pred) on held-out rows."""
    rows = held_out.withColumn("abs_residual", F.abs(F.col("next_points") - F.col("pred")))
    return fit(rows.drop("pred"), "trees", features, "abs_residual", **params)


def fit_by_position(train: DataFrame, positions: Sequence[str] | None = None,
                    features: Sequence[str] = FEATURES, **params) -> dict[str, PipelineModel]:
    """A tree model for each of `positions`, or for each that has labelled rows."""
    if positions is None:
        labelled = train.where(F.col("position").isNotNull() & F.col("next_points").isNotNull())
        positions = sorted(r[0] for r in labelled.select("position").distinct().collect())
    return {p: fit(train.where(F.col("position") == p), "trees", features, **params)
            for p in positions}


def predict_by_position(models: Mapping[str, PipelineModel], df: DataFrame,
                        features: Sequence[str] = FEATURES,
                        name: str = "pred_position", other: str | None = None) -> DataFrame:
    """All rows; those of a position without a model have the value of `other`, or null."""
    known = F.coalesce(F.col("position").isin(*models), F.lit(False))
    rest = _fill(prepared(df.where(~known), features), features, "trees")
    out = rest.withColumn(name, F.col(other) if other else F.lit(None).cast("double"))
    for position, model in models.items():
        out = out.unionByName(
            predict(model, df.where(F.col("position") == position), features, name=name))
    return out


def importances(model: PipelineModel, features: Sequence[str] = FEATURES,
                top: int = 10) -> DataFrame:
    """Feature importances, highest first (one row per feature name)."""
    from pyspark.sql import SparkSession

    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    rows = SparkSession.getActiveSession().createDataFrame(
        list(zip(features, values, strict=True)), "feature string, importance double")
    return rows.orderBy(F.col("importance").desc(), "feature").limit(top)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_experiment(rows: DataFrame, spec: Mapping) -> dict[str, DataFrame]:
    """One declared experiment: fit before the test window, metrics on it.

    ``rows`` are model rows of (previous, latest) season; ``spec`` holds name, model,
    features, params, split and seasons.
    """
    split = Split(**spec["split"])
    split.validate()
    features = spec.get("features") or FEATURES
    latest = spec["seasons"][-1]
    current = with_split(rows.where(F.col("season") == latest), split)
    train = current.where(F.col("split") == "train").drop("split")
    if len(spec["seasons"]) > 1:
        train = rows.where(F.col("season").isin(list(spec["seasons"][:-1]))).unionByName(train)
    kind = spec.get("model", "trees")
    model = fit(train, kind, features, **(spec.get("params") or {}))
    test = predict(model, current.where(F.col("split") == "test"), features, kind)
    scored = test.select("player_id", "player_code", "gw", "position",
                         F.col("next_points").cast("double").alias("actual"), "pred")
    tag = lambda df: df.select(F.lit(spec["name"]).alias("name"), "*")
    return {"scored": scored, "metrics": tag(M.cohort_metrics(scored)),
            "ranking": tag(M.ranking_metrics(scored)),
            "calibration": tag(M.calibration_metrics(scored))}


def rounds_sensitivity(train: DataFrame, test: DataFrame, rounds: Sequence[int],
                       features: Sequence[str] = FEATURES, **params) -> DataFrame:
    """Level metrics of the tree model per number of boosting rounds."""
    out = None
    for n in rounds:
        scored = predict(fit(train, "trees", features, rounds=n, **params), test, features)
        row = M.point_metrics(scored.withColumn("actual", F.col("next_points").cast("double")))
        row = row.select(F.lit(n).alias("rounds"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def horizon_forecast(model: PipelineModel, rows: DataFrame, players: DataFrame, gw_start: int,
                     gw_end: int, features: Sequence[str] = FEATURES,
                     kind: str = "trees") -> DataFrame:
    """Expected points per (entity, period) of a window; no source rows is an error."""
    source = P.require_rows(
        rows.where(F.col("gw").between(gw_start - 1, gw_end - 1)),
        f"no feature rows for gameweeks {gw_start}..{gw_end}")
    return P.horizon_scores(predict(model, source, features, kind), players, gw_start, gw_end)
