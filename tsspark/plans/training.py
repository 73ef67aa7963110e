"""Training, scoring and batch forecasting over all entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsspark.config import Settings
from tsspark.operators.evaluate import align, metrics_entity_mean
from tsspark.operators.features import drop_warmup, feature_names, feature_stages
from tsspark.operators.forecast import label_split, residual_std, seasonal_naive, split_date, with_interval
from tsspark.operators.registry import run_record
from tsspark.operators.trees import feature_importance, fit_trees, recursive_forecast, rounds
from tsspark.session import cut_lineage


@dataclass(frozen=True)
class TrainingRun:
    #: Scores rows that have the features; ``stages`` adds them, and is saved with it (``with_stages``).
    model: PipelineModel
    stages: PipelineModel
    features: list[str]
    comparison: DataFrame
    record: DataFrame


def panel_stages(settings: Settings = Settings()) -> PipelineModel:
    names = settings.columns
    return feature_stages(names.target, names.entity, names.date, settings.features)


def featured_panel(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return panel_stages(settings).transform(df)


def fit_on_history(
    df: DataFrame, settings: Settings = Settings(), exogenous: Sequence[str] = (), categorical: Sequence[str] = ()
) -> tuple[PipelineModel, list[str]]:
    """Fit the tree model on everything before the validation dates.

    Features look back only, so the rows of the validation dates are left out before the features are made.
    """
    names = settings.columns
    held_out = F.col(names.date) >= split_date(df, settings.validation_share, names.date)
    train = featured_panel(df.where(~F.coalesce(held_out, F.lit(False))), settings)
    features = feature_names(train.columns, names.target, names.entity, names.date, [*exogenous, *categorical])
    return _tree_fit(train, features, settings, categorical), features


def _tree_fit(train: DataFrame, features: Sequence[str], settings: Settings, categorical: Sequence[str]) -> PipelineModel:
    """The tree model; with an inner share, the last training dates choose its number of trees."""
    names, validation = settings.columns, None
    if settings.trees.inner_share > 0:
        validation = "_inner"
        cutoff = split_date(train, settings.trees.inner_share, names.date)
        train = train.withColumn(validation, F.coalesce(F.col(names.date) >= cutoff, F.lit(False)))
    return fit_trees(train, features, names.target, names.entity, names.date, settings.trees, categorical, validation)


#: (training rows, feature names) to a fitted pipeline that adds ``prediction``.
Fit = Callable[[DataFrame, list[str]], PipelineModel]


def shared_scores(baseline: DataFrame, primary: DataFrame, entity: str = "entity", date: str = "date") -> DataFrame:
    """Scores of two aligned forecasts (entity, date, y_true, y_pred) on the points both have, and how many those are.

    A model that gives no forecast for hard entities would else be compared on an easier set.
    """
    other = primary.select(entity, date, F.col("y_pred").alias("primary"))
    both = cut_lineage(baseline.select(entity, date, "y_true", F.col("y_pred").alias("baseline")).join(other, [entity, date]))
    n_pairs = both.agg(F.count(F.lit(1)).alias("n")).scalar()
    scores = [
        metrics_entity_mean(both.withColumn("y_pred", F.col(role)), entity).select(F.lit(role).alias("role"), "mae", "rmse", "mape")
        for role in ("baseline", "primary")
    ]
    return scores[0].unionByName(scores[1]).withColumn("n_pairs", n_pairs)


def train_and_compare(
    df: DataFrame, settings: Settings = Settings(), exogenous: Sequence[str] = (), categorical: Sequence[str] = (), fit: Fit | None = None
) -> TrainingRun:
    """Fit both models before the split date, forecast the validation span, score both on the same points; runs jobs.

    The featured panel feeds the fit, the forecasts and the record, so it is kept until these are done; forecasts and
    the small result tables are written to the shared folder. The primary model is the tree model unless ``fit`` gives
    another one.
    """
    names = settings.columns
    featured = label_split(featured_panel(df, settings), settings.validation_share, names.date)
    featured = featured.persist(StorageLevel.MEMORY_AND_DISK)
    train = featured.where(F.col("split") == "train").drop("split")
    held_out = featured.where(F.col("split") == "validation").drop("split")
    features = feature_names(train.columns, names.target, names.entity, names.date, [*exogenous, *categorical])
    model = _tree_fit(train, features, settings, categorical) if fit is None else fit(train, features)

    spark, keys = df.sparkSession, (names.entity, names.date)
    horizon = held_out.agg(F.count_distinct(names.date)).first()[0]
    in_sample = model.transform(drop_warmup(train, features, names.target)).select(
        F.col(names.target).alias("y_true"), F.col("prediction").alias("y_pred")
    )
    if horizon:
        baseline = seasonal_naive(train, horizon, settings.forecast.seasonality, *keys, names.target)
        primary = recursive_forecast(train, model, horizon, *keys, names.target, settings.features)
        aligned = [align(f, held_out, *keys, names.target) for f in (baseline, primary)]
        pairs = cut_lineage(aligned[1])
        comparison = cut_lineage(shared_scores(aligned[0], pairs, *keys))
    else:
        pairs = in_sample.limit(0)
        comparison = spark.createDataFrame([], "role string, mae double, rmse double, mape double, n_pairs long")
    unknown = spark.range(1).select(*[F.lit(None).cast("double").alias(m) for m in ("mae", "rmse", "mape")])
    trees = settings.trees
    record = run_record(
        train,
        features,
        comparison.where(F.col("role") == "primary").select("mae", "rmse", "mape") if horizon else unknown,
        residual_std(pairs, in_sample),
        target=names.target,
        date=names.date,
        config=settings.features,
        hyperparameters={
            "n_estimators": trees.n_trees, "rounds": rounds(model), "learning_rate": trees.learning_rate,
            "max_depth": trees.max_depth, "random_state": trees.seed, "objective": "regression",
        },
        importance=feature_importance(spark, model) if fit is None else None,
    )
    done = TrainingRun(model, panel_stages(settings), features, comparison, cut_lineage(record))
    featured.unpersist()
    return done


def batch_forecast(
    df: DataFrame, model: PipelineModel, settings: Settings = Settings(), spread: float | None = None, horizon: int | None = None
) -> DataFrame:
    """Forecast table with bounds for every entity; ``df`` is the panel up to now."""
    names = settings.columns
    made = recursive_forecast(
        df, model, horizon or settings.forecast.horizon, names.entity, names.date, names.target, settings.features
    )
    return with_interval(made, spread, settings.forecast.interval_z)
