"""The global gradient-boosted-tree model: one fit over all entities, then recursive forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsspark.config import FeatureConfig, TreeConfig
from tsspark.functions.offsets import advance
from tsspark.operators.backtest import DEFAULTS, cutoff_rows, score_splits
from tsspark.operators.boosting import as_model, grow_trees
from tsspark.operators.features import calendar_columns, drop_warmup, engineered
from tsspark.operators.forecast import last_rows
from tsspark.session import cut_lineage, ensure_checkpoint_dir

MODEL_NAME = "gbt"
STEPS_PER_CUT = 5
#: Rows of a partition during a fit, until there are ``PARTS`` partitions; from there on partitions grow up to ``MOST_ROWS``.
ROWS_PER_PART = 64_000
PARTS = 48
MOST_ROWS = 1_000_000
#: Noted on the model as Spark ML's setting; the fit itself keeps no state that needs a checkpoint (``boosting``).
TREES_PER_CHECKPOINT = 20
HISTORY_MARGIN = 5


def _indexed(name: str) -> str:
    return f"{name}__level"


def fit_trees(
    featured: DataFrame,
    features: Sequence[str],
    target: str = "target",
    entity: str | None = "entity",
    date: str = "date",
    config: TreeConfig = TreeConfig(),
    categorical: Sequence[str] = (),
    validation: str | None = None,
) -> PipelineModel:
    """Fit indexers and boosted trees; runs jobs. The trees are grown by ``boosting``, the model is Spark ML's.

    Split candidates of large tables come from a sample per partition. Rows are hashed into a number of partitions that
    follows from the number of rows only, and sorted inside, so trees don't depend on how the input was partitioned.
    ``validation`` names a boolean column; its true rows are not fitted but choose the number of trees: the round of the
    least mean absolute error, the search ending after ``config.patience`` rounds without a better one. The trees up to
    that round are those of the whole fit, as each round only builds on the rounds before.
    """
    ensure_checkpoint_dir(featured.sparkSession)
    keys = [entity, date] if entity else [date]
    columns = list(dict.fromkeys([*keys, *features, target] + ([validation] if validation else [])))
    rows = drop_warmup(featured.select(*columns), features, target).persist(StorageLevel.DISK_ONLY)
    fitted = rows.where(~F.col(validation)) if validation else rows
    prepared = None
    try:
        indexers = [
            StringIndexer(inputCol=c, outputCol=_indexed(c), handleInvalid="keep", stringOrderType="alphabetAsc").fit(fitted)
            for c in categorical
        ]
        inputs = [_indexed(c) if c in categorical else c for c in features]
        levels = {_indexed(c): len(i.labels) + 1 for c, i in zip(categorical, indexers, strict=True)}
        stages = [*indexers, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]
        trees = GBTRegressor(
            labelCol=target,
            predictionCol="prediction",
            lossType="squared",
            maxIter=config.n_trees,
            stepSize=config.learning_rate,
            maxDepth=config.max_depth,
            maxBins=max([config.max_bins, *[len(i.labels) + 1 for i in indexers]]),
            seed=config.seed,
            checkpointInterval=TREES_PER_CHECKPOINT,
        )
        prepared = _laid_out(PipelineModel(stages).transform(fitted), keys, [*inputs, target])
        grown = grow_trees(prepared, inputs, target, levels, trees)
        model = as_model(featured.sparkSession, grown, trees)
        if validation:
            held_out = PipelineModel(stages).transform(rows.where(validation)).select("features", target)
            best = best_round(model.evaluateEachIteration(held_out, "absolute"), config.patience)
            if best < config.n_trees:
                model = as_model(featured.sparkSession, grown, trees.setMaxIter(best))
        return PipelineModel([*stages, model])
    finally:
        rows.unpersist()
        if prepared is not None:
            prepared.unpersist()


def fit_parts(n_rows: int) -> int:
    """Partitions in which a fit reads its rows; the split candidates' sample follows from them. A pass may join some of them to a task."""
    return max(1, min(-(-n_rows // ROWS_PER_PART), PARTS), -(-n_rows // MOST_ROWS))


def _laid_out(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` as doubles in partitions and an order that follow from the rows alone, kept until they are binned."""
    doubles = {f"_{k}": F.col(c).cast("double") for k, c in enumerate(columns)}
    laid = rows.withColumns(doubles).select(*keys, *doubles).repartition(fit_parts(rows.count()), *keys).sortWithinPartitions(*keys)
    return laid.select(*[F.col(k).alias(c) for k, c in zip(doubles, columns, strict=True)]).persist(StorageLevel.DISK_ONLY)


def best_round(errors: Sequence[float], patience: int) -> int:
    """Number of trees with the least error, looking no further than ``patience`` rounds past the best so far."""
    best = 0
    for at, error in enumerate(errors):
        if error < errors[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1


def rounds(model: PipelineModel) -> int:
    """Trees of a fitted tree model, 0 for any other."""
    return getattr(model.stages[-1], "getNumTrees", 0)


def model_features(model: PipelineModel) -> list[str]:
    """Trained features in order, under their input names."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c.removesuffix("__level") for c in assembler.getInputCols()]


# count, mean and squared deviations of the last entries of ``hist``, missing ones skipped
_MOMENTS = """aggregate(
    slice(hist, greatest(size(hist) - {w} + 1, 1), {w}),
    named_struct('n', 0, 'mean', 0D, 'm2', 0D),
    (a, v) -> if(v IS NULL, a, named_struct(
        'n', a.n + 1,
        'mean', a.mean + (v - a.mean) / (a.n + 1),
        'm2', a.m2 + (v - a.mean) * (v - a.mean) * a.n / (a.n + 1))))"""


def _with_next_features(state: DataFrame, features: Sequence[str], config: FeatureConfig, day: Column) -> DataFrame:
    """``state`` plus the engineered features of the next row, dated ``day``; what is unknown becomes 0."""
    moments = {f"_moments_{w}": F.expr(_MOMENTS.format(w=w)) for w in config.windows}
    out = {f"lag_{k}": F.expr(f"coalesce(get(hist, size(hist) - {k}), 0D)") for k in config.lags}
    for w in config.windows:
        m, least = f"_moments_{w}", config.min_periods
        out[f"rolling_mean_{w}"] = F.expr(f"if({m}.n >= greatest({least}, 1), {m}.mean, 0D)")
        out[f"rolling_std_{w}"] = F.expr(f"if({m}.n >= greatest({least}, 2), sqrt({m}.m2 / ({m}.n - 1)), 0D)")
    out |= calendar_columns(day)
    wanted = [out[f].alias(f) for f in features if f in out]
    return state.withColumns(moments).select(*state.columns, *wanted)


def roll_forward(
    state: DataFrame,
    model: PipelineModel,
    horizon: int,
    keys: Sequence[str],
    config: FeatureConfig = FeatureConfig(),
    step_days: int = 1,
    offset: str | None = None,
) -> DataFrame:
    """Forecast ``horizon`` steps for every row of ``state`` (keys, last_date, hist, exogenous columns).

    Steps are ``step_days`` or an ``offset`` apart.

    Each step scores all rows at once and appends the prediction to ``hist``; the loop is over steps,
    never over entities. Every few steps the small state table is checkpointed, which bounds the plan
    and survives lost executors. Returns keys with (step, date, y_pred).
    """
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    features, offset = model_features(model), offset or f"{step_days}D"
    constant = [c for c in state.columns if c not in {*keys, "last_date", "hist"}]
    numeric = {f.name for f in state.schema.fields if f.dataType.typeName() not in ("string", "array", "date", "timestamp", "timestamp_ntz")}
    fixed = {c: F.coalesce(F.col(c), F.lit(0)) for c in constant if c in numeric and not engineered(c)}
    state = state.withColumns(fixed) if fixed else state
    for step in range(1, horizon + 1):
        scored = model.transform(_with_next_features(state, features, config, advance(F.col("last_date"), step, offset)))
        state = scored.select(*keys, "last_date", *constant, F.concat("hist", F.array("prediction")).alias("hist"))
        if step % STEPS_PER_CUT == 0 and step < horizon:
            state = cut_lineage(state)
    made = F.slice("hist", -horizon, horizon)
    steps = state.select(*keys, "last_date", F.posexplode(made).alias("at", "y_pred"))
    at = F.col("at") + 1
    return steps.select(*keys, at.alias("step"), advance(F.col("last_date"), at, offset).alias("date"), "y_pred")


def recursive_forecast(
    df: DataFrame,
    model: PipelineModel,
    horizon: int,
    entity: str | None = "entity",
    date: str = "date",
    target: str = "target",
    config: FeatureConfig = FeatureConfig(),
    step_days: int = 1,
    offset: str | None = None,
) -> DataFrame:
    """Forecast table for all entities, or for the one series of a table without; other features keep their last value."""
    exogenous = tuple(f for f in model_features(model) if not engineered(f))
    seed = last_rows(df, config.lookback + HISTORY_MARGIN, entity, date, target, exogenous).where(F.size("hist") > 0)
    if entity:  # one row per entity from here on: into few tasks, however many ``df`` has, as each reads the model for every step
        seed = seed.repartition(F.xxhash64(entity))  # by ``entity`` itself, a layout that ``df`` may have already would stay
    made = roll_forward(seed, model, horizon, [entity] if entity else [], config, step_days, offset)
    return made.select((F.col(entity) if entity else F.lit(None).cast("string")).alias("entity_id"), "date", "y_pred", F.lit(MODEL_NAME).alias("model_name"), "step")


def backtest_trees(
    df: DataFrame,
    model: PipelineModel,
    horizon: int,
    n_splits: int,
    entity: str = "entity",
    date: str = "date",
    target: str = "target",
    config: FeatureConfig = FeatureConfig(),
    strict: bool = False,
) -> DataFrame:
    """Split metrics of a fitted model, not refitted per split: one state row per (entity, split)."""
    exogenous = tuple(f for f in model_features(model) if not engineered(f))
    tail = config.lookback + HISTORY_MARGIN
    first = max(max(config.lags, default=0), DEFAULTS.min_history)  # no split may lack a lag
    cut = cutoff_rows(df, horizon, n_splits, tail, entity, date, target, first=first, strict=strict, extra=exogenous)
    keys = [entity, "split"]
    made = roll_forward(cut.drop("ahead"), model, horizon, keys, config)
    ahead = cut.select(*keys, "last_date", F.inline("ahead").alias("date", "y_true")).where(F.col("y_true").isNotNull())
    return score_splits(ahead.join(made, [*keys, "date"]), entity)


def feature_importance(spark: SparkSession, model: PipelineModel, top: int | None = None) -> DataFrame:
    """All features, or the ``top`` strongest; a handful of numbers that the fitted model holds on the driver."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(model_features(model), weights, strict=True)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    ranked = table.orderBy(F.col("importance").desc(), "feature")
    return (ranked if top is None else ranked.limit(top)).select("feature", F.round("importance", 6).alias("importance"))
