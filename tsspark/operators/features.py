"""Past-only features per entity: row lags, rolling statistics and calendar fields.

All window expressions use the same (entity, date) specification, so one exchange and one sort serve
them all. A panel has one row per entity and day, which bounds a window group by the calendar. A series
without an entity is windowed in blocks (``long_series``), whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.config import FeatureConfig
from tsspark.operators.long_series import BLOCK_ROWS, LongSeries

# Names of the calendar fields, and columns that would leak the answer.
CALENDAR_COLUMNS = ("day_of_week", "day_of_month", "week_of_year", "month", "is_weekend")
NEVER_FEATURES = frozenset({"target", "target_raw", "target_original", "target_augmented", "augmentation_type"})


def series_window(entity: str, date: str) -> WindowSpec:
    """Rows of one entity in date order."""
    return W.partitionBy(entity).orderBy(date)


def _steps(values: int | float | Iterable[int]) -> list[int]:
    listed = [values] if isinstance(values, (int, float)) else list(values)
    return sorted({int(v) for v in listed if v > 0})


def lag_columns(target: str, lags: int | Iterable[int], series: WindowSpec) -> dict[str, Column]:
    """The value so many rows earlier; nothing is filled."""
    return {f"lag_{k}": F.lag(target, k).over(series) for k in _steps(lags)}


def rolling_columns(
    target: str, windows: int | Iterable[int], min_periods: int, series: WindowSpec
) -> dict[str, Column]:
    """Mean and sample deviation over the rows before the current one; NULLs are skipped."""
    out = {}
    for w in _steps(windows):
        past = series.rowsBetween(-w, -1)
        enough = F.count(target).over(past) >= min_periods
        out[f"rolling_mean_{w}"] = F.when(enough, F.avg(target).over(past))
        out[f"rolling_std_{w}"] = F.when(enough, F.stddev_samp(target).over(past))
    return out


def calendar_columns(day: Column) -> dict[str, Column]:
    """Monday is 0; ISO week; Saturday and Sunday are the weekend."""
    fields = (
        F.weekday(day),
        F.dayofmonth(day),
        F.weekofyear(day),
        F.month(day),
        F.when(F.weekday(day) >= 5, 1).otherwise(0),
    )
    return {name: field.cast("bigint") for name, field in zip(CALENDAR_COLUMNS, fields, strict=True)}


def add_features(
    df: DataFrame,
    target: str = "target",
    entity: str | None = "entity",
    date: str = "date",
    config: FeatureConfig = FeatureConfig(),
    ties: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Input rows and columns, plus every feature.

    Without an entity the whole table is one series, in the order of date and ``ties``; then jobs run while the plan is built.
    """
    for column in filter(None, (target, date, entity, *ties)):
        if column not in df.columns:
            raise ValueError(f"Feature input requires column '{column}'. Found: {df.columns}.")

    def columns(series: WindowSpec) -> dict[str, Column]:
        return {
            **lag_columns(target, config.lags, series),
            **rolling_columns(target, config.windows, config.min_periods, series),
            **calendar_columns(F.col(date)),
        }

    if entity is None:
        return LongSeries.of(df, (date, *ties), block_rows).windowed(config.lookback, columns).frame()
    return df.withColumns(columns(series_window(entity, date)))


class _SeriesParams(Params):
    target = Param(Params._dummy(), "target", "value column", TypeConverters.toString)
    entity = Param(Params._dummy(), "entity", "series column, empty for a single series", TypeConverters.toString)
    date = Param(Params._dummy(), "date", "date column", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(target="target", entity="entity", date="date")

    def _add(self, df: DataFrame, reach: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
        entity, date = self.getOrDefault("entity"), self.getOrDefault("date")
        if entity:
            return df.withColumns(columns(series_window(entity, date)))
        return LongSeries.of(df, date).windowed(reach, columns).frame()

    def _require(self, df: DataFrame, *names: str) -> None:
        for name in filter(None, (self.getOrDefault(n) for n in names)):
            if name not in df.columns:
                raise ValueError(f"{type(self).__name__} requires column '{name}'. Found: {df.columns}.")


class LagFeatures(Transformer, _SeriesParams, DefaultParamsReadable, DefaultParamsWritable):
    lags = Param(Params._dummy(), "lags", "row offsets", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, target="target", entity="entity", date="date", lags=(1, 7, 14)):
        super().__init__()
        self._set(**{**self._input_kwargs, "lags": _steps(lags)})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self._require(dataset, "target", "entity", "date")
        target, lags = self.getOrDefault("target"), self.getOrDefault("lags")
        return self._add(dataset, max(lags, default=0), lambda series: lag_columns(target, lags, series))


class RollingFeatures(Transformer, _SeriesParams, DefaultParamsReadable, DefaultParamsWritable):
    windows = Param(Params._dummy(), "windows", "window lengths in rows", TypeConverters.toListInt)
    minPeriods = Param(Params._dummy(), "minPeriods", "values needed for a result", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, target="target", entity="entity", date="date", windows=(7, 14), minPeriods=1):
        super().__init__()
        self._setDefault(minPeriods=1)
        self._set(**{**self._input_kwargs, "windows": _steps(windows)})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self._require(dataset, "target", "entity", "date")
        target, windows, least = (self.getOrDefault(p) for p in ("target", "windows", "minPeriods"))
        return self._add(dataset, max(windows, default=0), lambda series: rolling_columns(target, windows, least, series))


class CalendarFeatures(Transformer, _SeriesParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, date="date"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self._require(dataset, "date")
        return dataset.withColumns(calendar_columns(F.col(self.getOrDefault("date"))))


def feature_stages(
    target: str = "target", entity: str | None = "entity", date: str = "date", config: FeatureConfig = FeatureConfig()
) -> PipelineModel:
    """The three feature steps as one reusable transformer, for training and scoring alike."""
    columns = {"target": target, "entity": entity or "", "date": date}
    return PipelineModel(
        [
            LagFeatures(lags=list(config.lags), **columns),
            RollingFeatures(windows=list(config.windows), minPeriods=config.min_periods, **columns),
            CalendarFeatures(date=date),
        ]
    )


def with_stages(stages: PipelineModel, model: PipelineModel) -> PipelineModel:
    """One pipeline that adds the features to a raw panel and scores it; what is saved."""
    return PipelineModel([*stages.stages, *model.stages])


def split_stages(pipeline: PipelineModel) -> tuple[PipelineModel, PipelineModel]:
    """The feature steps at the front of a pipeline, and the rest, which scores rows that have features."""
    n = next((k for k, stage in enumerate(pipeline.stages) if not isinstance(stage, _SeriesParams)), len(pipeline.stages))
    return PipelineModel(pipeline.stages[:n]), PipelineModel(pipeline.stages[n:])


def stage_config(stages: PipelineModel, default: FeatureConfig = FeatureConfig()) -> FeatureConfig:
    """The settings that feature steps were made with; ``default`` where there are none."""
    if not stages.stages:
        return default
    lags = [k for s in stages.stages if isinstance(s, LagFeatures) for k in s.getOrDefault("lags")]
    rolling = [s for s in stages.stages if isinstance(s, RollingFeatures)]
    windows = [w for s in rolling for w in s.getOrDefault("windows")]
    return FeatureConfig(tuple(lags), tuple(windows), max([s.getOrDefault("minPeriods") for s in rolling], default=default.min_periods))


def engineered(name: str) -> bool:
    return name.startswith(("lag_", "rolling_")) or name in CALENDAR_COLUMNS


def feature_names(
    columns: Sequence[str],
    target: str = "target",
    entity: str | None = "entity",
    date: str = "date",
    exogenous: Sequence[str] = (),
) -> list[str]:
    """Engineered columns plus the exogenous ones asked for; a banned name is an error."""
    banned = NEVER_FEATURES | {target, date, entity}
    leaking = sorted(set(exogenous) & banned)
    if leaking:
        raise ValueError(f"These columns must never be features: {leaking}")
    chosen = [c for c in columns if c not in banned and (engineered(c) or c in exogenous)]
    absent = sorted(set(exogenous) - set(chosen))
    if absent:
        raise ValueError(f"Exogenous columns not found: {absent}")
    if not chosen:
        raise ValueError("No feature columns found; need lags, rolling, or calendar features.")
    return chosen


def enforce_features(df: DataFrame, trained: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The trained features in the trained order, after ``keep``."""
    absent = [c for c in trained if c not in df.columns]
    if absent:
        raise ValueError(f"Feature mismatch: {len(absent)} expected column(s) are missing: {absent}")
    return df.select(*keep, *trained)


def drop_warmup(df: DataFrame, features: Sequence[str], target: str = "target") -> DataFrame:
    """Rows on which the model can be fitted: no missing feature, no missing target."""
    return df.dropna(subset=[*features, target])


def base_columns(df: DataFrame) -> DataFrame:
    """The series without its engineered columns."""
    return df.select(*[c for c in df.columns if not engineered(c)])
