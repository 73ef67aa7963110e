"""Settings, as frozen dataclasses on the driver.

Every operator takes plain column names and values; these classes only give the defaults a home and
let a nested dict (for example from a YAML file) override them.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class PanelColumns:
    entity: str | None = "entity"
    date: str = "date"
    target: str = "target"


# Defaults of the feature, model and monitoring settings.
@dataclass(frozen=True)
class FeatureConfig:
    lags: tuple[int, ...] = (1, 7, 14)
    windows: tuple[int, ...] = (7, 14)
    min_periods: int = 1

    @property
    def lookback(self) -> int:
        return max(max(self.lags, default=0), max(self.windows, default=0))


@dataclass(frozen=True)
class TreeConfig:
    n_trees: int = 100
    learning_rate: float = 0.05
    max_depth: int = 5
    seed: int = 42
    max_bins: int = 64
    #: Share of the last training dates kept to choose the number of trees; 0 fits all trees to all of them.
    inner_share: float = 0.0
    #: Trees without a smaller error on these dates after which the search ends.
    patience: int = 10


@dataclass(frozen=True)
class ForecastConfig:
    horizon: int = 30
    seasonality: int = 7
    interval_z: float = 1.96
    min_history: int = 15
    max_horizon: int = 60
    max_splits: int = 20


@dataclass(frozen=True)
class PromotionConfig:
    mae_max: float = 10.0
    rmse_max: float = 12.0
    mape_max: float = field(default=15.0, metadata={"percent": True})


@dataclass(frozen=True)
class MonitorConfig:
    """Thresholds in target units, percent, and share of moved mass."""

    mae_alert: float = 15.0
    mape_alert: float = field(default=20.0, metadata={"percent": True})
    window_days: int = 7
    drift_threshold: float = 0.25
    drift_bins: int = 10
    drift_enabled: bool = True


@dataclass(frozen=True)
class CleanConfig:
    """What the cleaning job does beyond its mode; ``augment`` is off unless asked for."""

    timezone: str | None = None
    deduplicate: bool = False
    span: str = "per_entity"
    strategy: str = "forward_fill"
    clip_lower: float | None = None
    clip_upper: float | None = None
    clip_by_quartiles: bool = False
    augment: bool = False
    seed: int = 42
    missing_blocks: bool = False
    noise_shift: bool = True
    trend_change: bool = False


@dataclass(frozen=True)
class Settings:
    columns: PanelColumns = field(default_factory=PanelColumns)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    trees: TreeConfig = field(default_factory=TreeConfig)
    forecast: ForecastConfig = field(default_factory=ForecastConfig)
    promotion: PromotionConfig = field(default_factory=PromotionConfig)
    monitor: MonitorConfig = field(default_factory=MonitorConfig)
    clean: CleanConfig = field(default_factory=CleanConfig)
    validation_share: float = 0.2


def percent(value: float) -> float:
    """A threshold given as a fraction (0.20) or as percent (20) in percent."""
    return value * 100.0 if 0 < value <= 1 else value


def overlay(base: Any, changes: dict[str, Any]) -> Any:
    """``base`` with ``changes`` applied at every depth; unknown names are an error."""
    known = {f.name: f for f in dataclasses.fields(base)}
    unknown = sorted(set(changes) - set(known))
    if unknown:
        raise ValueError(f"Unknown settings for {type(base).__name__}: {unknown}")
    updates = {}
    for name, value in changes.items():
        current = getattr(base, name)
        if dataclasses.is_dataclass(current) and isinstance(value, dict):
            value = overlay(current, value)
        elif isinstance(current, tuple) and isinstance(value, list):
            value = tuple(value)
        elif known[name].metadata.get("percent"):
            value = percent(value)
        updates[name] = value
    return dataclasses.replace(base, **updates)
