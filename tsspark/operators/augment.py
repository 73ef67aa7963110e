"""Synthetic disturbances for robustness data sets, reproducible from a seed.

Every draw is a function of (seed, entity, step), see ``functions.draws``: the result does not depend on
partitioning, on the order of entities, or on a task being run twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsspark.functions import draws
from tsspark.sources.files import require_columns


@dataclass(frozen=True)
class MissingBlocks:
    n_blocks: int = 1
    size_min: int = 1
    size_max: int = 3


@dataclass(frozen=True)
class NoiseShift:
    n_shifts: int = 1
    scale_before: float = 0.0
    scale_after: float = 1.0


@dataclass(frozen=True)
class TrendChange:
    n_windows: int = 1
    length_min: int = 5
    length_max: int = 14
    slope_min: float = -1.0
    slope_max: float = 1.0


def gaussian_noise(
    df: DataFrame,
    seed: int,
    value: str = "target",
    keys: tuple[str, ...] = ("entity", "date"),
    noise_std: float | None = None,
    noise_scale: float | None = None,
) -> DataFrame:
    """Add normal noise of a given size, or of a multiple of the column's own spread.

    ``keys`` identify a row; they feed the draw.
    """
    if noise_std is not None:
        if noise_std <= 0:
            return df
        size: Column = F.lit(float(noise_std))
    elif noise_scale is not None and noise_scale > 0:
        spread = df.agg(F.stddev_samp(value)).scalar()
        size = noise_scale * F.when(spread > 0, spread).otherwise(1.0)
    else:
        return df
    return df.withColumn(value, F.col(value).cast("double") + size * draws.normal(seed, *[F.col(k) for k in keys]))


def augment(df: DataFrame, seed: int, enabled: bool = False, add_noise: bool = False, **noise) -> DataFrame:
    """``df`` unchanged unless switched on."""
    return gaussian_noise(df, seed, **noise) if enabled and add_noise else df


def _drawn(
    n: Column, seed: int, who: Column, missing: MissingBlocks | None, noise: NoiseShift | None, trend: TrendChange | None
) -> dict[str, Column]:
    """All draws that are made once per entity, from its row count ``n``."""
    zero, one = F.lit(0), F.lit(1)
    out: dict[str, Column] = {}
    if missing:
        allowed = F.greatest(one, F.floor(n / max(1, missing.size_min)))
        for i in range(missing.n_blocks):
            size = draws.integer(seed, F.lit(missing.size_min), F.lit(missing.size_max + 1), who, "block", i, "size")
            start = draws.integer(seed, zero, F.greatest(one, n - size + 1), who, "block", i, "start")
            used = F.lit(i) < allowed
            out |= {f"block{i}": F.when(used, start), f"block_end{i}": F.when(used, start + size)}
    if noise:
        cuts = [F.when(F.lit(i) < n - 1, draws.integer(seed, one, n, who, "cut", i)) for i in range(noise.n_shifts)]
        out["cuts"] = F.array_compact(F.array_distinct(F.array(*cuts)))
    if trend:
        for i in range(trend.n_windows):
            drawn = draws.integer(seed, F.lit(trend.length_min), F.lit(trend.length_max + 1), who, "trend", i, "length")
            length = F.least(drawn, n)
            start = draws.integer(seed, zero, F.greatest(one, n - length + 1), who, "trend", i, "start")
            slope = trend.slope_min + draws.uniform(seed, who, "trend", i, "slope") * (trend.slope_max - trend.slope_min)
            out |= {f"trend{i}": start, f"trend_end{i}": start + length, f"slope{i}": slope}
    return out


def augment_timeseries(
    df: DataFrame,
    seed: int,
    entity: str = "entity",
    date: str = "date",
    value: str = "target",
    missing: MissingBlocks | None = None,
    noise: NoiseShift | None = None,
    trend: TrendChange | None = None,
) -> DataFrame:
    """Blank out blocks, then shift the noise level, then bend the trend; per entity.

    The value itself is kept (and copied to ``target_original``); ``augmentation_type`` names what was
    done to a row, in order. Draws are made once per entity and joined to its positions on the same
    partitioning; only the noise is drawn per row.
    """
    require_columns(df, (date, value), "augment_timeseries input")
    series = W.partitionBy(entity)
    days = df.withColumn(date, F.col(date).cast("date"))
    made = _drawn(F.col("_n"), seed, F.col(entity), missing, noise, trend)
    plan = days.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).select(
        entity, F.struct(F.col("_n").alias("n"), *[c.alias(name) for name, c in made.items()]).alias("_draw")
    )
    placed = days.withColumn("_at", F.row_number().over(series.orderBy(date)) - 1).join(plan, entity)

    at = F.col("_at")
    out = F.col(value).cast("double")
    tags: list[Column] = []

    def inside(kind: str, i: int) -> Column:
        return F.coalesce((at >= F.col(f"_draw.{kind}{i}")) & (at < F.col(f"_draw.{kind}_end{i}")), F.lit(False))

    for i in range(missing.n_blocks if missing else 0):
        out = F.when(~inside("block", i), out)
        tags.append(F.when(inside("block", i), F.lit("missing_block")))
    if noise:
        regime = F.size(F.filter("_draw.cuts", lambda cut: cut <= at))
        scale = F.when(regime % 2 == 0, F.lit(float(noise.scale_before))).otherwise(F.lit(float(noise.scale_after)))
        out = out + scale * draws.normal(seed, F.col(entity), at, "noise")
        tags.append(F.lit("noise_shift"))
    for i in range(trend.n_windows if trend else 0):
        since = F.max(F.when(at == F.col(f"_draw.trend{i}"), F.col(date))).over(series)
        placed = placed.withColumn(f"_since{i}", since)
        rise = F.col(f"_draw.slope{i}") * F.datediff(F.col(date), F.col(f"_since{i}"))
        out = out + F.when(inside("trend", i), rise).otherwise(0.0)
        tags.append(F.when(inside("trend", i), F.lit("trend")))
    listed = F.array_compact(F.array(*tags).cast("array<string>"))
    kind = F.when(F.size(listed) == 0, F.lit("original")).otherwise(F.concat_ws(",", listed))
    return placed.select(
        *df.columns,
        F.col(value).cast("double").alias("target_original"),
        out.alias("target_augmented"),
        kind.alias("augmentation_type"),
    )
