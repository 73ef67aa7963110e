"""The three cleaning jobs: generic, retail and store sales. Validation is the only eager part."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from tsspark.operators.clean import clean, clean_retail
from tsspark.operators.store_sales import store_sales
from tsspark.operators.validate import schema_problems, validate_data, validate_retail

Augment = Callable[[DataFrame], DataFrame]


def run_generic(
    raw: DataFrame, validate: dict | None = None, cleaning: dict | None = None, augment: Augment | None = None, check: bool = True
) -> DataFrame:
    """Check schema and data, clean, and optionally augment. Raises ValueError if a check fails."""
    if check:
        rules = dict(validate or {})
        names = {k: rules[k] for k in ("date", "value") if k in rules}
        errors, _ = schema_problems(raw.schema, **names)
        if errors:
            raise ValueError(f"Schema validation failed: {errors}")
        verdict = validate_data(raw, **rules).first()
        if not verdict["valid"]:
            raise ValueError(f"Data validation failed: {list(verdict['errors'])}")
    out = clean(raw, **(cleaning or {}))
    return augment(out) if augment else out


def run_retail(
    raw: DataFrame, cleaning: dict | None = None, augment: Augment | None = None, check: bool = True
) -> DataFrame:
    """Gate, gap fill and clip, and optionally augment."""
    cleaning = dict(cleaning or {})
    if check:
        validate_retail(raw, **{k: cleaning[k] for k in ("date", "entity", "target") if k in cleaning})
    out = clean_retail(raw, **cleaning)
    return augment(out) if augment else out


def run_store_sales(sales: DataFrame, master: DataFrame, order: Sequence[str]) -> DataFrame:
    """Store sales need no gate and no augmentation: merge, normalise and clean."""
    return store_sales(sales, master, order)
