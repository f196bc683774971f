"""Progress of a verification case."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kredenz.dims import STEP_STATUSES
from kredenz.functions.numbers import half_up


def status_flags(status: Column) -> dict[str, Column]:
    return {f"{step}_done": status.isin(done) for step, done in STEP_STATUSES.items()}


def progress_pct(step: Column, total: int = 5) -> Column:
    """85 percent is shared by the steps before the last; the last gives 100."""
    part = half_up((step - 1) / (total - 1) * 85)
    return F.when(step < total, part).otherwise(100)


def stepper_pct(step: Column, total: Column) -> Column:
    safe = F.greatest(F.lit(1), F.least(total, step))
    return F.when(total > 1, half_up((safe - 1) / F.nullif(total - 1, F.lit(0)) * 100)).otherwise(100)
