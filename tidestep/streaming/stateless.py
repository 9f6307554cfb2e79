"""Steps over streams: what only reads the current row runs on a stream as on a table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from tidestep.operators.step import DataStep
from tidestep.plans import ir
from tidestep.plans.frontend import parse


def stream_step(stream: DataFrame, logic: Callable[[Any], None], **options: Any) -> DataFrame:
    """A row step over a streaming DataFrame; steps that look across rows are an error, for a stream has no order."""
    if any(isinstance(n, (ir.Edge, ir.Lag, ir.Dif, ir.Auto)) for s in parse(logic) for n in s.walk()) or options.get("retain"):
        raise ValueError("a step over a stream may only read the current row")
    return DataStep(stream, logic, **options).to_df()


def batch_step(logic: Callable[[Any], None], sink: Callable[[DataFrame, int], None], **options: Any) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: any step, applied to each micro-batch on its own."""
    return lambda df, epoch: sink(DataStep(df, logic, **options).to_df(), epoch)
