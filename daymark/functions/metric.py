"""Named metrics: one description, one aggregate expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from daymark.functions.columns import col_of

KINDS = ("rows", "count", "sum", "mean", "min", "max", "distinct", "days", "flag", "rate", "nonzero", "quantile")


@dataclass(frozen=True, eq=False)
class MetricSpec:
    """`kind` of aggregate over `col`, restricted to rows matching `where`.

    rows counts rows, count counts non-NULL values, distinct counts different values, rate is the share of
    true values in percent, nonzero counts values above 0, quantile is the exact q-quantile.  days (active
    days) and flag (any row) exist for windowed metrics only.
    """

    name: str
    kind: str
    col: str | Column | None = None
    where: str | Column | None = None
    q: float = 0.5

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown metric kind {self.kind!r}")

    def gate(self) -> Column | None:
        return F.expr(self.where) if isinstance(self.where, str) else self.where

    def value(self) -> Column:
        c, gate = col_of(self.col), self.gate()
        return c if gate is None else F.when(gate, c)


def aggregate_column(m: MetricSpec) -> Column:
    """The metric as one aggregate expression.  Sums of nothing are 0, means and extremes are NULL."""
    gate = m.gate()
    if m.kind == "rows":
        out = F.count(F.lit(1)) if gate is None else F.count_if(gate)
    elif m.kind == "count":
        out = F.count(m.value())
    elif m.kind == "sum":
        out = F.coalesce(F.sum(m.value()), F.lit(0))
    elif m.kind == "mean":
        out = F.try_divide(F.sum(m.value()).cast("double"), F.count(m.value()))
    elif m.kind == "min":
        out = F.min(m.value())
    elif m.kind == "max":
        out = F.max(m.value())
    elif m.kind == "distinct":
        out = F.count_distinct(m.value())
    elif m.kind == "rate":
        hit = F.coalesce(col_of(m.col).cast("double"), F.lit(0.0)) != 0
        total = F.count(F.lit(1)) if gate is None else F.count_if(gate)
        out = F.try_divide(F.count_if(hit if gate is None else hit & gate) * 100.0, total)
    elif m.kind == "nonzero":
        hit = F.coalesce(col_of(m.col).cast("double"), F.lit(0.0)) > 0
        out = F.count_if(hit if gate is None else hit & gate)
    else:
        raise ValueError(f"{m.kind} is not a single aggregate expression")
    return out.alias(m.name)
