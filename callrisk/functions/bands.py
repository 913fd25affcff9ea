"""Score bands as data: one ``band`` expression for every cut table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


@dataclass(frozen=True)
class BandSpec:
    """``labels[i]`` for the first cut ``i`` the value reaches (``>=``, or ``>``
    when ``strict``), scanning cuts in the given (descending) order; the last
    label otherwise.  Null scores give a null band."""
    name: str
    cuts: tuple
    labels: tuple
    strict: bool = False

    def __post_init__(self):
        if len(self.labels) != len(self.cuts) + 1:
            raise ValueError("labels must have one more entry than cuts")


# Fixed band tables.
BATCH_SAFETY = BandSpec("batch_safety", (70.0, 40.0), S.BATCH_LABELS)          # high score = safe
REALTIME_DANGER = BandSpec("realtime_danger", (70.0, 40.0), S.REALTIME_LABELS)  # high score = risky
MOBILE_DANGER = BandSpec("mobile_danger", (60.0, 35.0), S.MOBILE_LABELS)
WIDGET_DANGER = BandSpec("widget_danger", (60.0, 40.0), S.WIDGET_LABELS)
ROUTING = BandSpec("routing", (S.ROUTE_HIGH_ABOVE, S.ROUTE_MEDIUM_ABOVE),
                   (S.ROUTE_HIGH_FLOW, S.ROUTE_MEDIUM_FLOW, S.ROUTE_LOW_FLOW), strict=True)
# Level keys (high/medium/low) of the danger scales, for dimension joins.
REALTIME_LEVEL = BandSpec("realtime_level", (70.0, 40.0), ("high", "medium", "low"))
MOBILE_LEVEL = BandSpec("mobile_level", (60.0, 35.0), ("high", "medium", "low"))

SPECS = {s.name: s for s in (BATCH_SAFETY, REALTIME_DANGER, MOBILE_DANGER, WIDGET_DANGER,
                             ROUTING, REALTIME_LEVEL, MOBILE_LEVEL)}


def band(score, spec: BandSpec) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    expr = None
    for cut, label in zip(spec.cuts, spec.labels):
        cond = c > F.lit(float(cut)) if spec.strict else c >= F.lit(float(cut))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(spec.labels[-1])))
