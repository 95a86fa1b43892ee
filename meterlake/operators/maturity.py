"""A team's stage of use: four axes, the weakest of which counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .streaks import ladder

# Lower bounds of stages 2 to 5 by axis, in the order in which the bottleneck is told.
AXES = {"habit": (30, 60, 85, 100), "efficiency": (40, 60, 75, 88), "skill": (3, 6, 12, 15), "breadth": (2, 3, 4, 5)}


def axis_stage(axis: str, value: Column) -> Column:
    return ladder(F.coalesce(value, F.lit(-1)), AXES[axis]) + 1


def lead_cap(days: Column) -> Column:
    """The highest stage of skill that the lead time of new models allows; 3 if none was seen."""
    return F.when(days < 7, 5).when(days < 14, 4).otherwise(3)


def stages(values: DataFrame) -> DataFrame:
    """Rows ``habit, efficiency, skill, breadth, lead_days`` of measured values, null if none, to stages 1 to 5.

    ``stage`` is the smallest, ``bottleneck`` the first axis that has it, and
    ``target`` what that axis, or the lead time if it holds skill down, has to reach next.
    """
    at = {a: axis_stage(a, F.col(a)).cast("long") for a in AXES}
    capped = lead_cap(F.col("lead_days")) < at["skill"]
    at["skill"] = F.least(at["skill"], lead_cap(F.col("lead_days"))).cast("long")
    s = values.select(*[c.alias(a) for a, c in at.items()], capped.alias("capped"))
    least, bottleneck, target = F.least(*AXES), F.lit(None).cast("string"), F.lit(None).cast("long")
    for a, steps in reversed(AXES.items()):
        own = F.element_at(F.array(*map(F.lit, steps)), F.least(least, F.lit(len(steps))).cast("int")).cast("long")
        if a == "skill":
            own = F.when(F.col("capped"), F.when(least >= 4, 7).otherwise(14).cast("long")).otherwise(own)
        bottleneck, target = F.when(F.col(a) == least, a).otherwise(bottleneck), F.when(F.col(a) == least, own).otherwise(target)
    return s.select(*AXES, least.alias("stage"), bottleneck.alias("bottleneck"), F.when(least < 5, target).alias("target"), (F.col("capped") & (bottleneck == "skill")).alias("by_lead_days"))
