"""Retention weight and level decision as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.schema import Forgetting


def age_seconds(now: Column) -> Column:
    """Whole seconds since the last access, never negative."""
    return F.greatest(F.timestamp_diff("SECOND", F.col("accessed_at"), now), F.lit(0)).cast("bigint")


def retained(now: Column, conf: Forgetting) -> Column:
    """weight halves each half-life; accesses add up to three times its value."""
    ln2 = F.ln(F.lit(2.0))
    fade = F.exp(-age_seconds(now).cast("double") * ln2 / F.lit(conf.half_life_seconds)) if conf.half_life_seconds > 0 else F.lit(1.0)
    bonus = F.least(1 + F.lit(conf.access_boost) * F.ln(1 + F.col("access_count").cast("double")) / ln2, F.lit(3.0))
    return F.col("weight") * fade * bonus


def action(weight: Column, conf: Forgetting) -> Column:
    """'archive', 'downgrade' or 'keep'.  Archiving is tested first, whatever the level; else one level at a time."""
    level = F.col("level")
    lower = ((level == 2) & (weight < conf.threshold_to_l1)) | ((level == 1) & (weight < conf.threshold_to_l0))
    return F.when(weight < conf.threshold_archive, "archive").when(lower, "downgrade").otherwise("keep")


def new_level(decided: Column) -> Column:
    return F.when(decided == "archive", F.lit(-1)).when(decided == "downgrade", F.col("level") - 1).otherwise(F.col("level")).cast("int")
