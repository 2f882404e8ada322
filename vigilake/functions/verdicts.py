"""Tiers and how they are reached; every function is a Column of Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers by rank, default thresholds, and the presets of levels.
TIERS = ("allow", "warn", "ask", "block")
BLOCK_AT, WARN_AT = 8, 5
#: block_at, warn_at.
Thresholds = tuple[int, int]
DEFAULT: Thresholds = (BLOCK_AT, WARN_AT)
LEVELS = {"strict": (7, 4), "high": (6, 3), "critical": (5, 2)}


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds (or replaces) a column that is worked out once, where it stands.

    It comes out of a one-element array, so that later filters on it are not moved below (which would
    write a long expression out again for each use), while filters on other columns reach the scan.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def tier_rank(severity: Column, block_at: int = BLOCK_AT, warn_at: int = WARN_AT) -> Column:
    """3 from block_at on, 1 from warn_at on, else 0; no severity is 0."""
    return F.when(severity >= block_at, 3).when(severity >= warn_at, 1).otherwise(0)


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), rank + 1)


def clamped(rank: Column, warn_only: Column) -> Column:
    """At most a warning where a surface only warns."""
    return F.when(warn_only, F.least(rank, F.lit(1))).otherwise(rank)


def degraded(rank: Column, can_ask: Column) -> Column:
    """Ask becomes block on a host that can't ask."""
    return F.when((rank == 2) & ~can_ask, 3).otherwise(rank)


def worst(*verdicts: Column) -> Column:
    """The struct (rank, ...) of the highest rank; the first given wins ties."""
    return F.array_max(F.array(*[F.struct(v["rank"].alias("rank"), F.lit(-i).alias("order"), v.alias("verdict")) for i, v in enumerate(verdicts)]))["verdict"]
