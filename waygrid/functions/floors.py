"""Floor labels: strings chosen by people (``G``, ``B1``, ``2``), never numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Default label, label patterns and ground-floor names.
DEFAULT_FLOOR = "1"
BASEMENT_PATTERN = r"^(?i)(?:B|P|LB|SB|BASEMENT)\s*-?(\d+)$"
UPPER_PATTERN = r"^(?i)(?:L|F|LEVEL|FLOOR)?\s*(\d+)$"
GROUND_NAMES = ("G", "GF", "GR", "GROUND", "L", "LOBBY", "0", "L0")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_floor(c) -> Column:
    """Trimmed label; NULL and blank mean the default floor."""
    label = F.trim(_col(c).cast("string"))
    return F.coalesce(F.nullif(label, F.lit("")), F.lit(DEFAULT_FLOOR))


def floor_token(c) -> Column:
    """Label usable in a path: each run of other characters becomes ``_``."""
    return F.regexp_replace(normalize_floor(c), "[^A-Za-z0-9_-]+", "_")


def floor_level(c) -> Column:
    """Physical level of a label, NULL when the label names none."""
    label = normalize_floor(c)
    basement = F.nullif(F.regexp_extract(label, BASEMENT_PATTERN, 1), F.lit(""))
    upper = F.nullif(F.regexp_extract(label, UPPER_PATTERN, 1), F.lit(""))
    return (
        F.when(basement.isNotNull(), -basement.cast("int"))
        .when(F.upper(label).isin(*GROUND_NAMES), F.lit(0))
        .otherwise(upper.cast("int"))
    )


def same_floor(a, b) -> Column:
    return F.lower(normalize_floor(a)) == F.lower(normalize_floor(b))


def vertical_dir(from_rank, to_rank) -> Column:
    """Direction of travel between two floor ranks (bottom floor = lowest rank)."""
    step = _col(to_rank) - _col(from_rank)
    return F.when(step > 0, "up").when(step < 0, "down").otherwise("straight")
