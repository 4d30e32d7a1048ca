"""Column-level helpers built from Spark's built-in functions (no UDFs)."""

from contentlens.functions.columns import (
    coalesce0,
    day_text,
    elapsed_days,
    round_ratio_half_up,
    tag_contains,
    title_matches,
)
from contentlens.functions.visibility import Viewer, visible_in_listing, visible_single

__all__ = [
    "Viewer",
    "coalesce0",
    "day_text",
    "elapsed_days",
    "round_ratio_half_up",
    "tag_contains",
    "title_matches",
    "visible_in_listing",
    "visible_single",
]
