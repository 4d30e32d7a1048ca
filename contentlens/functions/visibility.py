"""who may see which post."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentlens.schema import ROLE_ADMIN, STATUS_PUBLISHED


@dataclass(frozen=True)
class Viewer:
    id: int
    role: str = "user"

    @property
    def is_admin(self) -> bool:
        return self.role == ROLE_ADMIN


def visible_in_listing(viewer: Viewer | None) -> Column:
    """Listing rule: anonymous sees published, a user only own posts,
    an admin everything."""
    if viewer is None:
        return F.col("status") == STATUS_PUBLISHED
    if viewer.is_admin:
        return F.lit(True)
    return F.col("author_id") == F.lit(viewer.id)


def visible_single(viewer: Viewer | None) -> Column:
    """Single-post rule: published to all, otherwise owner or admin."""
    published = F.col("status") == STATUS_PUBLISHED
    if viewer is None:
        return published
    if viewer.is_admin:
        return F.lit(True)
    return published | (F.col("author_id") == F.lit(viewer.id))
