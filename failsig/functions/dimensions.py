"""PAR-1 and PRJ-5: artifact names and the four analysis axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import java_regex, null_if_blank

# The axes in their order, and the shape of an artifact name without ".logs".
AXES = ("suite", "mode", "priv", "distro")
ARTIFACT_NAME = (
    r"^([a-z_]+)-(local|remote|)-(root|rootless|)-([a-z0-9._-]+?)(?:\.logs)?$"
)
LOG_SUFFIX = ".logs"


def is_log_artifact(name: Column) -> Column:
    """PRJ-1."""
    return name.endswith(LOG_SUFFIX)


def artifact_axes(name: Column) -> dict[str, Column]:
    """PAR-1: the axes of an artifact name; a name of another shape is all suite."""
    base = F.regexp_replace(name, r"\.logs\z", "")
    pattern = java_regex(ARTIFACT_NAME)
    parts = {axis: F.regexp_extract(base, pattern, i) for i, axis in enumerate(AXES, 1)}
    # a match always has a suite of at least one letter
    parts["suite"] = F.when(parts["suite"] != "", parts["suite"]).otherwise(base)
    return parts


def dim_label() -> Column:
    """PRJ-5: non-empty axes joined by ``-``."""
    return F.concat_ws("-", *[null_if_blank(F.col(axis)) for axis in AXES])
