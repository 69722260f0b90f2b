"""Tables that cut lineage (see tonewright.storage), and column names that meet none of the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..storage import Keep, exists, materialise, new_path, scratch, shared_folder

__all__ = ["Keep", "exists", "materialise", "neutral", "new_path", "scratch", "shared_folder"]


def neutral(rows: DataFrame, *names: str) -> tuple:
    """rows with columns c0, c1, ... and the new names of some: helper columns of other names can't clash then."""
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]), *[f"c{rows.columns.index(n)}" for n in names]
