"""WITH RECURSIVE ... UNION: Spark runs UNION ALL itself; the distinct form is a fixpoint of deltas."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import RecursionLimitError


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="veldspar-"))
    return df.checkpoint()


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 256) -> DataFrame:
    """All rows reachable from ``anchor``: each delta is distinct and without rows seen before (nulls alike)."""
    seen = delta = checkpointed(anchor.distinct())
    for _ in range(limit):
        new = step(delta).toDF(*anchor.columns).distinct()
        delta = checkpointed(new.subtract(seen))
        if delta.isEmpty():
            return seen
        seen = seen.union(delta)
    raise RecursionLimitError(f"more than {limit} rounds of recursion")
