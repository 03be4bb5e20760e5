"""The stages of the analysis run one after another, with the status of each."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

STATUS = "step int, name string, status string, rows bigint, error string"


def run_stages(spark: SparkSession, stages: Sequence[tuple[str, Callable[[], DataFrame]]], to: str, start: int = 1, end: int | None = None) -> DataFrame:
    """Run the stages from ``start`` to ``end``, counted from 1, and say how each went: ok or error.

    Every stage's table is written below ``to`` under its name, for all recordings at once. After the first
    stage that fails none is run, as later ones build on it; stages not run have no row.
    """
    done = []
    for step, (name, build) in enumerate(stages, 1):
        if not start <= step <= (end or len(stages)):
            continue
        try:
            path = f"{to}/{name}"
            build().write.mode("overwrite").parquet(path)
            done.append((step, name, "ok", spark.read.parquet(path).count(), None))
        except Exception as e:  # noqa: BLE001 - whatever breaks a stage is its status
            done.append((step, name, "error", None, f"{type(e).__name__}: {e}"[:500]))
            break
    return spark.createDataFrame(done, STATUS)
