"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chalkline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHALKLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the operators that run Python there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="chalkline-")) / "chalkline_package.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate data goes: ``spark.checkpoint.dir``, or on one machine a temporary folder if that is unset.

    On a cluster without that setting it is an error, since a worker's own folder is of no use to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all workers share")
    return tempfile.mkdtemp(prefix="chalkline-")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is by shuffle, whatever its size is taken for: what an explode yields is sized by the file it was made of."""
    return df.hint("merge")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def materialise_by(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """:func:`materialise` with the rows of equal ``by`` in one partition and in order: what goes by these columns later needs no shuffle.

    The planner knows how a checkpoint is spread only if it was not written by an adaptive plan.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return materialise(df.repartition(*by).sortWithinPartitions(*by, *order))
    finally:
        conf.set(name, was)
