"""Session helpers: lineage cuts in the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset (tests, local runs)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="corpusmill-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that what follows survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` materialised; marked for broadcast only if it is proven to have at most ``max_rows`` rows.

    Beyond the bound the frame comes back unmarked and the join shuffles (with AQE's skew handling).
    """
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def spread(df: DataFrame, source: DataFrame, *by: str, task_bytes: int = 8 << 20) -> DataFrame:
    """``df`` in partitions for work that costs far more time than bytes: as many as the tables that ``source`` reads ask
    for by their size, at least two a core, so that tasks stay short and grow in number, not in length."""
    spark = df.sparkSession
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 56)  # beyond that it is unknown
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-size // task_bytes)), *by)


def ship(spark: SparkSession) -> None:
    """Puts this package on the executors' Python path, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusmill_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpusmill-py-")) / "corpusmill.zip"  # the driver serves it from here
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, f"corpusmill/{p.relative_to(here)}")
    sc.addPyFile(str(archive))
    sc._corpusmill_shipped = True
