"""Makes this package known to the executors' Python workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession) -> str:
    """A path in the folder that spark.checkpoint.dir names; a machine's own only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='twinframe-')}/graph-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once for each Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_twinframe_shipped", False):
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='twinframe-')}/twinframe", "zip", package.parent, package.name)
        context.addPyFile(archive)
        context._twinframe_shipped = True
    # long texts: a batch of rows is held by the executor and by its Python worker at once
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark
