"""Sending this package to the Python workers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def shipped(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once for each Spark application."""
    context = spark.sparkContext
    if not getattr(context, "_symatlas_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="symatlas-")) / "symatlas.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(_PACKAGE.rglob("*.py")):
                out.write(source, source.relative_to(_PACKAGE.parent))
        context.addPyFile(str(archive))
        context._symatlas_shipped = True
    return spark


#: Tasks of each core for a table whose rows take long or become many.
SPREAD = 4


def spread(frame: DataFrame, *by: str) -> DataFrame:
    """The frame over all cores: a small file is one task, and adaptive execution would keep it so."""
    return frame.repartition(SPREAD * frame.sparkSession.sparkContext.defaultParallelism, *by)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share; on one machine without that setting, a folder that goes with this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="symatlas-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext._jsc.sc().conf().set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
