"""The package on its way to the executors, so that Python functions there find it wherever the driver has it from."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's files to the executors of the session's context, once."""
    context = spark.sparkContext
    if getattr(context, "_lakeferry_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # it already came in an archive, which Spark has sent along
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lakeferry-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "lakeferry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, folders, names in os.walk(root):
            folders[:] = sorted(f for f in folders if f != "__pycache__")
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._lakeferry_shipped = True
