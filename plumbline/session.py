"""What a session must have: a folder that driver and executors share, and this package on the workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_lock = threading.Lock()
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made, but on one machine only (a local master, as in tests): on a
    cluster no such folder would be shared, so that is an error.
    """
    sc = spark.sparkContext
    with _lock:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            named = spark.conf.get("spark.checkpoint.dir", None)
            if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
            sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
        return sc._jsc.sc().getCheckpointDir().get()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, if it is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once for each application; they need no copy of the repository."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId in _shipped:
            return
        here = os.path.dirname(os.path.abspath(__file__))
        # the driver serves the file to executors for as long as it lives
        folder = tempfile.mkdtemp(prefix="plumbline-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.abspath(os.path.join(folder, f"plumbline-{sc.applicationId}.zip"))
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for top, folders, names in os.walk(here):
                folders[:] = sorted(x for x in folders if x != "__pycache__")
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        z.write(full, os.path.join("plumbline", os.path.relpath(full, here)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
