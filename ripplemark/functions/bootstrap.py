"""Own extractors from a module of the user: imported on the driver and brought to the executors."""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
import io
import os
import zipfile

from pyspark.sql import SparkSession

from ripplemark.session import shared_dir


def _zipped(folder: str, package: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, strict_timestamps=False) as z:
        for at, folders, names in os.walk(folder):
            folders[:] = sorted(d for d in folders if d != "__pycache__")
            for n in sorted(names):
                z.write(os.path.join(at, n), os.path.join(package, os.path.relpath(os.path.join(at, n), folder)))
    return out.getvalue()


def ship(spark: SparkSession, module: str) -> str:
    """Sends the top-level module or package of ``module`` to the executors, now and later ones; the path it is sent from.

    A single file goes as it is, a package as an archive in the shared folder, named after its content.
    """
    top = module.partition(".")[0]
    spec = importlib.util.find_spec(top)
    if spec is None:
        raise ModuleNotFoundError(top)
    if not spec.submodule_search_locations:
        path = spec.origin
    else:
        found = _zipped(list(spec.submodule_search_locations)[0], top)
        path = f"{shared_dir(spark)}/{top}-{hashlib.sha256(found).hexdigest()[:16]}.zip"
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(target):
            out = fs.create(target, True)
            out.write(found)
            out.close()
    spark.sparkContext.addPyFile(path)
    return path


def load_bootstrap(spark: SparkSession, variable: str = "RIPPLEMARK_BOOTSTRAP") -> bool:
    """Imports the module that an environment variable names, which registers its extractors when imported, and ships it.

    Extractors travel by module and name, so the workers import the module as well.
    """
    name = os.environ.get(variable)
    if name:
        importlib.import_module(name)
        ship(spark, name)
    return bool(name)
