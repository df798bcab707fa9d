"""Makes the package known to Python workers that can't import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application, unless they have it already."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    _DONE.add(sc.applicationId)

    def known(_):
        from importlib.util import find_spec

        return find_spec("weftgraph") is not None

    if sc.parallelize([0], 1).map(known).first():
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="weftgraph-code-"), "weftgraph.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("weftgraph", os.path.relpath(path, here)))
    sc.addPyFile(target)
