"""Intermediate tables in the folder which all executors share.

The folder is the one named by ``spark.checkpoint.dir``. Where that is unset, a session on one machine (tests, a laptop)
gets a temporary folder; on a cluster it is an error. Everything written here survives the loss of an executor, and cutting a lineage always means writing a table
here and reading it again.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.shipping import ship


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Workspaces that aren't lasting, for ``drop_all``.
_OPEN: list[Workspace] = []


def drop_all() -> None:
    """Removes the tables of all workspaces that aren't lasting. Results that read them must have been consumed."""
    while _OPEN:
        _OPEN.pop().drop()


class Workspace:
    """Named tables and small JSON notes below one folder. A given ``path`` makes it lasting, so that a run can resume."""

    def __init__(self, spark: SparkSession, label: str, path: str | None = None):
        ship(spark)
        self.spark = spark
        self.path = path.rstrip("/") if path else f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        if not path:
            _OPEN.append(self)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` (replacing what a failed run left) and returns it as read back."""
        df.write.mode("overwrite").parquet(self.at(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.at(name))

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.at(name))
        return fs.exists(p)

    def drop(self, name: str = "") -> None:
        fs, p = self._fs(self.at(name) if name else self.path)
        fs.delete(p, True)

    def put(self, name: str, note: dict) -> None:
        """A note that is either there as a whole or not at all: written beside its place, then renamed."""
        fs, tmp = self._fs(self.at(f".{uuid.uuid4().hex}"))
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(note, sort_keys=True).encode()))
        out.close()
        _, final = self._fs(self.at(name))
        fs.mkdirs(final.getParent())
        # one step that replaces what is there; a plain rename can't, and deleting first might leave neither
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context.rename(fs.makeQualified(tmp), fs.makeQualified(final), array)

    def get(self, name: str) -> dict | None:
        fs, p = self._fs(self.at(name))
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)
