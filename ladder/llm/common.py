"""Helpers shared by the text operators: the shared scratch folder and shipping this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: What separates words, as a regular expression and as the characters themselves.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where the session names none (tests,
    local runs) a temporary folder is used; on a cluster that would be wrong, so it is refused there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
    made = tempfile.mkdtemp(prefix="ladder-llm-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Tables written once under the shared folder and scanned back: cuts lineage, so a lost executor re-reads
    files. They stay while the session lives (results are lazy and may be read at any later time), except those given up
    with ``drop``, and are removed when it ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.parquet(path)
        if self._n == 1:
            delete_at_end(self.spark, self.path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder that is there when the session's process ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: where the repository is on neither their path nor in the working
    folder, it is sent along as a zip (as with ``--py-files``)."""
    app = spark.sparkContext.applicationId
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SHIPPED or ROOT in known or os.path.realpath(ROOT) in map(os.path.realpath, [*known, os.getcwd()]):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="ladder-ship-"), "ladder_llm.zip")
    with zipfile.ZipFile(out, "w") as z:
        for top in ("ladder",):
            for folder, _, names in os.walk(os.path.join(ROOT, top)):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
