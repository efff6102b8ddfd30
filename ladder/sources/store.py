"""Materialised intermediate tables.

Derived tables that many queries read are written once as Parquet under the shared folder the
session names in ``spark.checkpoint.dir`` and read back from there. That cuts lineage (a lost
executor re-reads files instead of recomputing the derivation) and lets the scans prune columns and
``year`` partitions. A table is keyed by a fingerprint of its input files, so a changed input
gives a new table instead of a stale read.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_BUILD_VERSION = "2"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _hadoop(spark, path)
    return bool(fs.exists(hpath))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a single-process session (``local`` or ``local[...]``) without one gets a
    temporary folder; on a cluster a machine-local folder would be wrong, so one must be configured."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage (HDFS, object store): "
                           "materialised tables and lineage cuts are written there")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ladder-ckpt-"))
    return sc.getCheckpointDir()


def table_root(spark: SparkSession) -> str:
    """Folder for materialised tables: ``<spark.checkpoint.dir>/ladder_tables``."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/ladder_tables"


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of every file under ``path``, at any depth, in order; none if nothing is there."""
    fs, hpath = _hadoop(spark, path)
    found = []
    if fs.exists(hpath):
        files = fs.listFiles(hpath, True)
        while files.hasNext():
            st = files.next()
            found.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return sorted(found)


def pinned_files(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of the files that a file scan will read: those of the listing it was planned
    with, so a table's name for derived tables and its contents can't come from two different moments."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size():
        plan = plan.children().apply(0)
    listed = plan.relation().location().allFiles().mkString("\n")  # one call, however many files there are
    found = re.findall(r"FileStatus\{path=(.*?);.*?length=(\d+);.*?modification_time=(\d+);", listed)
    return sorted((path, int(size), int(time)) for path, size, time in found)


def fingerprint(spark: SparkSession, paths: list[str], salt: str = "", files: list[tuple[str, int, int]] | None = None) -> str:
    """Hash of the path, length and modification time of every file under the input paths, at any depth, or of the
    given ``files``."""
    h = hashlib.sha1(f"{_BUILD_VERSION}|{salt}".encode())
    for p in sorted(paths) if files is None else [""]:
        h.update(f"|{p}".encode())
        for line in list_files(spark, p) if files is None else files:
            h.update("|{}|{}|{}".format(*line).encode())
    return h.hexdigest()[:16]


def delete_path(spark: SparkSession, path: str) -> None:
    fs, hpath = _hadoop(spark, path)
    fs.delete(hpath, True)


_LOCAL = threading.local()


def write_scratch(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet into a fresh folder under the shared table root and scan it back.

    Cuts lineage like ``checkpoint()`` but in one job (a reliable RDD checkpoint recomputes its input to
    write it), and tells the planner the table's real size. The folder is removed when the ``materialize`` build that
    wrote it ends, well or not; written outside of one, when the session ends.
    """
    spark = df.sparkSession
    path = f"{table_root(spark)}/_scratch/{uuid.uuid4().hex}"
    fs, hpath = _hadoop(spark, path)
    builds = getattr(_LOCAL, "builds", [])
    if builds:
        builds[-1].append(path)
    _write(df, path, partition_by)
    if not builds:
        fs.deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    if partition_by:  # a folder's rows meet in few tasks; adaptive execution splits the large ones
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)


_LOCKS: dict[str, threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()


def _lock_for(path: str) -> threading.Lock:
    with _LOCKS_GUARD:
        return _LOCKS.setdefault(path, threading.Lock())


def read_json(spark: SparkSession, path: str):
    """The JSON document in a small file; None if there is none or it is cut off (a writer was killed)."""
    fs, hpath = _hadoop(spark, path)
    if not fs.exists(hpath):
        return None
    stream = fs.open(hpath)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:
        return None
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, document, replace: bool = False) -> bool:
    """Write a small file in one go; False if it is there already (unless ``replace``)."""
    fs, hpath = _hadoop(spark, path)
    try:
        out = fs.create(hpath, replace)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(hpath):
            return False
        raise
    out.write(bytearray(json.dumps(document, ensure_ascii=False).encode()))
    out.close()
    return True


def published(spark: SparkSession, path: str) -> str | None:
    """The data folder that the table's manifest names; None if there is no whole manifest or a file it names is gone
    or cut off."""
    manifest = read_json(spark, f"{path}.json")
    if manifest is None:
        return None
    folder = f"{path}.{manifest['data']}"
    there = {p.removeprefix(_absolute(spark, folder)): size for p, size, _ in list_files(spark, folder)}
    return folder if all(there.get(name) == size for name, size in manifest["files"]) else None


def _absolute(spark: SparkSession, path: str) -> str:
    fs, hpath = _hadoop(spark, path)
    return fs.makeQualified(hpath).toString()


def publish(spark: SparkSession, path: str, data: str) -> str:
    """Make the written folder ``<path>.<data>`` the table ``path``: a manifest naming its files is written last, as one
    small file. No folder is moved, so nothing depends on renames. Returns the published folder: of several publishers
    the first wins where the store refuses to create a file twice, else the last; either way the manifest names one whole
    folder, and a folder that readers may have been told of is not deleted."""
    folder = f"{path}.{data}"
    start = _absolute(spark, folder)
    files = [(p.removeprefix(start), size) for p, size, _ in list_files(spark, folder)]
    manifest = {"data": data, "files": files}
    if not write_json(spark, f"{path}.json", manifest):
        other = published(spark, path)
        if other is not None:
            delete_path(spark, folder)
            return other
        write_json(spark, f"{path}.json", manifest, replace=True)  # cut off, or of a folder that is gone
    return folder


def materialize(spark: SparkSession, build, name: str, inputs: list[str], schema: StructType | None = None,
                partition_by: tuple[str, ...] = (), columns: list[str] | None = None,
                files: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Write ``build()`` once as Parquet keyed by the inputs' fingerprint; return a scan of it.

    ``build`` is a zero-argument callable returning the DataFrame, so nothing is computed when the table already exists.
    ``files`` are the inputs' files where the caller has pinned them. The table is written to a folder of its own and
    published by a manifest (``publish``), so readers never see part of it, a killed builder leaves nothing that counts,
    and several may build at the same time.
    """
    path = f"{table_root(spark)}/{name}-{fingerprint(spark, inputs, name, files)}"
    with _lock_for(path):  # one build per table even when queries run from several threads
        folder = published(spark, path) or _build(spark, build, path, partition_by)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    out = reader.parquet(folder)
    return out.select(*columns) if columns else out


def _build(spark: SparkSession, build, path: str, partition_by: tuple[str, ...]) -> str:
    if not hasattr(_LOCAL, "builds"):
        _LOCAL.builds = []
    data = uuid.uuid4().hex
    _LOCAL.builds.append([])
    try:
        _write(build(), f"{path}.{data}", partition_by)
        return publish(spark, path, data)
    except BaseException:
        delete_path(spark, f"{path}.{data}")
        raise
    finally:
        for p in _LOCAL.builds.pop():
            delete_path(spark, p)
