"""Stored state as numbered versions, with a log that batches and streams share.

A version is a folder of Parquet tables. It counts once the log has an entry for its number, which
is put there whole and only if there is none: of two writers that began with the same version one
gets the next number, the other a ``Conflict`` and may begin again with what the first one left.
Data that no entry names was cut short and is never read. Entries are files that are renamed
into place without overwriting, which is atomic where the file system's rename is (HDFS and the
stores that follow it).
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has the version's number."""


def folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir. Where that is unset a local
    session gets a temporary one and any other an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-sluiceway-")
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Version:
    number: int
    data: str
    tables: list[str]
    note: dict[str, int] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    """The path's file system and the path, with its scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(at)


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """A file of this text, if there is none under the path: was it put there?"""
    jvm = spark._jvm
    folder, _, name = path.rpartition("/")
    system, target = _files(spark, path)
    _, draft = _files(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, options)
    except Py4JJavaError:
        system.delete(draft, False)
        if not system.exists(target):
            raise
        return False
    return True


def _numbers(spark: SparkSession, root: str) -> list[int]:
    system, at = _files(spark, f"{root}/log")
    names = [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def read_version(spark: SparkSession, root: str, number: int) -> Version:
    # one small file, which Spark reads wherever it is
    row = json.loads(spark.read.text(f"{root}/log/{number:08d}", wholetext=True).first()[0])
    return Version(number, f"{root}/data/{row['data']}", row["tables"], row["note"])


def current(spark: SparkSession, root: str) -> Version | None:
    """The newest version under root, or None."""
    numbers = _numbers(spark, root)
    return read_version(spark, root, numbers[-1]) if numbers else None


def commit(tables: dict[str, DataFrame], root: str, number: int, note: dict[str, int] | None = None) -> Version:
    """Tables as the version of this number; raises ``Conflict`` if it is there already. note: what
    the next writer should know."""
    spark = next(iter(tables.values())).sparkSession
    if number in _numbers(spark, root):
        raise Conflict(f"version {number} of {root}")
    name = f"{number:08d}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{root}/data/{name}/{table}")
    system, log = _files(spark, f"{root}/log")
    system.mkdirs(log)
    if not _put(spark, f"{root}/log/{number:08d}", json.dumps({"data": name, "tables": sorted(tables), "note": note or {}}, sort_keys=True)):
        data, at = _files(spark, f"{root}/data/{name}")
        data.delete(at, True)
        raise Conflict(f"version {number} of {root}")
    return Version(number, f"{root}/data/{name}", sorted(tables), note or {})


def load(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The tables of the newest version, or None."""
    last = current(spark, root)
    return None if last is None else {t: spark.read.parquet(f"{last.data}/{t}") for t in last.tables}


def forget(spark: SparkSession, root: str, keep: int = 3) -> None:
    """Drops all but the newest versions; whoever still reads one of those loses it."""
    for number in _numbers(spark, root)[:-keep]:
        old = read_version(spark, root, number)
        for path in (f"{root}/log/{number:08d}", old.data):
            system, at = _files(spark, path)
            system.delete(at, True)
