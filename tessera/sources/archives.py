"""Fetching and unpacking archives, listing folders, sizes of files."""

from __future__ import annotations

import hashlib
import logging
import os
import shutil
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
MEMBERS = "archive string, member string, size long, content binary"


def fetch(url: str, path: str, length: int | None = None, sha256: str | None = None) -> bool:
    """Copies ``url`` to ``path`` unless a file is there; True if it copied.

    Given a length or digest, a file that differs is fetched again, and one that still differs is
    an error, so that a cut-off download is never kept.
    """
    fits = lambda p: (length is None or os.path.getsize(p) == length) and (sha256 is None or _digest(p) == sha256)
    if os.path.exists(path) and fits(path):
        log.info("%s is there, %s bytes", path, os.path.getsize(path))
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with urllib.request.urlopen(url) as source, open(f"{path}.part", "wb") as to:  # noqa: S310
        shutil.copyfileobj(source, to)
    if not fits(f"{path}.part"):
        raise OSError(f"{url} has another length or digest than expected")
    os.replace(f"{path}.part", path)
    return True


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def zip_members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """MEMBERS: each file in each zip archive, by any path that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for entry in (x for x in z.infolist() if not x.is_dir()):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([entry.filename]), pa.array([entry.file_size], pa.int64()), pa.array([z.read(entry)], pa.binary())], ["archive", "member", "size", "content"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, MEMBERS)


def extract(members: DataFrame, target: str) -> int:
    """Writes members under ``target`` on the driver, one at a time, over what is there; the number of files. A member that would leave ``target`` is an error."""
    n = 0
    for row in members.select("member", "content").toLocalIterator():
        path = os.path.realpath(os.path.join(target, row[0]))
        if os.path.commonpath([path, os.path.realpath(target)]) != os.path.realpath(target):
            raise ValueError(f"{row[0]} leads out of the folder")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(row[1])
        n += 1
    return n


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, ord): the entries of a folder in any store, by name."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    names = sorted(s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))
    return spark.createDataFrame(list(zip(names, range(len(names)))), "name string, ord int")


def size_kb(length: Column) -> Column:
    """``~ N KB``, halves rounded to even."""
    return F.concat(F.lit("~ "), F.bround(length / 1024).cast("long").cast("string"), F.lit(" KB"))


def file_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, size): of each file, whose content is not read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", size_kb(F.col("length")).alias("size"))
