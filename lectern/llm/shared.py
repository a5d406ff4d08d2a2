"""Shared folder, cut lineage and small helpers used by several operators."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word characters of every contract here: anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where only ``SparkContext.setCheckpointDir`` was called, that folder.  With
    neither, a session whose driver is its only machine (master ``local``) gets a
    temporary folder; on a cluster there is none that executors are known to see,
    so this raises.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lectern-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared root; no two calls get the same."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(folder)
    return folder


#: Folders made in the open scopes, innermost last.
_scopes: list[list[str]] = []
_FOLDER = "_lectern_folder"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    schema = df.schema
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    setattr(back, _FOLDER, path)
    return back


def backed(df: DataFrame, by: DataFrame) -> DataFrame:
    """``df``, told to be read from the folder of the written table ``by``."""
    setattr(df, _FOLDER, getattr(by, _FOLDER))
    return df


def removed(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders of the shared root; those that are gone already are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """A scope whose ``written`` tables and fresh folders are deleted at its end.

    The scope yields ``keep``: tables given to it pass to the scope around (or stay,
    if there is none), because a result that is computed later still reads them.
    """
    own: list[str] = []
    _scopes.append(own)
    kept: set[str] = set()
    try:
        yield lambda *tables: kept.update(getattr(t, _FOLDER) for t in tables)
    finally:
        _scopes.remove(own)
        removed(spark, [f for f in own if f not in kept])
        if _scopes:
            _scopes[-1].extend(f for f in own if f in kept)


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """A scope that lists the folders that are made in it and stay."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that are none of ``taken`` in any case of letters."""
    taken = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def is_small(df: DataFrame, most_bytes: int = 64 << 20) -> bool:
    """Whether all rows of the written table ``df`` take at most ``most_bytes``.

    A row's size is that of its columns, strings counted by their longest value.
    """
    strings = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    found = df.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.octet_length(c)).alias(f"m{k}") for k, c in enumerate(strings)]).first()
    return found.n * (16 + 8 * len(df.columns) + sum(found[f"m{k}"] or 0 for k in range(len(strings)))) <= most_bytes


def sized(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if it is small, else as it is.

    For slim tables (ids, hashes, fences) that are written already: a join then
    leaves the texts on the other side where they are.  Beyond the bound the join
    is a shuffle.
    """
    return F.broadcast(df) if is_small(df, most_bytes) else df


def whole_text(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def give_back_memory() -> None:
    """Return what a Python worker has freed to the system, as it serves later tasks of other kinds."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


# ---- files that are not tables ------------------------------------------------


def _filesystem(uri: str):
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """Run ``write(stream)`` into a new file that appears at ``uri`` only when whole."""
    files, path = _filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(part) as out:
        write(out)
    files.move(part, path)


def opened(uri: str):
    files, path = _filesystem(uri)
    return files.open_input_file(path)
