"""Binary files in the shared folder, opened by tasks: local paths directly, other stores through pyarrow's file systems."""

from __future__ import annotations

import os
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _place(uri: str):
    """A local path, or a pyarrow file system and the path in it."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return None, unquote(parsed.path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_dirs(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


@contextmanager
def open_write(uri: str):
    """Write a file; it has its name only once it is complete."""
    system, path = _place(uri)
    part = path + ".part"
    if system is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as out:
            yield out
        os.replace(part, path)
    else:
        with system.open_output_stream(part, compression=None) as out:
            yield out
        system.move(part, path)


@contextmanager
def open_read(uri: str):
    """A seekable file."""
    system, path = _place(uri)
    with open(path, "rb") if system is None else system.open_input_file(path) as source:
        yield source


def read_parquet_folder(uri: str, columns: list[str]):
    """The Parquet files right below a folder as one Arrow table; None if there is no such folder or no file."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    system, path = _place(uri)
    if system is None:
        names = [f"{path}/{n}" for n in sorted(os.listdir(path))] if os.path.isdir(path) else []
    else:
        from pyarrow import fs

        names = sorted(x.path for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))
    parts = []
    for name in names:
        if name.endswith(".parquet"):
            with open(name, "rb") if system is None else system.open_input_file(name) as source:
                parts.append(pq.ParquetFile(source).read(columns=columns))
    return pa.concat_tables(parts) if parts else None


def size_of(uri: str) -> int:
    system, path = _place(uri)
    return os.path.getsize(path) if system is None else system.get_file_info(path).size
