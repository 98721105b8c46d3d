"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame

from navlytics.session import shared_folder


def new_folder(spark, name: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_folder(spark)}/navlytics-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again: lost executors cost no recomputation, and its size is known."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def create(uri: str) -> BinaryIO:
    """A file for writing. Names must be unique per task attempt; only what a committed manifest lists is ever read."""
    files, path = _at(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    return files.open_output_stream(path, compression=None, buffer_size=1 << 20)


def read(uri: str) -> BinaryIO:
    files, path = _at(uri)
    return files.open_input_stream(path, compression=None, buffer_size=1 << 20)


def discard(uri: str) -> None:
    """Remove a folder that this call wrote and that nothing reads any more."""
    files, path = _at(uri)
    files.delete_dir(path)
