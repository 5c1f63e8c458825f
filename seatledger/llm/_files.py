"""Binary files of tasks in the shared folder.

A task writes under a name of its own and returns that name in a row; rows of
tasks that Spark counts as done are the list of valid files, so a task that is
lost, or runs twice, leaves a file that no list names.
"""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..session import ensure_checkpoint_dir

# Schemes whose name differs between Hadoop and Arrow.
ARROW = {"s3a": "s3", "s3n": "s3"}


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's place in the shared one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex[:12]}"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    scheme, rest = re.match(r"(?:([a-zA-Z][\w+.-]*):)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return pafs.LocalFileSystem(), re.sub("^/+", "/", rest)
    return pafs.FileSystem.from_uri(f"{ARROW.get(scheme, scheme)}:{rest}")


def new_name(label: str) -> str:
    return f"{label}-{uuid.uuid4().hex}"


class Writer:
    """One file of ``path``; ``at`` is where the next bytes go."""

    def __init__(self, path: str, name: str):
        where, root = place(path)
        where.create_dir(root, recursive=True)
        self.out, self.name, self.at = where.open_output_stream(f"{root}/{name}"), name, 0

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()


def write(path: str, name: str, data: bytes) -> None:
    w = Writer(path, name)
    w.add(data)
    w.close()


def read(path: str, name: str, at: int = 0, size: int | None = None) -> bytes:
    where, root = place(path)
    with where.open_input_file(f"{root}/{name}") as f:
        return f.read_at(f.size() if size is None else size, at)
