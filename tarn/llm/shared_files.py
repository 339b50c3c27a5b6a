"""Files of own formats in a folder that all executors share, written by tasks and named by a committed manifest.

A task writes under a name of its own (so a retried or speculative attempt never touches another's file) and returns
the name among its rows; those rows are written by Spark's committer. Files that no committed row names are leftovers.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; s3a:// and s3n:// are what pyarrow calls s3://."""
    for scheme in ("s3a://", "s3n://"):
        if uri.startswith(scheme):
            uri = "s3://" + uri.removeprefix(scheme)
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, prefix: str, suffix: str) -> str:
    return f"{folder}/{prefix}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """A stream that writes a new file; missing folders are made."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def read_range(uri: str, offset: int, length: int) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def open_input(uri: str):
    fs, path = open_fs(uri)
    return fs.open_input_file(path)
