"""Objects under a table's location: local files directly, anything else through Hadoop's FileSystem."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..errors import InvalidPath, InvalidTableLocation, ObjectStore
from ..functions.transforms import murmur3


#: Schemes of stores in which a rename is a copy.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "oss", "cosn")


@dataclass(frozen=True)
class ObjectMeta:
    location: str
    last_modified: float
    size: int


class Storage:
    """The folder of a table. Paths are relative to it and use /."""

    def __init__(self, spark: SparkSession, url: str):
        self.spark = spark
        parts = urlparse(url if "://" in url or url.startswith("file:") else f"file://{os.path.abspath(url)}")
        if parts.scheme != "file" and not parts.netloc:
            raise InvalidTableLocation(f"{url} names no bucket or host")
        # As in Hadoop's paths, a % in a URI is a % in the path.
        self.local = Path(parts.path) if parts.scheme == "file" else None
        self.location = f"file://{self.local}" if self.local else url.rstrip("/")
        if not self.local:
            jvm = spark._jvm
            try:
                self._root = jvm.org.apache.hadoop.fs.Path(self.location)
                self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
            except Exception as e:  # the JVM's own errors
                raise InvalidTableLocation(f"no storage serves {url}: {e}") from e

    def to_uri(self, path: str) -> str:
        return f"{self.location}/{path}"

    def relative(self, uri: str) -> str:
        """The path of a URI in the table; raises for others."""
        uri = f"file://{uri}" if uri.startswith("/") else uri.replace("file:///", "file:/").replace("file:/", "file:///")
        if not uri.startswith(f"{self.location}/"):
            raise InvalidPath(f"{uri} is outside {self.location}")
        return uri.removeprefix(f"{self.location}/")

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/{path}")

    def put(self, path: str, data: bytes, exclusive: bool = False) -> bool:
        """Write an object, whole or not at all; exclusive: only if there is none of the name, else False.

        Exclusive writes are a hard link (local) or a rename that does not overwrite (HDFS and the like), both atomic. On
        object stores they are the connector's create without overwriting, which excludes other writers where the store
        has conditional writes.
        """
        try:
            if self.local:
                p = self.local / path
                p.parent.mkdir(parents=True, exist_ok=True)
                tmp = p.with_name(f".{p.name}.{uuid.uuid4().hex}.tmp")
                tmp.write_bytes(data)
                if not exclusive:
                    os.replace(tmp, p)
                    return True
                try:
                    os.link(tmp, p)
                finally:
                    tmp.unlink()
                return True
            if not exclusive or urlparse(self.location).scheme in OBJECT_STORES:
                self._write(path, data, not exclusive)
                return True
            tmp = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
            self._write(tmp, data, False)
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self.spark._jsc.hadoopConfiguration())
            keep = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(self._hadoop(tmp), self._hadoop(path), keep)
            except Exception:
                self._fs.delete(self._hadoop(tmp), False)
                raise
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if exclusive and "FileAlreadyExists" in str(e):
                return False
            raise ObjectStore(f"{path} can't be written: {e}") from e

    def _write(self, path: str, data: bytes, overwrite: bool) -> None:
        out = self._fs.create(self._hadoop(path), overwrite)
        out.write(bytearray(data))
        out.close()

    def get(self, path: str) -> bytes:
        try:
            if self.local:
                return (self.local / path).read_bytes()
            src = self._fs.open(self._hadoop(path))
            data = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(src))
            src.close()
            return data
        except Exception as e:
            raise ObjectStore(f"{path} can't be read: {e}") from e

    def get_uri(self, uri: str) -> bytes:
        return self.get(self.relative(uri))

    def exists(self, path: str) -> bool:
        return (self.local / path).exists() if self.local else self._fs.exists(self._hadoop(path))

    def delete(self, path: str) -> None:
        try:
            if self.local:
                (self.local / path).unlink(missing_ok=True)
            else:
                self._fs.delete(self._hadoop(path), False)
        except Exception as e:
            raise ObjectStore(f"{path} can't be deleted: {e}") from e

    def list(self, prefix: str) -> list[ObjectMeta]:
        """All objects under a folder; none where there is no such folder."""
        try:
            if self.local:
                found = [p for p in (self.local / prefix).rglob("*") if p.is_file() and not p.name.startswith(".")]
                return [ObjectMeta(str(p.relative_to(self.local)), p.stat().st_mtime, p.stat().st_size) for p in sorted(found)]
            if not self._fs.exists(self._hadoop(prefix)):
                return []
            found, files = [], self._fs.listFiles(self._hadoop(prefix), True)
            while files.hasNext():
                s = files.next()
                name = s.getPath().toUri().getPath().split(self._root.toUri().getPath().rstrip("/") + "/", 1)[-1]
                found.append(ObjectMeta(name, s.getModificationTime() / 1000, s.getLen()))
            return sorted(found, key=lambda m: m.location)
        except OSError as e:
            raise ObjectStore(f"{prefix} can't be listed: {e}") from e


def data_path(file_name: str, partition_path: str) -> str:
    """Where a data file goes: under its partition's path, or, without one, under a hash of its name, which spreads keys."""
    return f"data/{partition_path or f'{murmur3(file_name.encode()):08x}'}/{file_name}"


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI, for tasks."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://").replace("s3n://", "s3://"))
