"""Paths in whatever store Hadoop's file system reaches: local disk, HDFS, object stores."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: The last file that a bundle gets: what it holds, and how large that is.
MANIFEST = "_manifest.json"


class StorePath:
    """A path that is asked of the store it names, never of the driver's own disk."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, str(uri).rstrip("/") or "/"

    def __str__(self) -> str:
        return self.uri

    __repr__ = __str__

    def __eq__(self, other) -> bool:
        return str(self) == str(other)

    def __hash__(self) -> int:
        return hash(self.uri)

    def __truediv__(self, name: str) -> StorePath:
        return StorePath(self.spark, f"{self.uri.rstrip('/')}/{name}")

    @property
    def name(self) -> str:
        return self.uri.rsplit("/", 1)[-1]

    @property
    def parent(self) -> StorePath:
        return StorePath(self.spark, self.uri.rsplit("/", 1)[0] if "/" in self.uri else ".")

    def with_name(self, name: str) -> StorePath:
        return self.parent / name

    def _at(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._at()
        return fs.exists(path)

    def mkdir(self) -> None:
        fs, path = self._at()
        fs.mkdirs(path)

    def delete(self) -> None:
        fs, path = self._at()
        fs.delete(path, True)

    def children(self) -> dict[str, int]:
        """The names in a folder and the bytes under each."""
        fs, path = self._at()
        return {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(path)}

    def read_text(self) -> str:
        fs, path = self._at()
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        """A new file; one that is there already is an error."""
        fs, path = self._at()
        stream = fs.create(path, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def rename_to(self, other: StorePath) -> None:
        """Moves it to where nothing is: the store refuses, in one step, if something is there."""
        fs, path = self.spark._jvm.org.apache.hadoop.fs, self._at()[1]
        context = fs.FileContext.getFileContext(self._at()[0].getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            context.rename(path, fs.Path(other.uri), none)
        except Exception as e:
            if other.exists():
                raise FileExistsError(f"there is something at {other} already") from e
            raise


@contextmanager
def bundle(folder: StorePath) -> Iterator[StorePath]:
    """A folder that appears whole or not at all.

    Files go to a hidden folder beside it; when all are written a manifest follows, and one
    rename makes the bundle. After a failure nothing is left. A folder that exists is an error,
    now or at the rename. (Where the store has no atomic rename, the manifest tells whole
    bundles from others.)
    """
    if folder.exists():
        raise FileExistsError(f"there is something at {folder} already")
    stage = folder.with_name(f".{folder.name}.staged-{uuid.uuid4().hex}")
    stage.mkdir()
    try:
        yield stage
        (stage / MANIFEST).write_text(json.dumps({"files": stage.children()}, indent=2, sort_keys=True) + "\n")
        stage.rename_to(folder)
    except BaseException:
        stage.delete()
        raise
