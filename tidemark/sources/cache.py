"""Results that are kept under what they were made from, so that a changed input is never answered with an old result."""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from .shared import remove, shared_folder


def file_versions(tables: Iterable[DataFrame]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of every file that the tables are read from, by path."""
    found: dict[str, tuple[str, int, int]] = {}
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        hadoop, read = spark._jvm.org.apache.hadoop.fs.Path, set()
        for f in files:
            path = hadoop(f)
            read.add(path.toUri().getPath())
        for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
            path = hadoop(folder)
            for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
                if status.getPath().toUri().getPath() in read:
                    name = status.getPath().toString()
                    found[name] = (name, status.getLen(), status.getModificationTime())
    return sorted(found.values())


class FolderCache:
    """Folders below the shared folder, each made once from its inputs as they were; beyond ``capacity`` the one unused for longest is deleted."""

    def __init__(self, capacity: int = 100):
        self.capacity = capacity
        self.folders: OrderedDict[str, str] = OrderedDict()

    def folder(self, spark: SparkSession, name: str, inputs: Iterable[DataFrame], make: Callable[[str], None]) -> str:
        """The folder that ``make`` filled for this name, application and state of the inputs' files.

        What ``make`` left half done when it failed is deleted.
        """
        asked = repr((name, spark.sparkContext.applicationId, file_versions(inputs)))
        key = hashlib.sha256(asked.encode()).hexdigest()
        if key not in self.folders:
            path = f"{shared_folder(spark)}/tidemark-kept-{uuid.uuid4().hex}"
            try:
                make(path)
            except BaseException:
                remove(spark, path)
                raise
            self.folders[key] = path
            while len(self.folders) > self.capacity:
                remove(spark, self.folders.popitem(last=False)[1])
        self.folders.move_to_end(key)
        return self.folders[key]

    def clear(self, spark: SparkSession) -> None:
        while self.folders:
            remove(spark, self.folders.popitem()[1])
